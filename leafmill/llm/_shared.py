"""Small helpers that several training-data operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="leafmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leafmill-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back, so that a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot when it holds more than one of this many rows, and more rows than this: there are at most as many hot keys.
HOT_SHARE = 1_000
SALTS = 64


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has a row a key and in ``n`` the number of ``rows`` with that key (dropped).

    Merge join at every size, as ``table`` grows with the corpus. Rows of hot keys are dealt over ``SALTS`` by the
    columns ``spread`` and meet a copy of their key's row in each; the hot keys are at most ``HOT_SHARE``, so they alone
    are broadcast. ``table`` should be a written one, as it is read three times.
    """
    total, most = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hot = table.filter((F.col("n") > HOT_SHARE) & (F.col("n") * HOT_SHARE > total)).select(*keys, F.lit(True).alias("_hot"))
    table = table.drop("n")
    if most <= HOT_SHARE or most * HOT_SHARE <= total:
        return rows.join(table.hint("merge"), keys, how)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def word_count(text: Column) -> Column:
    """Number of words of a text, without building the words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
