"""Run event streams: the latest status of each run, events until a run ends, summaries, and an appended index.

The functions take streaming or batch DataFrames. Registered queries drive a stream over the events table to its end and
return what it wrote; each has a batch twin in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.retrieval import chunk
from leafmill.plans.registry import query
from leafmill.plans.tables import PROJECTIONS
from leafmill.sources.catalog import scratch

TERMINAL = ("done", "error", "hitl", "cancelled")


def run_status(events: DataFrame) -> DataFrame:
    """Latest status and number of events of each run; in update mode a row again whenever it changes."""
    latest = F.max_by("status", F.struct("ts", "event_id"))
    return events.groupBy("run_id").agg(latest.alias("status"), F.count("*").alias("n"))


def terminal_marks(events: DataFrame) -> DataFrame:
    """(run_id, ts, event_id) of each run's first terminal event, by one aggregation with partial minima."""
    first = F.min(F.struct("ts", "event_id"))
    return events.filter(F.col("status").isin(*TERMINAL)).groupBy("run_id").agg(first.alias("_x")).select("run_id", "_x.ts", "_x.event_id")


def until_terminal(events: DataFrame, ended: DataFrame | None = None) -> DataFrame:
    """A run's events, by ts and event_id, up to and with the first terminal one; none of the runs in ``ended`` (run_id).

    Events meet their run's mark by a join, so a run with very many events is no task's burden. Null run ids have no mark
    and pass; repeated events pass as often.
    """
    marks = terminal_marks(events).select("run_id", F.struct("ts", "event_id").alias("_stop"))
    rows = events if ended is None else events.join(ended.select("run_id"), "run_id", "left_anti")
    met = rows.join(marks, "run_id", "left").filter(F.col("_stop").isNull() | (F.struct("ts", "event_id") <= F.col("_stop")))
    return met.select("run_id", "event_id", "status")


#: Characters of a text in a summary.
SUMMARY_CHARS = 200


def trace_summary(events: DataFrame) -> DataFrame:
    """(run_id, event_id, key, kind, summary): each top-level value of an event's JSON payload, by its type; stateless.

    Numbers, booleans and null are told as they are, texts up to 200 characters and an ellipsis, lists by the number of their
    items, objects by that of their keys. A payload that is null, no JSON, or no object has no rows.
    """
    spark = events.sparkSession
    rows = events.withColumn("_v", F.try_parse_json("payload")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    each = rows.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).withColumn("_t", F.schema_of_variant("value")).withColumn("_j", F.to_json("value"))
    kind = F.when(F.col("_t") == "VOID", "null").when(F.col("_t") == "STRING", "text").when(F.col("_t") == "BOOLEAN", "boolean").when(F.col("_t").startswith("ARRAY"), "list").when(F.col("_t").startswith("OBJECT"), "object").otherwise("number")
    text = F.try_variant_get("value", "$", "string")
    told = (
        F.when(kind == "text", F.when(F.length(text) > SUMMARY_CHARS, F.concat(text.substr(1, SUMMARY_CHARS), F.lit("…"))).otherwise(text))
        .when(kind == "list", F.concat(F.lit("["), F.json_array_length("_j").cast("string"), F.lit(" items]")))
        .when(kind == "object", F.concat(F.lit("{"), F.size(F.json_object_keys("_j")).cast("string"), F.lit(" keys}")))
        .otherwise(F.col("_j"))
    )
    return each.select("run_id", "event_id", "key", kind.alias("kind"), told.alias("summary"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A glob of the one table: the file source takes a folder or a pattern.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not path.endswith(".parquet") else path + "*")
    return stream.selectExpr(*PROJECTIONS["trace_events"][1]).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, name: str, each: Callable[[DataFrame, int], DataFrame] | None = None, path: str | None = None, log: str | None = None) -> DataFrame:
    """What a stream writes until its source is read up, each micro-batch written once by its number.

    ``each`` makes a micro-batch's rows from the batch and its number; a batch that is run again overwrites what it wrote.
    With ``path`` and ``log`` the stream goes on where an earlier one stopped.
    """
    spark = stream.sparkSession
    path, log = path or scratch(spark, name), log or scratch(spark, name + "-log")
    made: list[DataFrame] = []

    def write(batch: DataFrame, number: int) -> None:
        out = batch if each is None else each(batch, number)
        made[:] = [out]
        out.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/write={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    schema = stream.schema if each is None or not made else made[0].schema
    return spark.read.schema(schema.add("batch", "long")).parquet(path).drop("write")


def written_before(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    """The rows that micro-batches below ``number`` wrote under ``path``; none where there are no such yet."""
    rows = spark.createDataFrame([], schema) if number == 0 else spark.read.schema(f"{schema}, write long").parquet(path)
    return rows if number == 0 else rows.filter(F.col("write") < number).drop("write")


def runs_until_terminal(stream: DataFrame, name: str = "until", horizon: str = "7 days", path: str | None = None, log: str | None = None) -> DataFrame:
    """``until_terminal`` over a stream: of a run that ended in an earlier micro-batch nothing more passes.

    The ended runs are a table beside the output, which each micro-batch reads and adds its own to. Marks older than
    ``horizon`` before the newest event of a micro-batch are no longer looked at, so state doesn't grow for ever.
    """
    spark = stream.sparkSession
    marks = (path or scratch(spark, name)) + "-ended"
    path = path or marks.removesuffix("-ended")

    def each(batch: DataFrame, number: int) -> DataFrame:
        newest = batch.agg(F.max("ts").alias("_newest"))  # one row
        known = written_before(spark, marks, number, "run_id long, ts timestamp").join(F.broadcast(newest)).filter(F.col("_newest").isNull() | (F.col("ts") >= F.col("_newest") - F.expr(f"INTERVAL {horizon}"))).select("run_id", "ts")
        new = terminal_marks(batch).select("run_id", "ts").join(known.select("run_id"), "run_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{marks}/write={number}")
        return until_terminal(batch, known)

    return drained(stream, "append", name, each, path, log).drop("batch")


def index_append(stream: DataFrame, name: str = "index", path: str | None = None, log: str | None = None) -> DataFrame:
    """Rows of a stream by chunk_id, each id written once: a micro-batch leaves out what it repeats and what is in the table."""
    spark = stream.sparkSession
    path = path or scratch(spark, name)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)

    def each(batch: DataFrame, number: int) -> DataFrame:
        return batch.dropDuplicates(["chunk_id"]).join(written_before(spark, path, number, columns).select("chunk_id"), "chunk_id", "left_anti")

    return drained(stream, "append", name, each, path, log).drop("batch")


@query("stream_run_status", "SELECT run_id, arg_max(status, (ts, event_id)) AS status, count(*) AS n FROM trace_events GROUP BY run_id", "trace_events")
def _stream_run_status(t):
    out = drained(run_status(events_stream(t.spark, t.sf_dir)), "update", "status")
    return out.groupBy("run_id").agg(F.max_by(F.struct("status", "n"), "batch").alias("x")).select("run_id", "x.status", "x.n")


@query(
    "stream_until_terminal",
    ", o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS i FROM trace_events), f AS (SELECT run_id, min(i) AS stop FROM o WHERE status IN ('done','error','hitl','cancelled') GROUP BY run_id) SELECT run_id, event_id, status FROM o LEFT JOIN f USING (run_id) WHERE stop IS NULL OR i <= stop",
    "trace_events",
)
def _stream_until_terminal(t):
    return runs_until_terminal(events_stream(t.spark, t.sf_dir))


_PAYLOAD = (
    "concat('{\"props\": ', payload, ', \"tags\": [\"', agent, '\", \"', status, '\"], \"note\": \"', repeat(agent, CAST(1 + event_id % 60 AS INTEGER)), '\", \"flag\": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, "
    "', \"none\": null, \"n\": ', event_id, CASE WHEN event_id % 50 = 7 THEN '' ELSE '}' END)"
)


@query(
    "stream_trace_summary",
    f", p AS (SELECT run_id, event_id, CASE WHEN json_valid({_PAYLOAD}) THEN CAST({_PAYLOAD} AS JSON) END AS j FROM trace_events), k AS (SELECT run_id, event_id, j, unnest(json_keys(j)) AS key FROM p), v AS (SELECT *, json_extract(j, '$.' || key) AS v, json_type(j, '$.' || key) AS t FROM k) "
    "SELECT run_id, event_id, key, CASE t WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind, "
    "CASE t WHEN 'VARCHAR' THEN CASE WHEN length(v ->> '$') > 200 THEN left(v ->> '$', 200) || '…' ELSE v ->> '$' END WHEN 'ARRAY' THEN '[' || json_array_length(v) || ' items]' WHEN 'OBJECT' THEN '{' || len(json_keys(v)) || ' keys}' WHEN 'NULL' THEN 'null' ELSE CAST(v AS VARCHAR) END AS summary FROM v",
    "trace_events",
)
def _stream_trace_summary(t):
    events = events_stream(t.spark, t.sf_dir).withColumn("payload", F.expr(_PAYLOAD))
    return drained(events, "append", "summary", lambda batch, number: trace_summary(batch)).drop("batch")


@query("stream_index_append", "SELECT concat(doc_id, '#', pos) AS chunk_id, doc_id, pos FROM chunks", "chunks")
def _stream_index_append(t):
    """New documents become chunks in an index table; a chunk id is written once."""
    path = f"{t.sf_dir}/documents.parquet"
    docs = t.spark.readStream.schema(t.documents.schema).parquet(path + "*")
    return index_append(chunk(docs).select(F.concat("doc_id", F.lit("#"), "pos").alias("chunk_id"), "doc_id", "pos"))
