"""Connected components of a graph whose edges and labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
    return both.join(least, F.col("a") == F.col("_a")).filter("b > a AND b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), "_m")
    moved = down.join(least, F.col("a") == F.col("_a")).filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.union(least.select("_a", "_m")).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one orderable type); component = its smallest node.

    Large-star and small-star steps alternate until the edges are stars around each component's smallest node. Minima
    are aggregated on the map side and joins carry plain pairs; a node's edges meet in one task, as the join reuses the
    partitioning of the aggregation, which AQE doesn't split. Each round is written to the shared folder, which cuts the lineage. Self-loops, repeated edges and both
    directions of an edge are allowed; rows with a null end are ignored; an empty table gives an empty result.
    """
    # The edges may be costly to compute: they are written before anything reads them twice.
    own = written(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), name)
    loops = own.filter("a = b")
    now = own.filter("a <> b")
    mark = _mark(now)
    while mark[0]:
        now = written(_small_star(_large_star(now)), name)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
