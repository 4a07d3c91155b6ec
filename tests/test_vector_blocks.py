"""Vector search in blocks gives what all pairs of a query and a vector give, and makes no row a pair."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import retrieval
from leafmill.plans.tables import Tables

VECTORS = "id long, collection int, vector array<float>"


def _pairs(vectors, queries, k):
    """Every pair of one collection scored by the column function."""
    met = queries.join(vectors, "collection").select("query_id", "id", F.round(retrieval.cosine(F.col("query"), F.col("vector")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return sorted(map(tuple, met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).collect()))


def test_blocks_give_what_pairs_give(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(7)]) for i in range(400)]
    rows += [(400 + i, i % 3, rows[i % 9][2]) for i in range(120)] + [(520 + i, 0, [float(rng.randint(-1, 1)) for _ in range(7)]) for i in range(60)]
    rows += [(600, 0, None), (601, 0, [0.0] * 7), (602, 1, []), (603, 1, [None] + [1.0] * 6), (604, 4, [1.0, 2.0]), (605, 4, [1.0, 2.0, 3.0]), (606, None, [1.0] * 7), (607, 5, [1.0] * 7)]
    vectors = spark.createDataFrame(rows, VECTORS)
    queries = vectors.filter("id % 4 = 0").selectExpr("id AS query_id", "collection", "vector AS query")
    want = _pairs(vectors, queries, 5)
    assert {r[0] for r in want} >= {0, 400, 520, 600, 604} and any(r[2] is None for r in want)
    for components in (1 << 18, 300, 40):
        monkeypatch.setattr(retrieval, "BLOCK_COMPONENTS", components)
        assert sorted(map(tuple, retrieval.vector_search(vectors, queries, 5).collect())) == want
    assert retrieval.vector_search(vectors, queries.limit(0)).count() == 0


def test_no_pair_of_a_query_and_a_vector_is_a_row(spark, sf_dir):
    t = Tables(spark, sf_dir)
    plan = retrieval.vector_search(t.hits, retrieval._asked(t))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
