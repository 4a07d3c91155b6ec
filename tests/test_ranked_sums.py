"""Sums of BM25: terms are counted where their chunk is, and a task adds up a bounded number of chunks."""

from collections import Counter

from leafmill.operators import retrieval


def test_terms_are_counted_in_their_row(spark):
    rows = [(1, sorted("b a b c a b".split())), (2, []), (3, ["x"]), (4, None), (5, ["é", "é"])]
    got = retrieval.counted_terms(spark.createDataFrame(rows, "c long, w array<string>"), "c").collect()
    assert Counter((r.c, r.term, r.tf) for r in got) == Counter((c, t, n) for c, w in rows for t, n in Counter(w or []).items())


def test_a_task_adds_up_a_bounded_number_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNKS_A_TASK", 10)
    chunks = spark.range(95).selectExpr("id AS doc_id", "0L AS pos", "concat('alpha beta', id % 5, ' gamma', id) AS text")
    queries = spark.createDataFrame([(1, "alpha beta1 beta2"), (2, "gamma3 beta3")], "query_id long, text string")
    postings, terms, n = retrieval._postings(chunks, queries)
    sums = retrieval._added(postings, terms, n)
    assert n == 95 and sums.rdd.getNumPartitions() == 10
    assert sums.count() == 95 + 19 and "SortMergeJoin" not in retrieval.bm25(chunks, queries, None)._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in retrieval.bm25(chunks, queries, 2).orderBy("query_id", "rank").collect()] == [1, 2, 3, 8]
