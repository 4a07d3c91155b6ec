"""Rows are dealt once, narrow, and to a number of tasks that stays."""

from pyspark.sql import functions as F

from leafmill.operators import joins


def test_headings_are_dealt_by_document_and_equal_texts_scored_once(spark):
    guideline = spark.createDataFrame([("a", "1", "Scope of work"), ("a", "1.2", "Aims"), ("b", "1", "Scope")], "g string, no string, title string")
    headings = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS g", "id DIV 2 AS doc_id", "id", "CASE WHEN id % 2 = 0 THEN '1.2 Scope' ELSE 'scope work' END AS heading")
    got = joins.align_sections(guideline, headings)
    rows = got.collect()
    assert len(rows) == len({(r.g, r.doc_id, r.no) for r in rows})
    assert sorted((r.g, r.no, r.id, r.score) for r in rows if r.doc_id < 2) == [("a", "1", 1, 1.0), ("a", "1", 2, 1.0), ("a", "1.2", 2, 1.0), ("b", "1", 0, 1.0), ("b", "1", 3, 1.0)]
    plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_slots_and_rewrites_are_dealt_once(spark):
    slots = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (3, 5)], "template_id long, ord long")
    made = spark.createDataFrame([(1, 0), (1, 0), (1, 7), (2, 0), (4, 1)], "template_id long, ord long")
    got = joins.slot_set_equal(slots, made)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 2), (2, 0, 0), (3, 1, 0), (4, 0, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_a_rationale_may_be_made_after_the_join(spark):
    findings = spark.createDataFrame([(1, "partial", 0.5, "t"), (2, "partial", 0.9, None)], "finding_id int, status string, confidence double, title string")
    second = spark.createDataFrame([(1, "not_applicable", None)], "finding_id int, second string, grounded boolean")
    why = F.repeat("title", F.lit(3))
    got = joins.verdict_overturn(findings, second, why)
    plain = joins.verdict_overturn(findings.withColumn("rationale", why), second)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) == [(1, "not_applicable", 0.8, "ttt" + joins.CORRECTED), (2, "partial", 0.9, None)]
