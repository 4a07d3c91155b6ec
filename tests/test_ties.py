"""Rows that an order leaves equal come in the order of their table."""

from leafmill.operators import audits, joins
from leafmill.plans.tables import Tables


def _stored(spark, tmp_path, rows, schema):
    """Rows as files of one table, each row a file, written so that the last rows are the first to be read."""
    for i, row in enumerate(rows):
        n = 2000 if i else 1
        spark.createDataFrame([row] * n, schema).coalesce(1).write.parquet(str(tmp_path / f"x{i}"))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"x{i}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{i:04}.parquet")
    return Tables(spark, str(tmp_path))


def test_of_equal_answers_the_first_of_the_table_counts(spark, tmp_path):
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double"
    t = _stored(spark, tmp_path, [(7, 31, 1, 2, 0.01), (7, 61, 2, 2, 0.02), (7, 91, 3, 2, 0.03)], schema)
    spark.createDataFrame([(7, 5)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    slots = spark.createDataFrame([(5, 1)], "template_id long, ord long")
    assert [tuple(r) for r in joins.mapping_validate(joins._model_mappings(t).repartition(7), slots).collect()] == [(5, 1, 1, 0.1, "rewrite")]
    model = spark.createDataFrame([(5, 1, 0, 0.5, 1, 9), (5, 1, 2, 0.5, 1, 3)], "template_id long, ord long, idx long, confidence double, seq long, place long")
    assert joins.mapping_validate(model, slots).first().idx == 2


def test_equal_findings_of_a_digest_come_in_the_order_of_the_table(spark):
    rows = [(1, f"{n}.1", "major", n) for n in (4, 2, 9, 7)]
    findings = spark.createDataFrame(rows, "run_id long, section_no string, severity string, place long").selectExpr(
        "*", "1 AS ord", "'1-1' AS finding_id", "'t' AS requirement_title", "'style' AS dimension", "'partial' AS status", "0.5D AS confidence", "'' AS suggested_fix"
    )
    digest = audits.audit_digest(findings.repartition(3)).first().digest
    assert [line[3:6] for line in digest.splitlines() if line.startswith("- [")] == ["2.1", "4.1", "7.1", "9.1"]
