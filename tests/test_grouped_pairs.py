"""Operators on pairs that compare groups of equal rows once, and give what the pairs themselves give."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from leafmill.operators import joins, mapping
from leafmill.plans import all as plans
from leafmill.plans.tables import Tables


def test_a_slot_takes_its_smallest_heading_match(spark):
    slots = spark.createDataFrame([(1, 10, "1. Scope"), (1, 11, "scope"), (1, 12, ""), (2, 13, "Scope"), (1, 14, "2. Aims")], "g long, id long, title string")
    sections = spark.createDataFrame([(1, 7, "Scope"), (1, 5, "3. scope"), (1, 3, "1. Scope"), (1, 2, " "), (2, 1, "Aims")], "g long, id long, title string")
    got = mapping.first_heading_match(slots, sections)
    pairs = mapping.heading_matches(slots, sections).groupBy("g", "slot").agg(F.min("section").alias("section"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) == [(1, 10, 3), (1, 11, 3)]


def test_headings_are_matched_one_to_one_and_an_earlier_slot_takes_what_a_later_one_would(spark, sf_dir):
    frame = lambda rows: spark.createDataFrame(rows, "g long, id long, title string")
    slots = frame([(1, 12, "1. Scope"), (1, 10, "1. scope"), (1, 14, "2. Scope"), (1, 16, "Scope"), (1, 18, "4. Scope"), (1, 20, ""), (2, 22, "Aims"), (1, 24, None), (None, 26, "Aims")])
    sections = frame([(1, 3, "1. Scope"), (1, 5, "2.  Scope"), (1, 7, "scope"), (1, 1, " "), (2, 9, "3. Aims"), (2, 11, "Aims"), (None, 13, "Aims")])
    got = mapping.heading_exact_match(slots.repartition(3), sections.repartition(2))
    assert sorted(map(tuple, got.collect())) == [(1, 10, 3, 1.0), (1, 12, 5, 0.97), (1, 14, 7, 0.97), (2, 22, 11, 1.0)]
    both = slots.filter("id < 15")
    assert mapping.heading_exact_match(both.filter("id > 12"), both.filter("id <= 12")).collect() == [(1, 14, 10, 0.97)]
    rows = plans.QUERIES["heading_exact_match"](spark, sf_dir).collect()
    assert len(rows) == len({r.slot for r in rows}) == len({r.section for r in rows}) > 0


def test_only_one_line_a_number_meets_requirements(spark):
    lines = spark.createDataFrame([(1, 0, "1.2 A"), (1, 3, "1.2 B"), (1, 1, "4 C"), (2, 9, "4. D"), (2, 2, "text"), (2, 5, None)], "doc_id long, pos int, line string")
    requirements = spark.createDataFrame([(1, "1.2"), (1, "1.2"), (2, "4"), (3, "4"), (3, "1.2"), (4, None)], "requirement_id long, section_no string")
    got = mapping.section_number_match(lines, requirements)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 0.95), (1, 2, 1, 0.95), (1, 3, 0, 0.95), (2, 2, 9, 0.95), (2, 3, 9, 0.95)]


def test_rows_of_a_requirement_and_a_block_of_documents_stand_together(spark, tmp_path):
    lines = spark.range(2000).selectExpr("id * 7919 % 100003 AS doc_id", "CAST(id % 5 AS INT) AS pos", "concat('1.', id % 5, ' Scope') AS line")
    requirements = spark.range(50).selectExpr("id * 37 AS requirement_id", "concat('1.', id % 5) AS section_no")
    mapping.section_number_match(lines, requirements).write.parquet(str(tmp_path / "rows"))
    files = [pq.ParquetFile(f).read() for f in (tmp_path / "rows").glob("*.parquet")]
    ids = [f["requirement_id"].to_pylist() for f in files]
    assert sum(map(len, ids)) == len({(r, d) for f, x in zip(files, ids) for r, d in zip(x, f["doc_id"].to_pylist())}) == 2000 * 10
    assert sum(a != b for x in ids for a, b in zip(x, x[1:])) <= 200


def test_blocks_of_documents_change_no_row(spark, monkeypatch):
    lines = spark.range(60).selectExpr("id AS doc_id", "CAST(id % 5 AS INT) AS pos", "concat('1.', id % 2, ' Scope') AS line")
    requirements = spark.range(9).selectExpr("id AS requirement_id", "concat('1.', id % 3) AS section_no")
    rows = lambda: sorted(map(tuple, mapping.section_number_match(lines, requirements).collect()))
    want = rows()
    monkeypatch.setattr(mapping, "NUMBERED_DOCUMENTS", 7)
    assert rows() == want and len(want) == 60 * 3


def test_copies_of_slots_and_sections_are_compared_once(spark):
    items = [(1, i, t) for i, t in enumerate([["a", "b"], ["b", "a"], ["a", "b"], ["a", "c"], ["c"], [], ["d"], ["a", "b", "b"]])] + [(2, 20, ["a"]), (2, 21, ["a"]), (None, 22, ["a"])]
    items = spark.createDataFrame(items, "g long, id long, tokens array<string>")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    slots, sections = [0, 1, 5, 6, 20, 22, 99], [2, 3, 4, 7, 21]
    got = {r.slot: (r.section, r.score, r.action) for r in mapping.tfidf_slot_match(items, ids(*slots), ids(*sections)).collect()}
    pairs = spark.createDataFrame([(a, b) for a in (0, 1, 5, 6) for b in (2, 3, 4, 7)] + [(20, 21)], "a long, b long")
    plain = {}
    for r in mapping.tfidf_cosine(items, pairs).collect():
        plain[r.a] = max(plain.get(r.a, (0.0, 0)), (r.score, -r.b))
    assert got == {s: ((-plain[s][1], round(plain[s][0], 3), "rewrite") if s in plain else (None, 0.0, "rag")) for s in slots}
    assert got[0] == (2, 1.0, "rewrite") and set(plain) == {0, 1, 20}
    many = spark.range(4000).select(F.lit(1).alias("g"), "id", F.array(F.lit("a"), F.concat(F.lit("w"), F.col("id") % 3)).alias("tokens"))
    found = mapping.tfidf_slot_match(many, many.filter("id % 2 = 0").select("id"), many.filter("id % 2 = 1").select("id"))
    assert [tuple(r) for r in found.groupBy("section", "score").count().orderBy("section").collect()] == [(1, 1.0, 666), (3, 1.0, 667), (5, 1.0, 667)]


def test_pairs_of_copies_score_as_the_items_do(spark):
    titles = [(1, 1, ["a", "b"]), (1, 2, ["b", "a"]), (1, 3, ["a", "c", "c"]), (1, 4, ["c"]), (1, 5, []), (1, 6, ["a", "b"]), (2, 7, ["a", "b"]), (2, 8, ["a"]), (None, 9, ["a"]), (None, 10, ["a"]), (1, 11, None)]
    items = spark.createDataFrame(titles, "g long, id long, tokens array<string>")
    group = {i: g for g, i, _ in titles}
    every = [(a, b) for a in range(1, 13) for b in range(1, 13)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = sorted(map(tuple, joins.tfidf_cosine_of_copies(items, frame(every)).collect()))
    plain = joins.tfidf_cosine(items, frame([(a, b) for a, b in every if group.get(a) is not None and group[a] == group.get(b)]))
    assert got == sorted(map(tuple, plain.collect())) and (1, 2, 1.0) in got and (7, 8) in {x[:2] for x in got}


def test_pairs_keep_their_number_of_tasks_and_no_item_is_broadcast_to_them(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tasks = joins.PAIR_TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert joins.neighbours(t).rdd.getNumPartitions() == tasks
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "a long, b long")
    items = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["a", "b"])], "g long, id long, tokens array<string>")
    plan = joins.tfidf_cosine_of_copies(items, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan
    assert joins.tfidf_cosine_of_copies(items, pairs).count() == 2
