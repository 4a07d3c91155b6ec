"""Hand-computed cases and small models of what SQL doesn't cover."""

import math

from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import joins, profiles, retrieval, scoring, structure
from leafmill.sources import catalog


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


def test_score_by_hand(spark):
    f = spark.createDataFrame([(1, "major", "compliant", 1.0), (1, "critical", "non_compliant", 0.0), (2, "minor", "partial", None), (3, "minor", "not_applicable", 0.5)], "run_id long, severity string, status string, confidence double")
    got = {r.run_id: r.score for r in scoring.score_overall(f).collect()}
    assert got == {1: 0.5556, 2: 0.5, 3: 0.0}
    labels = {r.run_id: r.label for r in scoring.status_label(f).collect()}
    assert labels == {1: "failing", 2: "weak", 3: "n/a"}


def test_chunks_by_hand(spark):
    d = spark.createDataFrame([(1, "x" * 1000), (2, "y" * 650), (3, ""), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.pos, len(r.text)) for r in retrieval.chunk(d, 700, 80).collect())
    assert got == [(1, 0, 700), (1, 1, 380), (2, 0, 650), (2, 1, 30)]


def test_stems_versions_keys(spark):
    words = ["risks", "summaries", "classes", "phases", "glass", "testing"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(X.stem(F.col("w"))).collect()
    assert [r[0] for r in got] == ["risk", "summary", "class", "phase", "glass", "test"]
    assert one(spark, X.bump(F.lit("2.1"))) == "2.2" and one(spark, X.bump(F.lit("2"))) == "2.1" and one(spark, X.bump(F.lit("2.3.4"), True)) == "3.0.0"
    assert one(spark, X.version_parts(F.lit("1.10")) > X.version_parts(F.lit("1.9"))) and not one(spark, X.version_parts(F.lit("2")) > X.version_parts(F.lit("2.1")))
    assert one(spark, X.sort_key(F.lit("9.4.6"))) == "009.004.006"


def test_heading_levels_fold(spark):
    h = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 4, 2, 4])], "doc_id long, pos int, level int")
    assert structure.heading_level_normalize(h).first().levels == [1, 2, 2, 2]


def test_list_groups_by_hand(spark):
    items = [(1, 0, "bullet", 0), (1, 1, "bullet", 1), (1, 2, "bullet", 0), (1, 3, "number", 0)]
    got = structure.list_groups(spark.createDataFrame(items, "doc_id long, pos int, kind string, level int")).orderBy("pos").collect()
    assert [r.group_no for r in got] == [1, 1, 2, 3]


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta alpha"), (2, 0, "beta gamma"), (3, 0, "delta")], "doc_id long, pos long, text string")
    queries = spark.createDataFrame([(7, "alpha alpha")], "query_id long, text string")
    (r,) = retrieval.bm25(chunks, queries).collect()
    idf, tf, n, avg = math.log(3 - 1 + 0.5) - math.log(1.5), 2, 3, 2
    assert (r.doc_id, r.score) == (1, round(2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg)), 6))


def test_alignment_takes_the_first_best(spark):
    a = spark.createDataFrame([("g", "1", "study title"), ("g", "9", "safety"), ("g", None, "study"), ("g", "4.1", None)], "g string, no string, title string")
    b = spark.createDataFrame(
        [("g", 1, 5, "title page study name"), ("g", 1, 4, "title study"), ("g", 1, 6, "9.4 Methods"), ("g", 1, 7, "safety"), ("g", 1, 8, "4.10 x"), ("g", 1, 9, None), ("g", 2, 1, "4.1"), ("g", 2, 2, " "), ("h", 1, 1, "study title")],
        "g string, doc_id long, id long, heading string",
    )
    got = sorted((r.doc_id, r.no, r.id, r.score) for r in joins.align_sections(a, b).collect())
    assert got == [(1, "1", 4, 1.0), (1, "9", 6, 1.0), (2, "4.1", 1, 1.0)]
    assert joins.align_sections(a.limit(0), b).count() == 0


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 0, 1)], "id long, v string, batch int, pos int")
    new = spark.createDataFrame([(1, "c", 1, 0), (1, "d", 1, 1), (3, "e", 1, 2)], "id long, v string, batch int, pos int")
    assert {r.id: r.v for r in catalog.upsert(old, new).collect()} == {1: "d", 2: "b", 3: "e"}


def test_cosine_of_a_zero_vector(spark):
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_greedy_assignment_against_a_model(spark):
    from leafmill.operators import mapping

    rows = [("g", 1, 10), ("g", 1, 11), ("g", 2, 10), ("g", 3, 10), ("g", 3, 12), ("h", 1, 10), ("h", 2, 10)]
    used, want = set(), []
    for g, s in sorted({(g, s) for g, s, _ in rows}):
        free = [c for a, b, c in sorted(rows) if (a, b) == (g, s) and (g, c) not in used]
        if free:
            used.add((g, free[0]))
            want.append((g, s, free[0]))
    got = mapping.greedy_assign(spark.createDataFrame(rows, "g string, slot long, section long")).collect()
    assert sorted(map(tuple, got)) == want


def test_line_grouping_follows_the_moving_mean(spark):
    from leafmill.operators import mapping

    ys = [10.0, 11.0, 13.4, 15.0, 30.0]
    rows = spark.createDataFrame([(1, 1, i, float(i), y) for i, y in enumerate(ys)], "doc_id long, page int, ord int, x0 double, y1 double")
    got = {r.ord: r.line_no for r in mapping.line_grouping(rows).collect()}
    no, group, want = -1, [], {}
    for i, y in enumerate(ys):
        if not group or abs(y - sum(group) / len(group)) >= 3:
            no, group = no + 1, []
        group.append(y)
        want[i] = no
    assert got == want


def test_blocks_align_in_order(spark):
    from leafmill.operators import mapping

    old = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "d e f"), (1, 2, "g h i")], "doc_id long, pos int, line string")
    new = spark.createDataFrame([(1, 0, "d e x"), (1, 1, "g h i j")], "doc_id long, pos int, line string")
    assert sorted(map(tuple, mapping.block_align(old, new).collect())) == [(1, 1, 0), (1, 2, 1)]


def test_version_diff_counts_one_sided_lines(spark):
    from leafmill.operators import profiles

    old = ["title", "one two three four", "same", "same", "gone for good", "last line here", ""]
    new = ["a new start", "title", "same", "one two five four six", "last line here", "", "extra words"]
    frame = lambda lines: spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "kept")], "doc_id long, pos int, line string")
    got = profiles.version_diff(frame(old), frame(new).union(spark.createDataFrame([(3, 0, "only new")], "doc_id long, pos int, line string")))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(
        [(1, None, 0, 0, 0, 3), (1, None, 6, 0, 0, 2), (1, 1, 3, 3, 1, 2), (1, 3, None, 0, 1, 0), (1, 4, None, 0, 3, 0), (3, None, 0, 0, 0, 2)], key=key
    )


def test_version_diff_against_brute_force(spark):
    import random

    from leafmill.operators import profiles

    def common(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(5)
    olds, news, want = [], [], {}
    for doc in range(20):
        old = [[f"w{doc}_{i}_{k}" for k in range(rng.randint(4, 9))] for i in range(30)]
        new, sums = [], [0, 0, 0]
        for x in old:
            y = None if (r := rng.random()) < 0.2 else [*x[1:], "z"] if r < 0.4 else x
            if y is not x:
                k = common(x, y or [])
                sums = [sums[0] + k, sums[1] + len(x) - k, sums[2] + len(y or []) - k]
            new += [y] if y else []
            if rng.random() < 0.2:
                new.append([f"n{len(new)}", "added"])
                sums[2] += 2
        olds += [(doc, i, " ".join(x)) for i, x in enumerate(old)]
        news += [(doc, i, " ".join(x)) for i, x in enumerate(new)]
        want[doc] = tuple(sums)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, pos int, line string")
    got = profiles.version_diff(frame(olds), frame(news)).groupBy("doc_id").agg(F.sum("kept"), F.sum("deleted"), F.sum("inserted"))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_evidence_of_any_length_is_grounded(spark):
    import random
    import re

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.choice((2, 4, 6, 9, 14, 30, 70)))) for _ in range(60)]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice((3, 40, 400)))) for i in range(30)}
    texts |= {30: "", 31: "Short text, of five words!"}
    quotes = ["p. 12", "", "Short text of five words", "of five words and more"]
    for _ in range(200):
        t = texts[rng.randrange(30)]
        n = rng.choice((21, 22, 29, 30, 41, 42, 59, 60, 61, 90, 200))
        at = rng.randrange(max(1, len(t) - n))  # often inside a word
        part = t[at : at + n]
        quotes += [part, f"({part[:60].upper()} [...] missing tail words here that go on for a while and longer still)", "unheard of words that come first and run for more than sixty characters " + part]
    norm = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    want = set()
    for e, q in enumerate(map(norm, quotes)):
        if 0 < len(q) <= 20:
            want.add((e, None))
        elif q:
            want |= {(e, d) for d, t in texts.items() if q[:60].strip() in norm(t) or q[-60:].strip() in norm(t)}
    got = joins.evidence_grounding(spark.createDataFrame(list(enumerate(quotes)), "evidence_id long, quote string"), spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    # A head of 59 characters and a blank, of which the text holds the 59.
    head = " ".join(["nine char"] * 5) + " abcdefghi"
    assert len(head) == 59
    one = joins.evidence_grounding(spark.createDataFrame([(1, head + " and what the text lacks " + "z" * 60)], "evidence_id long, quote string"), spark.createDataFrame([(5, head + "x end")], "doc_id long, text string"))
    assert [tuple(r) for r in one.collect()] == [(1, 5)]


def test_every_slot_is_mapped_in_three_passes(spark):
    from leafmill.operators import mapping

    slots = [("t", 1, "1. Purpose", True), ("t", 2, "Scope", True), ("t", 3, "Scope", True), ("t", 4, "Roles", True), ("t", 5, "7. Other things", True), ("t", 6, "Risk summaries", True), ("t", 7, "Nothing alike", False), ("t", 8, "Budget", True), ("u", 1, "Alone", True)]
    sections = [("t", 10, "Purpose"), ("t", 11, "scope"), ("t", 12, "Responsibilities"), ("t", 13, "7. Appendix"), ("t", 14, "Summary of risks"), ("t", 15, "Closing words")]
    model = [("t", 4, 12, 1.5, "fill", 1), ("t", 4, 15, 0.5, "fill", 2), ("t", 8, 99, 0.9, "rewrite", 3), ("t", 1, 15, 0.9, "fill", 4), ("t", 77, 15, 0.9, "fill", 5)]
    got = mapping.map_slots(
        spark.createDataFrame(slots, "g string, id long, title string, required boolean"), spark.createDataFrame(sections, "g string, id long, title string"), spark.createDataFrame(model, "g string, slot long, section long, confidence double, action string, seq long")
    )
    rows = {(r.g, r.slot): (r.section, r.action) for r in got.collect()}
    assert rows == {
        ("t", 1): (10, "rewrite"), ("t", 2): (11, "rewrite"), ("t", 3): (None, "rag"), ("t", 4): (12, "fill"), ("t", 5): (13, "rewrite"),
        ("t", 6): (14, "rewrite"), ("t", 7): (None, "flag"), ("t", 8): (None, "rag"), ("u", 1): (None, "rag"),
    }
    assert {r.slot: r.confidence for r in got.filter("g = 't' AND slot IN (1, 2, 4, 5, 8)").collect()} == {1: 0.97, 2: 1.0, 4: 1.0, 5: 0.95, 8: 0.0}


def test_the_registered_mapping_covers_every_slot(spark, sf_dir):
    from leafmill.plans import all as plans

    got = plans.QUERIES["greedy_assign"](spark, sf_dir)
    assert got.count() == got.select("slot").distinct().count() == spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 2 = 0").count()


def test_retrieval_falls_back_where_no_vector_is_near(spark):
    vectors = spark.createDataFrame([(10, 0, [1.0, 0.0]), (11, 0, [0.9, 0.1]), (12, 0, [0.0, 1.0]), (13, 1, [1.0, 0.0])], "id long, collection int, vector array<double>")
    asked = spark.createDataFrame([(1, 0, [1.0, 0.05]), (2, 0, [-1.0, -1.0]), (3, 1, [0.0, 1.0])], "query_id long, collection int, query array<double>")
    chunks = spark.createDataFrame([(i, 0, x) for i, x in enumerate(["alpha beta", "beta gamma", "delta", "epsilon"])], "doc_id long, pos long, text string")
    queries = spark.createDataFrame([(1, "alpha"), (2, "gamma"), (3, "delta"), (4, "alpha")], "query_id long, text string")
    everything = retrieval.retrieval_fallback(vectors, asked, chunks, queries)
    assert {r.query_id: r.via for r in everything.collect()} == {1: "vector", 2: "vector", 3: "vector", 4: "bm25"}
    got = retrieval.retrieval_fallback(vectors, asked, chunks, queries, floor=0.5)
    assert sorted((r.query_id, r.via, r.rank, r.id) for r in got.collect()) == [(1, "vector", 1, 10), (1, "vector", 2, 11), (2, "bm25", 1, 1), (3, "bm25", 1, 2), (4, "bm25", 1, 0)]


def column_values(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text_functions_by_hand(spark):
    from leafmill.functions import text as X

    assert column_values(spark, ["using", "ring", "classes", "sses", "bases", "policies", "ties", "used", "bed", "its", "glass"], X.stem) == ["us", "ring", "classe", "sse", "base", "policy", "tie", "us", "bed", "it", "glas"][:0] + ["us", "ring", "class", "sse", "base", "policy", "tie", "used", "bed", "its", "glass"]
    assert column_values(spark, ["Page 9", "page  10", "A1b22", None], X.running_norm) == ["page #", "page #", "a#b#", None]
    pages = ["7", "Page 3 of 12", "12 - 30", "- 5 -", "xiv", "3/4", "mild", "chapter 1", "1" * 21, "page"]
    assert column_values(spark, pages, X.is_page_number) == [True, True, True, True, True, True, True, False, False, False]
    assert column_values(spark, ["2.3.4", "2", "v", "2.x.9", ""], X.bump) == ["2.3.5", "2.1", "v", "2.10", ""]
    assert column_values(spark, ["2.3.4", "2"], lambda v: X.bump(v, True)) == ["3.0.0", "3.0"]
    assert column_values(spark, ["1.10", "1.9", "10", "9.0", "1.0.0.0.0.0.0.1", "1"], X.version_parts) == [[1, 10], [1, 9], [10], [9], [1, 0, 0, 0, 0, 0, 0, 1], [1]]
    sizes = column_values(spark, ["0", "1023", "1024", "1280", "1048576", "5368709120"], lambda v: X.humanise(v.cast("long")))
    assert sizes == ["0 B", "1023 B", "1.0 KB", "1.3 KB", "1.0 MB", "5.0 GB"]


def test_slots_and_rewrites_meet(spark):
    from leafmill.operators.joins import slot_set_equal

    slots = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "template_id int, ord int")
    rewritten = spark.createDataFrame([(1, 0), (1, 0), (3, 5)], "template_id int, ord int")
    got = {r.template_id: (r.missing, r.surplus) for r in slot_set_equal(slots, rewritten).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (0, 1)}
    assert slot_set_equal(slots.limit(0), rewritten.limit(0)).count() == 0


def test_short_quotes_count_as_grounded(spark):
    from leafmill.operators.joins import evidence_grounding

    evidence = spark.createDataFrame([(1, "p. 5"), (2, "..."), (3, None), (4, "this sentence stands nowhere at all")], "evidence_id int, quote string")
    docs = spark.createDataFrame([(7, "some other text that is here"), (8, None)], "doc_id int, text string")
    assert [(r.evidence_id, r.doc_id) for r in evidence_grounding(evidence, docs).collect()] == [(1, None)]


def test_heading_scores_by_hand(spark):
    from leafmill.operators.layout import heading_score

    schema = "doc_id int, page int, ord int, size double, bold boolean, text string"
    rows = [(1, 1, 0, 10.0, False, "plain body text that most characters have"), (1, 1, 1, 16.0, True, "1.2 Scope"), (1, 1, 2, 11.5, False, "METHODS AND DATA"), (1, 1, 3, 10.0, True, " "), (1, 2, 4, 10.0, False, "Results"), (1, 2, 5, 10.0, False, None)]
    spans = spark.createDataFrame(rows, schema)
    outline = spark.createDataFrame([(1, 2, "Results  of the study")], "doc_id int, page int, title string")
    assert {r.ord: r.score for r in heading_score(spans).collect()} == {0: 0.0, 1: 0.95, 2: 0.55, 3: 0.0, 4: 0.0, 5: 0.0}
    assert {r.ord: r.score for r in heading_score(spans, outline).collect()}[4] == 0.8
    assert heading_score(spans.limit(0)).count() == 0


def test_layout_functions_by_hand(spark):
    from leafmill.functions import text as X

    assert column_values(spark, ["3.2.1 Scope", "A.1 Data", "1. Aim", "7", "Scope", None], X.numbering_depth)[:5] == [3, 2, 1, 0, 0]
    assert column_values(spark, ["1.8", "1.4", "1.2", "1.1"], lambda v: X.level_of_ratio(v.cast("double"))) == [1, 2, 3, 4]
    rows = spark.createDataFrame([(0, ["Name", "Unit", "n"]), (1, ["Name", ""]), (2, ["a", "b"]), (3, ["A", None]), (4, []), (5, ["X" * 61])], "i int, c array<string>")
    assert [r.h for r in rows.select("i", X.is_header_row(F.col("c")).alias("h")).orderBy("i").collect()] == [True, False, False, False, False, False]
    grid = spark.createDataFrame([([["a"], ["b", None, "c"], []],), ([],)], "g array<array<string>>")
    assert [r.p for r in grid.select(X.padded(F.col("g")).alias("p")).collect()] == [[["a", "", ""], ["b", "", "c"], ["", "", ""]], []]


def test_flat_export_takes_the_citation(spark, tmp_path):
    rows = spark.createDataFrame([("4", 'say "x",\nthen y', ("1.1", "q"))], "section_no string, evidence string, citation struct<guideline_section: string, quote: string>")
    catalog.findings_csv(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"', multiLine=True).collect()
    assert back[0].asDict() == {**dict.fromkeys(catalog.CSV_COLUMNS), "section": "4", "evidence": 'say "x",\nthen y', "citation_section": "1.1", "citation_quote": "q"}


def test_an_audit_reads_short_documents_whole_and_long_ones_by_chunks(spark):
    long = "alpha " * 200 + "beta " * 200 + "gamma " * 200
    docs = spark.createDataFrame([(1, "alpha"), (2, long), (3, ""), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "beta"), (8, "delta")], "query_id long, text string")
    got = {(r.doc_id, r.query_id): r.context for r in retrieval.audit_context(docs, queries, whole=1000, k=1).collect()}
    assert set(got) == {(1, None), (2, 7), (3, None)} and got[1, None] == "alpha" and got[3, None] == ""
    assert got[2, 7] in long and len(got[2, 7]) == 900 and "beta" in got[2, 7]


def test_coverage_counts_findings_and_aligned_headings(spark):
    findings = spark.createDataFrame([(1, "partial", "2.1"), (1, "non_compliant", "3"), (2, "compliant", None)], "run_id long, status string, section_no string")
    present = joins.present_sections(findings, spark.createDataFrame([(1, "4.2")], "run_id long, section_no string"))
    assert {tuple(r) for r in present.collect()} == {(1, "2"), (1, "4"), (2, "—")}
    guide = spark.createDataFrame([("g", n, "t") for n in ("2", "3", "4", "5.1", "A", None)], "g string, no string, title string")
    gaps = joins.section_coverage_gap(spark.createDataFrame([(1, "g"), (3, "h")], "run_id long, g string"), guide, present)
    assert [(r.run_id, r.section) for r in gaps.collect()] == [(1, "3")]


def test_slot_flags_by_hand(spark):
    long = "of course " * 7
    slots = spark.createDataFrame(
        [(1, 1, "A", True, ["x"], " "), (1, 2, "B", True, None, "[todo: of"), (1, 3, "C", False, ["Zeta", "Course"], long), (1, 4, "D", False, ["zeta"], long), (1, 5, "E", False, [], "of"), (1, 6, "F", False, None, None)],
        "template_id int, ord int, title string, required boolean, keywords array<string>, body string",
    )
    got = sorted((r.ord, r.kind, r.note) for r in profiles.slot_flags(slots, ["Must include: of"]).collect())
    assert got == [
        (1, "format", "Format rule violated: Must include: of"), (1, "missing", "Required section 'A' is empty."), (2, "format", "Section 'B' is a TODO placeholder."),
        (4, "format", "Section 'D' does not mention any expected keyword."), (5, "length", "Section 'E' is suspiciously short (2 chars)."), (6, "format", "Format rule violated: Must include: of"),
    ]


def test_references_styles_and_scores_by_hand(spark):
    from leafmill.operators import mapping

    docs = spark.createDataFrame([(1, "g", "see 16.1.1"), (2, "g", "see 16x1x1"), (3, "g", None)], "doc_id long, g string, text string")
    got = mapping.det_cross_reference(docs, spark.createDataFrame([("g", "16.1.1"), ("g", "")], "g string, target string"))
    assert sorted((r.doc_id, r.target) for r in got.filter("status = 'compliant'").collect()) == [(1, "16.1.1")] and got.count() == 6
    styles = spark.createDataFrame([(1, 2, "Heading 1"), (1, 1, "Body"), (2, 1, "Body")], "doc_id long, n int, style string")
    elements = spark.createDataFrame([(1, 1, True, "Title"), (1, 2, False, None), (1, 3, True, "Body"), (2, 1, True, "Title"), (3, 1, True, "Title")], "doc_id long, ord int, heading boolean, ref string")
    assert [r.style for r in joins.style_ref_remap(elements, styles).orderBy("doc_id", "ord").collect()] == ["Heading 1", "Body", "Body", "Body", None]
    runs = spark.createDataFrame([(1, None, 4, 1), (2, 0.9, 4, 4), (3, None, 0, 0)], "run_id long, score double, required_total int, missing int")
    flags = spark.createDataFrame([(1, "missing"), (1, "length"), (1, "guidance"), (1, None)], "run_id long, kind string")
    assert [tuple(r) for r in mapping.legacy_result(runs, flags).orderBy("run_id").collect()] == [(1, 0.75, 1, 0, 2, 1), (2, 0.9, 0, 0, 0, 0), (3, 0.0, 0, 0, 0, 0)]
    sections = spark.createDataFrame([(1, 0, "no"), (1, 1, "blood of mice"), (1, 2, "mice blood"), (2, 0, None), (2, 1, "x")], "doc_id long, pos int, text string")
    asked = spark.createDataFrame([(1, "Blood of mice"), (2, "of")], "doc_id long, query string")
    assert sorted(tuple(r) for r in profiles.best_section(sections, asked).collect()) == [(1, 1, 2), (2, 0, 0)]


def test_corpus_scan_lists_and_reads_in_tasks(spark, tmp_path):
    from leafmill.sources.catalog import corpus_scan, corpus_store

    texts = {0: "", 1: "a\nb\r\n", 2: "é €", 3: None}
    folder = str(tmp_path / "corpus")
    assert corpus_store(spark.createDataFrame([*texts.items(), (1, "a\nb\r\n")], "doc_id long, text string"), folder) == 4
    (tmp_path / "corpus" / "x" / "y").mkdir(parents=True)
    (tmp_path / "corpus" / "x" / "y" / "deep.txt").write_text("deep")
    (tmp_path / "corpus" / "top.txt").write_text("top")
    (tmp_path / "corpus" / "top.md").write_text("not a text file")
    found = corpus_scan(spark, folder)
    assert not any("Listing" in line or "FileScan" in line for line in found._jdf.queryExecution().toString().splitlines())
    got = sorted((r.doc_id.rpartition("/")[2].partition("-")[0], r.text) for r in found.collect())
    assert got == sorted([("0", ""), ("1", "a\nb\r\n"), ("1", "a\nb\r\n"), ("2", "é €"), ("deep.txt", "deep"), ("top.txt", "top")])
    assert {"top.txt", "x/y/deep.txt"} <= {r.doc_id for r in found.collect()}
