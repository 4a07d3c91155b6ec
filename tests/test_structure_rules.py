"""Running lines, heading scores, nested lists, slots, contents, tables and what rewrites keep: cases worked out by hand."""

import random

from pyspark.sql import functions as F

from leafmill.operators import grids, layout, outline, rewrites

LINES = "doc_id long, page int, ord int, y0 double, y1 double, text string"


def test_running_lines_stand_in_margins_of_half_the_pages(spark):
    rows, n = [], 0
    for page in range(1, 9):
        texts = [(10.0, "Study 7  Page " + str(page)), (400.0, "A body line that repeats"), (400.0, "12"), (780.0, "Draft" if page <= 4 else "Final"), (790.0, f"{page} of 8"), (785.0, None)]
        if page < 4:
            texts.append((12.0, "Only on three pages"))
        for y, text in texts:
            rows.append((1, page, n, y, y + 10, text))
            n += 1
    rows += [(2, p, 900 + p, 5.0, 9.0, "Header") for p in (1, 2)]  # two pages have no running line
    rows += [(3, p, 950 + p, 5.0, 9.0, "Header") for p in (1, 2, 3)]
    pages = spark.createDataFrame([(1, p, 800.0) for p in range(1, 9)] + [(2, 1, 800.0), (2, 2, 800.0)] + [(3, p, None if p == 1 else 800.0) for p in range(1, 8)], "doc_id long, page int, height double")
    lines = spark.createDataFrame(rows, LINES)
    got = {(r.doc_id, r.norm): r.pages for r in layout.repeated_lines(lines, pages).collect()}
    # A page without a height is all margin. Doc 1: half of 8 pages is 4; doc 3: three of seven.
    assert got == {(1, "study # page #"): 8, (1, "draft"): 4, (1, "final"): 4, (1, "# of #"): 8, (3, "header"): 3}
    kept = [r.text for r in layout.running_line_strip(lines, pages).filter("doc_id = 1").collect()]
    assert sorted(map(str, kept)) == sorted(["A body line that repeats"] * 8 + ["12"] * 8 + ["None"] * 8 + ["Only on three pages"] * 3)
    assert layout.repeated_lines(lines.limit(0), pages).count() == 0
    assert {r.height for r in layout.page_heights(lines.filter("doc_id = 1")).collect()} == {800.0}


def test_larger_sizes_score_alike_and_name_levels(spark):
    sizes = [11.0] * 3 + [18.0, 12.0, 30.0, 28.0, 26.0, 24.0, 12.65]
    rows = [(1, 1, i, s, False, "some plain text, that goes on for a while in the body" if s == 11 else "a title, here") for i, s in enumerate(sizes)]
    got = {r.ord: (r.score, r.level) for r in layout.heading_score(spark.createDataFrame(rows, "doc_id int, page int, ord int, size double, bold boolean, text string")).collect()}
    assert got[0] == (0.0, 0) and got[5] == (0.4, 1) and got[6] == (0.4, 2) and got[3] == (0.4, 5)
    # The seventh and eighth largest are judged by their ratio: 12.6 / 11 is 1.145 and 12 / 11 less.
    assert got[9] == (0.4, 6) and got[4] == (0.0, 0)


def test_levels_follow_the_first_sign(spark):
    rows = [(1, 1, 0, 10.0, False, "body text of the page"), (1, 1, 1, 10.0, True, "Bold only"), (1, 1, 2, 10.0, True, "2.1.3.4 Deep number"), (1, 1, 3, 10.0, True, "2.1 Number"), (1, 1, 4, 10.0, False, "UPPER ONLY"), (1, 1, 5, 10.0, False, "Listed")]
    spans = spark.createDataFrame(rows, "doc_id int, page int, ord int, size double, bold boolean, text string")
    contents = spark.createDataFrame([(1, 1, "listed", 4), (1, 1, "listed in part", 2)], "doc_id int, page int, title string, level int")
    got = {r.ord: (r.score, r.level) for r in layout.heading_score(spans, contents).collect()}
    assert got == {0: (0.0, 0), 1: (0.25, 3), 2: (0.55, 3), 3: (0.55, 2), 4: (0.15, 1), 5: (0.8, 4)}
    assert sorted((r.ord, r.level) for r in layout.headings(spans, contents).collect()) == [(2, 3), (3, 2), (5, 4)]


def test_numbers_and_letters():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.range(0, 4000).select("id", outline.roman(F.col("id")).alias("r"), outline.letters(F.col("id")).alias("l")).collect()
    worth = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    for r in rows:
        values = [worth[c] for c in r.r]
        assert sum(v if v >= max(values[i:]) else -v for i, v in enumerate(values)) == r.id
        assert sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(r.l))) == r.id
    assert (rows[4].r, rows[9].r, rows[1994].r, rows[27].l, rows[702].l) == ("IV", "IX", "MCMXCIV", "AA", "ZZ")


def test_nested_lists_against_a_fold(spark):
    draw, rows, want = random.Random(7), [], {}
    for doc in range(12):
        counters, last = {}, None
        for pos in range(60):
            kind, level = draw.choice(["number"] * 6 + ["bullet", "heading", None]), draw.choice([0, 0, 1, 2, 3, None, 12])
            rows.append((doc, pos, kind, level, "lowerLetter"))
            at = min(8, level or 0)
            if kind == "number":
                if last != "number":
                    counters = {}
                counters = {k: v for k, v in counters.items() if k <= at}
                counters[at] = counters.get(at, 0) + 1
                want[doc, pos] = (counters[at], "  " * at)
            elif kind == "bullet":
                want[doc, pos] = (None, "  " * at + "-")
            else:
                counters = {}
            last = kind
    got = {(r.doc_id, r.pos): r for r in outline.list_numbering(spark.createDataFrame(rows, "doc_id int, pos int, kind string, level int, format string")).collect()}
    assert set(got) == set(want)
    for k, (n, head) in want.items():
        assert got[k].number == n and got[k].marker.startswith(head) and (n is not None or got[k].marker == head)
    one = spark.createDataFrame([(1, i, "number", 0, f) for i, f in enumerate(("upperRoman", "lowerRoman", "decimal", "upperLetter", None))], "doc_id int, pos int, kind string, level int, format string")
    assert [r.marker for r in outline.list_numbering(one).orderBy("pos").collect()] == ["I.", "ii.", "3.", "D.", "5."]


def test_identifiers_that_are_taken(spark):
    titles = ["A", "A", "A 2", "--", "A", "slot 4", "slot_4"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(titles)], "g int, ord int, title string").withColumn("base", outline.slot_base(F.col("title"), F.col("ord")))
    got = [r.slot_id for r in outline.unused_ids(rows, "g").orderBy("ord").collect()]
    assert got == ["a", "a_2", "a_2_2", "slot_3", "a_3", "slot_4", "slot_4_2"]


def test_slots_of_headings(spark):
    rows = [
        (1, 0, None, "{{ before }} text"), (1, 1, 1, "The Title {{ own }}"), (1, 2, 2, "Part two"), (1, 3, None, "x {{ first }}"), (1, 4, None, "{{second}} {{ third }}"), (1, 5, 2, "1. Part two"), (1, 6, 2, "  "),
        (2, 0, 1, "Cover"), (2, 1, 1, "1.2 Scope"), (2, 2, 1, "Cover"), (3, 0, None, "no heading {{ x }}"), (4, 0, 1, "Cover {{ m }}"), (4, 1, 1, "1 Scope"), (5, 0, 1, None),
    ]
    got = outline.heading_slots(spark.createDataFrame(rows, "doc_id int, pos int, level int, text string")).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.ord, r.slot_id, r.marker) for r in got] == [
        (1, 1, "the_title_own", "{{ before }}"), (1, 2, "part_two", "{{second}}"), (1, 3, "1_part_two", None), (2, 2, "1_2_scope", None), (2, 3, "cover_2", None), (4, 1, "cover_m", "{{ m }}"), (4, 2, "1_scope", None),
    ]
    assert got[0].keywords == ["title"]


def test_contents_and_sections(spark):
    toc = "Contents\nRUNNING HEADER\n1. Introduction ..... 3\n2 Methods of\nthe study .... 4\n2.1 Blinding ... 5\n2.1 Blinding again ... 6\n3 Annex things ... 7\n4 Never found ... 8"
    body = "1 Introduction\nText about 2 methods OF the study in prose.\n 17 \n2. Methods of the study\nrunning header\nMore.\n2.1  Blinding\nEnd"
    pages = spark.createDataFrame([(1, 1, "cover"), (1, 2, toc), (1, 3, body), (2, 1, "1 One .. 2"), (3, 1, None)], "doc_id int, page int, text string")
    got = outline.segment_sections(pages, "running header").orderBy("n").collect()
    assert [(r.n, r.section_no, r.title, r.page, r.level) for r in got] == [(1, "1", "Introduction", 3, 1), (2, "2", "Methods of the study", 4, 1), (3, "2.1", "Blinding", 5, 2), (4, "4", "Never found", 8, 1)]
    # A title in prose is found where it comes first: entries are looked for in order, each behind the last.
    assert [r.text for r in got] == ["1 Introduction Text about", "2 methods OF the study in prose. 2. Methods of the study More.", "2.1 Blinding End", ""]
    assert got[3].start is None and outline.parse_toc(pages.limit(0)).count() == 0


def test_tables_with_ragged_rows(spark):
    texts = ["| a | b | c |", "| 1 | 2", "|x|y|z|w|", "plain", "a | b", "", "c | d", "e\tf", "g\t\th", "i\tj", "k|l|m|n|o|p", "q|r", "s | t | u", None]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "doc_id int, pos int, line string")
    got = {(r.first_pos, r.last_pos): r.grid for r in grids.table_blocks(lines).collect()}
    assert got == {(0, 2): [["a", "b", "c", ""], ["1", "2", "", ""], ["x", "y", "z", "w"]], (7, 9): [["e", "f", ""], ["g", "", "h"], ["i", "j", ""]], (11, 12): [["q", "r", ""], ["s", "t", "u"]]}
    assert (0, 2) not in {(r.first_pos, r.last_pos) for r in grids.table_blocks(lines, F.col("pos") == 0).collect()}
    (r,) = spark.createDataFrame([([["a", "b\nc"], ["", None]],)], "g array<array<string>>").select(grids.markdown(F.col("g")).alias("m")).collect()
    assert r.m == "| a | b c |\n|  |  |"


def test_label_and_value_blocks(spark):
    texts = ["Version: 1", "", "Date: today", "", "", "Author : me", "Title: x", "no label", *[f"F{i}x: {i}" for i in range(6)], "stop", *[f"G{i}x: {i}" for i in range(7)], None, "A: too short"]
    lines = spark.createDataFrame([(1, i, x, True) for i, x in enumerate(texts)], "doc_id int, pos int, line string, eligible boolean")
    got = {r.first_pos: r.grid for r in grids.metadata_kv_tables(lines).collect()}
    assert got == {0: [["Version", "Date"], ["1", "today"]], 5: [["Author", "Title"], ["me", "x"]], 8: [["Field", "Value"], *[[f"F{i}x", str(i)] for i in range(6)]]}


def column(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(make(*map(F.col, names)).alias("x")).first().x


def test_lost_list_markers_come_back(spark):
    restore = lambda old, new: column(spark, rewrites.restore_list, old, new)
    assert restore("Intro\n- a\n- b", "Start here\n  one\n\nmore:\n* two\nthree") == "Start here\n  - one\n\nmore:\n* two\n- three"
    assert restore("1. a\n2) b\n- c", "one\ntwo\n3. kept\nthree") == "1. one\n2. two\n3. kept\n3. three"
    assert restore("- only one\nprose", "one\ntwo") == "one\ntwo"
    assert restore(None, "x") == "x" and restore("- a\n- b", None) == "" and restore("- a\n- b", "- a\n- b") == "- a\n- b"


def test_tables_survive_a_rewrite(spark):
    text = "a\n| x | y |\n | 1 | 2 | \nb\n|z|\n"
    (p,) = spark.createDataFrame([(text,)], "t string").select(rewrites.protect_tables(F.col("t")).alias("p")).collect()
    assert (p.p.text, p.p.blocks) == ("a\n[[TABLE_1]]\nb\n[[TABLE_2]]\n", ["| x | y |\n| 1 | 2 |", "|z|"])

    def restore(new, blocks):
        return spark.createDataFrame([(new, blocks)], "t string, b array<string>").select(rewrites.restore_tables(F.col("t"), F.col("b")).alias("x")).first().x

    assert restore(p.p.text, p.p.blocks) == "a\n| x | y |\n| 1 | 2 |\nb\n|z|\n"
    assert restore("a\n - [[TABLE_1]] \n", ["|q|"]) == "a\n|q|\n"
    assert restore("see [[TABLE_1]] there [[TABLE_1]]", ["|$1|"]) == "see \n|$1|\n there "
    assert restore("lost  \n", ["|a|", "|b|"]) == "lost\n\n|a|\n\n|b|"
    assert restore(None, ["|a|"]) == "|a|" and restore("x\n[[TABLE_9]]\ny", []) == "x\ny" and restore("x", None) == "x"


def test_a_repeated_title_goes(spark):
    drop = lambda text, title: column(spark, rewrites.drop_title_echo, text, title)
    assert drop("\n1.2 The  Scope:\n\nBody", "the scope") == "Body"
    assert drop("Other\nBody", "the scope") == "Other\nBody" and drop(None, "x") == "" and drop("", "") == ""
