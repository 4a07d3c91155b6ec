"""Styles, percentiles, field replacement and revision rows: cases worked out by hand and against sorted arrays."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import styles

SPANS = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double, font string, size double, color long, text string"


def test_sources_by_their_signals(spark):
    rows = [
        (1, "plain words about nothing much", None), (2, "Use #2E5496 and #aabbcc with 11 pt and 14.5 points", []), (3, "text", ["Element | Font | Size", "A | B"]), (4, "text", ["Name | Hex"]), (5, None, None),
        (6, "font margin bold italic border spacing indent heading 1 must be hex colour required section", None),
    ]
    got = {r.doc_id: (r.n_hex, r.n_pt, r.spec_tables, r.kind, r.confidence) for r in styles.style_source_classify(spark.createDataFrame(rows, "doc_id int, text string, headers array<string>")).collect()}
    assert got[1][3:] == ("example", 0.9) and got[5] == (0, 0, 0, "example", 0.9)
    assert got[2][:4] == (2, 2, 0, "guideline") and got[3][2:4] == (1, "guideline") and got[4][3] == "example"
    # Twelve keywords give 7.2, which is not enough.
    assert got[6][3:] == ("example", 0.54)


def test_rules_of_a_guideline(spark):
    text = "Body: Georgia 11pt, georgia 11 pt in tables, Arial 10pt. Headings 16 pt, 14 point, 12.5pt, 30pt, 24pt, 20pt. Colours #000000 #F0F0F0 #2e5496 #2E5496 00FF00. Margins should be 1.25 inch."
    rows = [(1, text), (2, "9pt and 8pt; 2.5 inch margin"), (3, None), (4, "0.5 in margins of times new roman")]
    got = {r.doc_id: r for r in styles.style_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    r = got[1]
    assert (r.colours, r.accent, r.body_font, r.body_size, r.heading_sizes, r.margin_in) == (["000000", "F0F0F0", "2E5496", "00FF00"], "2E5496", "Georgia", 11.0, [30.0, 24.0, 20.0, 16.0], 1.25)
    assert (got[2].body_size, got[2].heading_sizes, got[2].margin_in) == (9.0, [], None)
    assert (got[3].colours, got[3].body_font, got[3].body_size, got[3].accent) == ([], None, None, None)
    assert (got[4].body_font, got[4].margin_in) == ("Times New Roman", 0.5)


def test_percentiles_equal_a_sorted_array(spark):
    draw = random.Random(2)
    values = {d: [draw.choice([1.0, 2.5, 3.0, draw.random()]) for _ in range(n)] for d, n in enumerate((1, 2, 5, 10, 11, 333))}
    rows = spark.createDataFrame([(d, v) for d, vs in values.items() for v in vs] + [(0, None), (99, None)], "doc_id long, v double")
    got = {r.doc_id: (r.a, r.b, r.c) for r in styles.at_percentile(rows, "v", {"a": 0.1, "b": 0.15, "c": 1.0}).collect()}
    assert got == {d: tuple(sorted(vs)[round(p * (len(vs) - 1))] for p in (0.1, 0.15, 1.0)) for d, vs in values.items()}


def test_a_page_profile_by_hand(spark):
    base = (1, 1, 72.0, 72.0, 540.0, 84.0, 612.0, 792.0, "Calibri", 11.0, 0, "twelve chars")
    rows = [base] * 8 + [(*base[:4], 300.0, *base[5:8], "Arial", 20.0, 0x2E5496, "a heading of the same length ...")] + [(*base[:3], 700.0, 540.0, 712.0, *base[6:11], "last"), (*base[:11], None)]
    (r,) = styles.style_profile(spark.createDataFrame(rows, SPANS)).collect()
    assert (r.font, r.size, r.color, r.accent, r.alignment, r.left, r.right, r.top, r.bottom) == ("Calibri", 11.0, "000000", "2E5496", "justify", 1.0, 1.0, 1.0, 1.11)
    odd = [(2, 1, 10.0, 1.0, 100.0 + 37 * i, 9.0, 600.0, 800.0, "A", 10.0, 0, "x") for i in range(10)]
    (r,) = styles.style_profile(spark.createDataFrame(odd, SPANS)).collect()
    # Margins stop at 0.3 and 2 inches; the top's is the mean of the sides.
    assert (r.accent, r.alignment, r.left, r.right, r.top) == (None, "left", 0.3, 2.0, 1.15)
    assert styles.style_profile(spark.createDataFrame([], SPANS)).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "old", "new", "want"),
    [
        ("Version: 1.2 and version 1.2.3, Rev. 1.2", "version", "1.2", "2.0", "Version: 2.0 and version 1.2.3, Rev. 2.0"),
        ("version 1.2.3.4", "version", "1.2.3", "$1\\9", "version $1\\9.4"),
        ("section 1.2 of a conversion 1.2", "version", "1.2", "9", "section 1.2 of a conversion 1.2"),
        ("Effective 01-Jun-2025, 01 Jun 2025", "date", "01-Jun-2025", "02-Jul-2026", "Effective 02-Jul-2026, 01 Jun 2025"),
        ("Effective 01 Jun. 2025", "date", "01-Jun-2025", "02-Jul-2026", "Effective 02-Jul-2026"),
        ("Effective 2025", "date", "2026", "2027", "Effective 2025"),
        ("a (b) a", "text", "(b)", "$c", "a $c a"),
        ("same", "version", None, "2", "same"), ("same", "date", "", "2", "same"), (None, "text", "a", "b", None),
    ],
)
def test_fields_are_replaced(spark, text, kind, old, new, want):
    row = spark.createDataFrame([(text, kind, old, new)], "t string, k string, o string, n string")
    assert row.select(styles.replace_field(*map(F.col, "tkon")).alias("x")).first().x == want


def test_revision_rows_follow_the_columns(spark):
    rows = [(1, ["Ver", "Date of issue", "Author", "Item", None], None), (2, ["#", "Approved By", "Description of change", "Version"], "Ann"), (3, [], None)]
    frame = spark.createDataFrame(rows, "i int, c array<string>, a string")
    got = {r.i: r.x for r in frame.select("i", styles.revision_row(F.col("c"), F.lit("2.0"), F.lit("01-Jan-2026"), F.col("a"), F.lit("Updated")).alias("x")).collect()}
    assert got == {1: ["2.0", "01-Jan-2026", "—", "", ""], 2: ["2.0", "Ann", "Updated", "2.0"], 3: []}
