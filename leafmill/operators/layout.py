"""Pages as lines and spans with boxes: running headers and footers, body and heading sizes, heading scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.plans.registry import query

#: Shares of a page's height that are its top and bottom margin; length of a running line, at most.
TOP_ZONE, BOTTOM_ZONE, RUNNING_CHARS = 0.12, 0.12, 120
#: Weights of the signs of a heading, the larger sizes that are levels, and the score of a heading.
W_OUTLINE, W_SIZE, W_LARGEST, W_BOLD, W_NUMBER, W_UPPER, LEVELS, HEADING_GATE = 0.80, 0.40, 0.10, 0.25, 0.30, 0.15, 6, 0.55


# ------------------------------------------------------------------------------------------ running lines


def page_heights(lines: DataFrame) -> DataFrame:
    """(doc_id, page, height) where a source states no page size: the lowest edge of any line of the document."""
    ends = lines.groupBy("doc_id", "page").agg(F.max("y1").alias("_y"))
    return ends.select("doc_id", "page", F.max("_y").over(Window.partitionBy("doc_id")).alias("height"))


def _zoned(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds margin (whether a line's middle lies in its page's top or bottom zone) and norm."""
    sized = lines.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"], "left")
    height, middle = F.when(F.col("height") > 0, F.col("height")).otherwise(1.0), (F.col("y0") + F.col("y1")) / 2
    margin = ~((middle > height * TOP_ZONE) & (middle < height * (1 - BOTTOM_ZONE)))
    return sized.withColumn("margin", F.coalesce(margin, F.lit(True))).withColumn("norm", X.running_norm(F.coalesce("text", F.lit("")))).drop("height")


def repeated_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, norm, pages): lines that repeat in the margins of a document's pages, digits aside.

    ``lines`` are (doc_id, page, y0, y1, text), ``pages`` (doc_id, page, height) with a row for each page, also an empty
    one. A running line stands in the top or bottom 12 % of at least half of the pages, rounded down, and of three; a
    document of fewer than three pages has none. Lines of over 120 characters are none. A line is counted once a page,
    on the map side first. Null texts and texts of blanks don't count; an empty table gives an empty result.
    """
    seen = _zoned(lines, pages).filter("margin").filter((F.col("norm") != "") & (F.length("norm") <= RUNNING_CHARS)).select("doc_id", "norm", "page").distinct()
    least = pages.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n >= 3").select("doc_id", F.greatest(F.lit(3), F.floor(F.col("_n") / 2)).alias("_least"))
    counted = seen.groupBy("doc_id", "norm").agg(F.count("*").alias("pages"))
    return counted.join(least, "doc_id").filter("pages >= _least").select("doc_id", "norm", "pages")


def running_line_strip(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """``lines`` without running lines and page numbers in the margins; what stands in a page's body stays, also if it repeats."""
    rows = _zoned(lines, pages).join(repeated_lines(lines, pages).select("doc_id", "norm", F.lit(True).alias("_runs")), ["doc_id", "norm"], "left")
    text = F.trim(F.coalesce("text", F.lit("")))
    drop = F.col("margin") & (text != "") & (F.coalesce("_runs", F.lit(False)) | X.is_page_number(text))
    return rows.filter(~drop).select(*lines.columns)


_RUN = "lower(trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '[\\s\\x{0b}\\x{85}\\x{a0}]+', ' ', 'g')))"
_REPEATED = (
    f", z AS (SELECT l.*, {_RUN} AS norm, NOT ((y0 + y1) / 2 > height * 0.12 AND (y0 + y1) / 2 < height * (1 - 0.12)) AS margin FROM page_lines l JOIN page_sizes USING (doc_id, page)), "
    "r AS (SELECT doc_id, norm, count(DISTINCT page) AS pages FROM z WHERE margin AND norm <> '' AND length(norm) <= 120 GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM page_sizes GROUP BY doc_id), "
    "rep AS (SELECT doc_id, norm, pages FROM r JOIN n USING (doc_id) WHERE n >= 3 AND pages >= greatest(3, n // 2)) "
)
query("repeated_lines", _REPEATED + "SELECT * FROM rep", "page_lines page_sizes")(lambda t: repeated_lines(t.page_lines, t.page_sizes))
query(
    "running_line_strip",
    _REPEATED + f"SELECT doc_id, page, ord, text FROM z WHERE NOT (margin AND trim(text) <> '' AND ((doc_id, norm) IN (SELECT (doc_id, norm) FROM rep) OR (length(trim(text)) <= 20 AND regexp_matches(trim(text), '{X.PAGE_NUMBER}'))))",
    "page_lines page_sizes",
)(lambda t: running_line_strip(t.page_lines, t.page_sizes).select("doc_id", "page", "ord", "text"))


# ------------------------------------------------------------------------------------------ sizes and heading scores


def font_sizes(spans: DataFrame) -> DataFrame:
    """(doc_id, body, larger): the size that most characters have (the smaller of equals), and the larger ones, largest first.

    Sizes are rounded to a tenth; null texts and texts of blanks don't count.
    """
    sized = spans.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", F.round("size", 1).alias("size"), F.length(F.trim("text")).alias("n"))
    weight = sized.groupBy("doc_id", "size").agg(F.sum("n").alias("w"))
    own = weight.groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body"), F.sort_array(F.collect_set("size"), asc=False).alias("sizes"))
    return own.select("doc_id", "body", F.filter("sizes", lambda s: s > F.col("body")).alias("larger"))


def _first(*levels: Column) -> Column:
    """The first level that a sign has an opinion on, else 0."""
    return F.coalesce(*levels, F.lit(0))


def heading_score(spans: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, score, level): how much a span looks like a heading, and the level that its signs hint at (0: none).

    Added up: an entry of the ``outline`` (doc_id, page, title, and level, by default 1) that is the text, starts with it
    or starts it, 0.8; one of the document's six largest sizes above the body's, 0.4, or else 1.15 times the body's
    size or more, 0.4, and from 1.6 times on 0.1 more; bold and at most 120 characters, 0.25; a leading number with a
    title, 0.3; upper case in at most twelve words, 0.15. The level is that of the first sign of these, but a number's depth
    where it is smaller. Blank and null texts score 0. Repeated rows are scored alike; an empty table gives an empty result.
    """
    rows = spans.join(font_sizes(spans), "doc_id", "left").withColumn("t", F.trim(F.coalesce("text", F.lit("")))).withColumn("_size", F.round("size", 1))
    level = F.lit(None).cast("int")
    if outline is not None:
        title = lambda c: F.lower(X.collapse(c))
        each = outline if "level" in outline.columns else outline.withColumn("level", F.lit(1))
        # The entries of one page, an exact one first.
        entries = each.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set(F.struct(title("title").alias("title"), F.col("level").cast("int").alias("level")))).alias("_titles"))
        rows = rows.join(entries, ["doc_id", "page"], "left")
        own = title(F.col("t"))
        equal, near = F.filter("_titles", lambda e: e["title"] == own), F.filter("_titles", lambda e: e["title"].startswith(own) | own.startswith(e["title"]))
        level = F.coalesce(F.get(equal, F.lit(0))["level"], F.get(near, F.lit(0))["level"])
    place, ratio, depth = F.array_position(F.col("larger"), F.col("_size")).cast("int"), F.col("_size") / F.col("body"), X.numbering_depth(F.col("t"))
    named, bold, upper = place.between(1, LEVELS), F.col("bold") & (F.length("t") <= 120), X.uppercase_like(F.col("t"))
    score = (
        F.when(level.isNotNull(), W_OUTLINE).otherwise(0.0)
        + F.when(named, W_SIZE).when(ratio >= 1.6, W_SIZE + W_LARGEST).when(ratio >= 1.15, W_SIZE).otherwise(0.0)
        + F.when(bold, W_BOLD).otherwise(0.0)
        + F.when(depth > 0, W_NUMBER).otherwise(0.0)
        + F.when(upper, W_UPPER).otherwise(0.0)
    )
    before = _first(level, F.when(named, place), F.when(ratio >= 1.15, X.level_of_ratio(ratio)), F.when(bold, 3))
    hint = F.when((depth > 0) & ((before == 0) | (depth < before)), depth).otherwise(before)
    hint = F.when((hint == 0) & upper, 1).otherwise(hint)
    blank = F.col("t") == ""
    return rows.select("doc_id", "ord", F.when(blank, 0.0).otherwise(F.round(score, 2)).alias("score"), F.when(blank, 0).otherwise(hint).cast("int").alias("level"))


_UPPER_LIKE = "regexp_matches(t, '\\p{L}') AND length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) >= 0.85 * length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AND len(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ')) <= 12"
_SCORED = (
    ", s AS (SELECT doc_id, round(size, 1) AS size, sum(length(trim(text))) AS w FROM spans WHERE trim(text) <> '' GROUP BY ALL), b AS (SELECT doc_id, arg_max(size, (w, -size)) AS body FROM s GROUP BY doc_id), "
    "l AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS place FROM s JOIN b USING (doc_id) WHERE size > body), "
    "t AS (SELECT sp.doc_id, ord, bold AND length(trim(text)) <= 120 AS bold, round(sp.size, 1) / body AS ratio, trim(text) AS t, CASE WHEN place <= 6 THEN place END AS place FROM spans sp JOIN b USING (doc_id) LEFT JOIN l ON l.doc_id = sp.doc_id AND l.size = round(sp.size, 1)), "
    f"u AS (SELECT *, {_UPPER_LIKE} AS up, CASE WHEN regexp_matches(t, '{X.NUMBERED}') THEN len(string_split(regexp_extract(t, '{X.NUMBERED}', 1), '.')) ELSE 0 END AS depth, "
    "coalesce(place, CASE WHEN ratio >= 1.8 THEN 1 WHEN ratio >= 1.4 THEN 2 WHEN ratio >= 1.2 THEN 3 WHEN ratio >= 1.15 THEN 4 END, CASE WHEN bold THEN 3 END, 0) AS lv FROM t), "
    "v AS (SELECT *, CASE WHEN depth > 0 AND (lv = 0 OR depth < lv) THEN depth ELSE lv END AS lv2 FROM u), "
    "h AS (SELECT doc_id, ord, CAST(CASE WHEN t = '' THEN 0 ELSE round(CASE WHEN place IS NOT NULL THEN 0.4 WHEN ratio >= 1.6 THEN 0.5 WHEN ratio >= 1.15 THEN 0.4 ELSE 0 END + CASE WHEN bold THEN 0.25 ELSE 0 END + CASE WHEN depth > 0 THEN 0.3 ELSE 0 END + CASE WHEN up THEN 0.15 ELSE 0 END, 2) END AS DOUBLE) AS score, "
    "CAST(CASE WHEN t = '' THEN 0 WHEN lv2 = 0 AND up THEN 1 ELSE lv2 END AS INTEGER) AS level FROM v) "
)
query("heading_score", _SCORED + "SELECT * FROM h", "spans")(lambda t: heading_score(t.spans))


def headings(spans: DataFrame, outline: DataFrame | None = None, gate: float = HEADING_GATE) -> DataFrame:
    """(doc_id, ord, level): the spans that score as headings, with a level of 1 to 9; 1 where no sign hints at one."""
    level = F.when(F.col("level") == 0, 1).otherwise(F.least(F.col("level"), F.lit(9)))
    return heading_score(spans, outline).filter(F.col("score") >= gate).select("doc_id", "ord", level.alias("level"))


query("scored_headings", _SCORED + "SELECT doc_id, ord, CASE WHEN level = 0 THEN 1 ELSE least(level, 9) END AS level FROM h WHERE score >= 0.55", "spans")(lambda t: headings(t.spans))
