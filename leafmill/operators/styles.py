"""Styles: what a source says or shows about fonts, sizes, colours and margins; version and date fields that are replaced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.plans.registry import query

#: Signals of a formatting guideline.
FONTS = (
    "Arial", "Calibri", "Times New Roman", "Times", "Helvetica", "Georgia", "Verdana", "Garamond", "Cambria", "Tahoma", "Century", "Book Antiqua", "Courier New", "Trebuchet", "Segoe UI", "Roboto", "Lato",
)
KEYWORDS = (
    "formatting", "format ", "template", "style guide", "styling", "typography", "specification", "must ", "shall ", "convention", "standard operating",
    "margin", "heading 1", "heading 2", "font", "point size", "pt)", "hex", "colour", "color palette", "bold", "italic", "indent", "spacing", "border",
    "alignment", "twips", "dxa", "header and footer", "required", "section",
)
HEADER_SIGNALS = (
    "element", "font", "size", "style", "color", "colour", "property", "specification", "space before", "space after", "hex", "usage", "applied to", "weight", "pt",
)
HEX, POINTS = "#?([0-9A-Fa-f]{6})(?:[^\\p{L}\\p{N}_]|$)", "(?i)([0-9]+(?:\\.[0-9]+)?)\\s*(?:pt|point)"
MARGIN_BEHIND = 'margins?[^.\\n]{0,40}?([0-9]+(?:\\.[0-9]+)?)\\s*(?:inch|in\\b|")'
MARGIN_BEFORE = '([0-9]+(?:\\.[0-9]+)?)\\s*(?:inch|in\\b|")[^.\\n]{0,20}?margin'


def _hits(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [low.contains(w.lower()).cast("int") for w in words])


def style_source_classify(sources: DataFrame) -> DataFrame:
    """(doc_id, n_hex, n_pt, n_fonts, n_words, spec_tables, kind, confidence): whether a source is a guideline or an example.

    ``sources`` are (doc_id, text, headers): the text with its tables' cells, and each table's header row as one string. A
    guideline has two colours and two point sizes, or a table whose header names two style properties, or a score of 9:
    1.5 a colour (8 at most), 1.2 a size (10), 1 a font (4), 0.6 a keyword (12), 3 such a table. The confidence grows with the
    score, and falls with it for an example. Null texts and headers are empty.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    headers = F.coalesce("headers", F.array().cast("array<string>"))
    rows = sources.select(
        "doc_id",
        F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(HEX), F.lit(1)))).alias("n_hex"),
        F.size(F.regexp_extract_all(text, F.lit(POINTS), F.lit(1))).alias("n_pt"),
        _hits(low, FONTS).alias("n_fonts"),
        _hits(low, KEYWORDS).alias("n_words"),
        F.size(F.filter(headers, lambda h: _hits(F.lower(h), HEADER_SIGNALS) >= 2)).alias("spec_tables"),
    )
    least = lambda c, n: F.least(F.col(c), F.lit(n))
    # Tenths and hundredths as whole numbers, so that no sum of fractions decides a tie; halves are rounded down.
    score = least("n_hex", 8) * 15 + least("n_pt", 10) * 12 + least("n_fonts", 4) * 10 + least("n_words", 12) * 6 + F.col("spec_tables") * 30
    guideline = ((F.col("n_hex") >= 2) & (F.col("n_pt") >= 2)) | (F.col("spec_tables") >= 1) | (score >= 90)
    within = lambda c, high: F.greatest(F.lit(50), F.least(F.lit(high), F.floor(c).cast("int"))) / 100.0
    sure = F.when(guideline, within((2 * (150 + score) + 3) / 6, 97)).otherwise(within((180 - score) / 2, 95))
    return rows.select("*", F.when(guideline, "guideline").otherwise("example").alias("kind"), sure.alias("confidence"))


def _rgb(h: Column) -> tuple[Column, Column]:
    """The largest and the smallest of a colour's three parts."""
    parts = F.transform(F.array(*[h.substr(F.lit(i), F.lit(2)) for i in (1, 3, 5)]), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.array_max(parts), F.array_min(parts)


def style_rules(sources: DataFrame) -> DataFrame:
    """(doc_id, colours, accent, body_font, body_size, heading_sizes, margin_in): the rules that a guideline's text states.

    Colours come in the order of their first mention; the accent is the first that is neither nearly black nor nearly white.
    The body's font is the known family named most often (the first in the list of equals), its size the one of 10 to 12.5
    points mentioned most often (the smallest of equals), or else the smallest of 9 to 12. Up to four larger sizes by more than
    half a point are headings, largest first. A margin is a number of inches beside the word, from 0.3 to 2.
    """
    text = F.coalesce("text", F.lit(""))
    rows = sources.select("doc_id", text.alias("t"), F.lower(text).alias("low"))
    rows = rows.withColumn("colours", F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(HEX), F.lit(1)), F.upper)))
    rows = rows.withColumn("sizes", F.transform(F.regexp_extract_all("t", F.lit(POINTS), F.lit(1)), lambda x: x.cast("double")))
    vivid = F.filter("colours", lambda h: (_rgb(h)[0] > 60) & (_rgb(h)[1] <= 230))
    named = F.array(*[F.struct(((F.length("low") - F.length(F.replace("low", F.lit(f.lower()), F.lit("")))) / len(f)).cast("int").alias("n"), F.lit(-i).alias("i"), F.lit(f).alias("font")) for i, f in enumerate(FONTS)])
    best = F.array_max(named)
    band = F.filter("sizes", lambda s: (s >= 10) & (s <= 12.5))
    often = F.array_max(F.transform(F.array_distinct(band), lambda s: F.struct(F.size(F.filter(band, lambda x: x == s)).alias("n"), (-s).alias("minus"))))
    body = F.coalesce(-often["minus"], F.array_min(F.filter("sizes", lambda s: (s >= 9) & (s <= 12))))
    rows = rows.withColumn("body_size", body)
    base = F.coalesce("body_size", F.array_min("sizes"))
    larger = F.slice(F.sort_array(F.array_distinct(F.filter("sizes", lambda s: s > base + 0.5)), asc=False), 1, 4)
    inches = F.coalesce(*[F.nullif(F.regexp_extract("low", p, 1), F.lit("")) for p in (MARGIN_BEHIND, MARGIN_BEFORE)]).cast("double")
    return rows.select(
        "doc_id", "colours", F.get(vivid, F.lit(0)).alias("accent"), F.when(best["n"] > 0, best["font"]).alias("body_font"), "body_size", larger.alias("heading_sizes"), F.when(inches.between(0.3, 2.0), inches).alias("margin_in")
    )


_SOURCE = (
    "concat(text, CASE doc_id % 4 WHEN 0 THEN concat(' Body font Calibri ', 9 + doc_id % 5, '.5 pt, #2E54', 10 + doc_id % 80, '. Headings must be Cambria ', 14 + doc_id % 7, 'pt bold, 18 points #000001; calibri tables 10pt. Margins are at least ', 1 + doc_id % 3, ' inch') "
    "WHEN 1 THEN concat(' formatting: 0.', doc_id % 10, '5 in margin #FFFFFF #', 100000 + doc_id) ELSE '' END) AS text"
)
_HEADER = "CASE doc_id % 6 WHEN 0 THEN 'Element | Font | Size' WHEN 1 THEN 'Name | Hex' ELSE NULL END"
_ANY = lambda low, words: " + ".join(f"CAST(contains({low}, '{w.lower()}') AS INTEGER)" for w in words)
_MENTIONS = f", s AS (SELECT doc_id, {_SOURCE}, CASE WHEN {_HEADER} IS NULL THEN [] ELSE [{_HEADER}] END AS headers FROM documents), x AS (SELECT *, lower(text) AS low FROM s) "
query(
    "style_source_classify",
    "WITH " + _MENTIONS[2:] + f", c AS (SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '{HEX}', 1))) AS INTEGER) AS n_hex, CAST(len(regexp_extract_all(text, '{POINTS}', 1)) AS INTEGER) AS n_pt, {_ANY('low', FONTS)} AS n_fonts, {_ANY('low', KEYWORDS)} AS n_words, "
    f"CAST(len(list_filter(headers, lambda h: {_ANY('lower(h)', HEADER_SIGNALS)} >= 2)) AS INTEGER) AS spec_tables FROM x), "
    "d AS (SELECT *, least(n_hex, 8) * 15 + least(n_pt, 10) * 12 + least(n_fonts, 4) * 10 + least(n_words, 12) * 6 + spec_tables * 30 AS score FROM c), e AS (SELECT *, (n_hex >= 2 AND n_pt >= 2) OR spec_tables >= 1 OR score >= 90 AS g FROM d) "
    "SELECT doc_id, n_hex, n_pt, n_fonts, n_words, spec_tables, CASE WHEN g THEN 'guideline' ELSE 'example' END AS kind, CASE WHEN g THEN greatest(50, least(97, (2 * (150 + score) + 3) // 6)) ELSE greatest(50, least(95, CAST(floor((180 - score) / 2) AS INTEGER))) END / 100.0::DOUBLE AS confidence FROM e",
)(lambda t: style_source_classify(_sources(t)))


def _sources(t) -> DataFrame:
    """Every document with a closing passage on styles for some, and a table's header."""
    head = F.expr(_HEADER)
    return t.documents.select("doc_id", F.expr(_SOURCE), F.when(head.isNotNull(), F.array(head)).otherwise(F.array().cast("array<string>")).alias("headers"))


_NAMED = ", ".join(f"{{'n': CAST((length(low) - length(replace(low, '{f.lower()}', ''))) / {len(f)} AS INTEGER), 'i': {-i}, 'font': '{f}'}}" for i, f in enumerate(FONTS))
_PARTS = "list_transform([h[1:2], h[3:4], h[5:6]], lambda p: ('0x' || p)::INTEGER)"
query(
    "style_rule_extract",
    "WITH " + _MENTIONS[2:] + f", c AS (SELECT doc_id, low, list_transform(regexp_extract_all(text, '{HEX}', 1), lambda h: upper(h)) AS hx, list_transform(regexp_extract_all(text, '{POINTS}', 1), lambda v: v::DOUBLE) AS sizes, list_max([{_NAMED}]) AS best FROM x), "
    "d AS (SELECT *, list_filter(hx, lambda h, i: list_position(hx, h) = i) AS colours, list_filter(sizes, lambda v: v BETWEEN 10 AND 12.5) AS band FROM c), "
    "e AS (SELECT *, coalesce(-(list_max(list_transform(band, lambda v: {'n': len(list_filter(band, lambda w: w = v)), 'minus': -v}))).minus, list_min(list_filter(sizes, lambda v: v BETWEEN 9 AND 12))) AS body_size, "
    f"coalesce(nullif(regexp_extract(low, '{MARGIN_BEHIND}', 1), ''), nullif(regexp_extract(low, '{MARGIN_BEFORE}', 1), ''))::DOUBLE AS inches FROM d) "
    f"SELECT doc_id, colours, list_filter(colours, lambda h: list_max({_PARTS}) > 60 AND list_min({_PARTS}) <= 230)[1] AS accent, CASE WHEN best.n > 0 THEN best.font END AS body_font, body_size, "
    "list_reverse_sort(list_distinct(list_filter(sizes, lambda v: v > coalesce(body_size, list_min(sizes)) + 0.5)))[1:4] AS heading_sizes, CASE WHEN inches BETWEEN 0.3 AND 2 THEN inches END AS margin_in FROM e",
)(lambda t: style_rules(_sources(t)))


# ------------------------------------------------------------------------------------------ profiles of pages


def at_percentile(values: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """(doc_id, a column a share): the value at rank round(share x (n - 1)) of a document's values in order, halves to even.

    Equal values are counted on the map side first, so a document is a table of its distinct values and never one array.
    """
    own = Window.partitionBy("doc_id")
    counts = values.filter(F.col(value).isNotNull()).groupBy("doc_id", F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    counts = counts.withColumn("_to", F.sum("_k").over(own.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.sum("_k").over(own))
    return counts.groupBy("doc_id").agg(*[F.min(F.when(F.col("_to") > F.bround(F.lit(p) * (F.col("_n") - 1)), F.col("_v"))).alias(name) for name, p in shares.items()])


def style_profile(spans: DataFrame) -> DataFrame:
    """(doc_id, font, size, color, accent, alignment, top, bottom, left, right): how a document's pages are set.

    ``spans`` are (doc_id, page, x0, y0, x1, y1, page_w, page_h, font, size, color, text), color as one number. The body's size
    is the one that most characters have; its font that of most characters, those within 0.6 of that size counted twice; its
    colour the commonest, and the accent the commonest that is not nearly black. Lines that end at the right edge, the 15th
    percentile of the gaps and 3 % of the width more, make the text justified from 40 % on. Side margins are the 10th percentile
    of the edges in inches, from 0.3 to 2; the top's and the bottom's the smallest edge, or the mean of the sides where that is
    under 0.5 or over 1.4. Ties go to the smaller value. Null texts and texts of blanks don't count.
    """
    rows = spans.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("n", F.length(F.trim("text"))).withColumn("size", F.round("size", 1))
    rows = rows.withColumn("gap", F.col("page_w") - F.col("x1")).withColumn("low", F.col("page_h") - F.col("y1"))
    size = rows.groupBy("doc_id", "size").agg(F.sum("n").alias("w")).groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body"))
    fonts = rows.groupBy("doc_id", "font", "size").agg(F.sum("n").alias("n")).join(size, "doc_id")
    fonts = fonts.groupBy("doc_id", "font").agg(F.sum(F.col("n") * F.when(F.abs(F.col("size") - F.col("body")) < 0.6, 2).otherwise(1)).alias("w")).groupBy("doc_id").agg(F.min_by("font", F.struct(-F.col("w"), "font")).alias("font"))
    shade = rows.groupBy("doc_id", "color").agg(F.sum("n").alias("w")).withColumn("_hex", F.lpad(F.hex(F.col("color").cast("long").bitwiseAND(0xFFFFFF)), 6, "0"))
    order = F.struct(-F.col("w"), "color")
    shade = shade.groupBy("doc_id").agg(F.min_by("_hex", order).alias("color"), F.min_by("_hex", F.when(_rgb(F.col("_hex"))[0] > 60, order)).alias("accent"))
    edges = at_percentile(rows, "x0", {"_left": 0.10}).join(at_percentile(rows, "gap", {"_right": 0.10, "_edge": 0.15}), "doc_id")
    whole = rows.groupBy("doc_id").agg(F.min("y0").alias("_top"), F.min("low").alias("_bottom"), F.max_by("page_w", "page").alias("_w"), F.count("*").alias("_n"))
    full = rows.join(edges.join(whole, "doc_id").select("doc_id", (F.col("_edge") + 0.03 * F.col("_w")).alias("_reach")), "doc_id").groupBy("doc_id").agg(F.count_if(F.col("gap") <= F.col("_reach")).alias("_full"))
    inches = lambda c: F.round(F.greatest(F.lit(0.3), F.least(F.col(c) / 72.0, F.lit(2.0))), 2)
    met = reduce(lambda a, b: a.join(b, "doc_id"), [whole, size, fonts, shade, edges, full])
    met = met.withColumn("left", inches("_left")).withColumn("right", inches("_right")).withColumn("_side", F.floor((F.round(F.col("left") * 100) + F.round(F.col("right") * 100) + 1) / 2) / 100.0)
    upright = lambda c: F.when(inches(c).between(0.5, 1.4), inches(c)).otherwise(F.col("_side"))
    return met.select(
        "doc_id", "font", F.col("body").alias("size"), "color", "accent", F.when(F.col("_full") / F.col("_n") >= 0.4, "justify").otherwise("left").alias("alignment"), upright("_top").alias("top"), upright("_bottom").alias("bottom"), "left", "right"
    )


_SET = [
    "doc_id", "page", "CAST(20 + (doc_id * 7 + ord * 13) % 60 AS DOUBLE) AS x0", "y0 + CAST(doc_id % 50 AS DOUBLE) AS y0", "CAST(CASE WHEN doc_id % 3 = 0 THEN 540 - ord % 2 ELSE 300 + (ord * 37) % 250 END AS DOUBLE) AS x1", "y1 + CAST(doc_id % 50 AS DOUBLE) AS y1",
    "CAST(600 + 12 * page AS DOUBLE) AS page_w", "CAST(150 + doc_id % 40 AS DOUBLE) AS page_h", "font", "size", "CASE WHEN ord % 3 = 0 THEN 0 WHEN ord % 3 = 1 THEN 2059 ELSE 3036310 + doc_id % 5 END AS color", "text",
]
_RANK = lambda c, p: f"list_sort(list({c}))[CAST(round_even({p} * (count(*) - 1), 0) AS INTEGER) + 1]"
_IN = lambda c: f"round(greatest(0.3::DOUBLE, least({c} / 72.0::DOUBLE, 2.0::DOUBLE)), 2)"
_PROFILE = (
    f", p AS (SELECT {', '.join(_SET)} FROM spans), r AS (SELECT *, length(trim(text)) AS n, page_w - x1 AS gap, page_h - y1 AS low FROM p WHERE trim(text) <> ''), z AS (SELECT doc_id, size, sum(n) AS w FROM r GROUP BY ALL), b AS (SELECT doc_id, arg_max(size, (w, -size)) AS body FROM z GROUP BY doc_id), "
    "f AS (SELECT doc_id, font, sum(n * CASE WHEN abs(size - body) < 0.6 THEN 2 ELSE 1 END) AS w FROM r JOIN b USING (doc_id) GROUP BY doc_id, font), ff AS (SELECT doc_id, arg_min(font, (-w, font)) AS font FROM f GROUP BY doc_id), "
    "c AS (SELECT doc_id, color, sum(n) AS w, lpad(upper(to_hex(color & 16777215)), 6, '0') AS h FROM r GROUP BY doc_id, color), cc AS (SELECT doc_id, arg_min(h, (-w, color)) AS color, arg_min(h, (-w, color)) FILTER (greatest((color >> 16) & 255, (color >> 8) & 255, color & 255) > 60) AS accent FROM c GROUP BY doc_id), "
    f"e AS (SELECT doc_id, {_RANK('x0', 0.1)} AS l10, {_RANK('gap', 0.1)} AS r10, {_RANK('gap', 0.15)} AS r15, min(y0) AS ty, min(low) AS bo, arg_max(page_w, page) AS w, count(*) AS n FROM r GROUP BY doc_id), "
    "u AS (SELECT doc_id, count(*) FILTER (gap <= r15 + 0.03::DOUBLE * w) AS fl FROM r JOIN (SELECT doc_id, r15, w FROM e) USING (doc_id) GROUP BY doc_id), "
    f"m AS (SELECT doc_id, {_IN('l10')} AS \"left\", {_IN('r10')} AS \"right\", floor((round({_IN('l10')} * 100) + round({_IN('r10')} * 100) + 1) / 2) / 100.0::DOUBLE AS side, {_IN('ty')} AS ti, {_IN('bo')} AS bi, n FROM e) "
)
query(
    "style_profile",
    _PROFILE + "SELECT doc_id, font, body AS size, color, accent, CASE WHEN fl / n >= 0.4 THEN 'justify' ELSE 'left' END AS alignment, CASE WHEN ti BETWEEN 0.5 AND 1.4 THEN ti ELSE side END AS top, CASE WHEN bi BETWEEN 0.5 AND 1.4 THEN bi ELSE side END AS bottom, \"left\", \"right\" FROM m JOIN b USING (doc_id) JOIN ff USING (doc_id) JOIN cc USING (doc_id) JOIN u USING (doc_id)",
    "spans",
)(lambda t: style_profile(t.spans.selectExpr(*_SET)))
query("margin_percentiles", f"SELECT doc_id, {_RANK('x0', 0.1)} AS p10, {_RANK('x0', 0.15)} AS p15 FROM spans GROUP BY doc_id", "spans")(lambda t: at_percentile(t.spans, "x0", {"p10": 0.1, "p15": 0.15}))


# ------------------------------------------------------------------------------------------ fields of a new version

#: Fixed value: a word that names a version, before its number.
VERSION_WORD = "(?i)\\b((?:version|revision|ver|rev)\\.?\\s*[:.\\-]?\\s*)"


def replace_field(text: Column, kind: Column, old: Column, new: Column) -> Column:
    """The text with a field's old value replaced: kind version, date, or else any place that equals ``old``.

    A version counts behind a word that names one, where the number, of up to three parts, is the old one. A date stands as
    it is or, if nowhere so, with other separators between its parts. Null or empty values change nothing.
    """
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    safe = F.regexp_replace(new, "([\\\\$])", "\\\\$1")
    longer = F.when(F.size(F.split(old, "\\.")) < 3, "(?!\\.[0-9])").otherwise("")
    version = F.regexp_replace(text, F.concat(F.lit(VERSION_WORD), quoted(old), F.lit("\\b"), longer), F.concat(F.lit("$1"), safe))
    parts = F.filter(F.split(old, "[-/.\\s]+"), lambda x: x != "")
    tolerant = F.regexp_replace(text, F.array_join(F.transform(parts, quoted), "[-/.\\s]+"), safe)
    literal = F.replace(text, old, new)
    date = F.when(text.contains(old), literal).when(F.size(parts) >= 2, tolerant).otherwise(text)
    known = F.coalesce((old != "") & (new != ""), F.lit(False))
    return F.when(~known, text).when(kind == "version", version).when(kind == "date", date).otherwise(literal)


def revision_row(columns: Column, version: Column, date: Column, author: Column, summary: Column) -> Column:
    """The cells of a new row under these column names: version, date, author (a dash if unknown), summary, else empty."""

    def cell(name: Column) -> Column:
        low = F.lower(F.coalesce(name, F.lit("")))
        has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        return (
            F.when(has("version") | low.isin("ver", "rev", "revision", "#", "no."), version)
            .when(has("date"), date)
            .when(has("author", "by", "owner", "approv"), F.when(F.coalesce(author, F.lit("")) == "", "—").otherwise(author))
            .when(has("change", "summary", "description", "note", "detail"), F.coalesce(summary, F.lit("")))
            .otherwise("")
        )

    return F.transform(columns, cell)


_COLUMNS = "CASE pos % 3 WHEN 0 THEN 'Ver|Date of issue|Author|Item' WHEN 1 THEN 'No.|Effective date|Approved By|Change summary' ELSE 'Version|Notes|' END"
query(
    "revision_row",
    f", v AS (SELECT doc_id, pos, regexp_extract(line, '([0-9]+)[.]([0-9]+)', 1) || '.' || (CAST(regexp_extract(line, '([0-9]+)[.]([0-9]+)', 2) AS BIGINT) + 1) AS version, string_split({_COLUMNS}, '|') AS cols, CASE WHEN doc_id % 4 > 0 THEN concat('Author ', doc_id % 4) END AS author FROM marked_lines WHERE starts_with(line, 'Version: ')) "
    "SELECT doc_id, pos, array_to_string(list_transform(cols, lambda c: CASE WHEN contains(lower(c), 'version') OR lower(c) IN ('ver', 'rev', 'revision', '#', 'no.') THEN version WHEN contains(lower(c), 'date') THEN '01-Jan-2026' WHEN regexp_matches(lower(c), 'author|by|owner|approv') THEN coalesce(author, chr(8212)) WHEN regexp_matches(lower(c), 'change|summary|description|note|detail') THEN 'Updated' ELSE '' END), '|') AS cells FROM v",
    "marked_lines",
)(
    lambda t: t.marked_lines.filter(F.col("line").startswith("Version: ")).select(
        "doc_id", "pos", F.array_join(revision_row(F.split(F.expr(_COLUMNS), "\\|"), X.bump(X.version_of(F.col("line"))), F.lit("01-Jan-2026"), F.expr("CASE WHEN doc_id % 4 > 0 THEN concat('Author ', doc_id % 4) END"), F.lit("Updated")), "|").alias("cells")
    )
)
query("field_replace")(
    lambda t: t.marked_lines.select("doc_id", "pos", replace_field(F.col("line"), F.lit("version"), F.concat((F.col("pos") % 4).cast("string"), F.lit("."), (F.col("doc_id") % 10).cast("string")), F.lit("9.9")).alias("line"))
)
