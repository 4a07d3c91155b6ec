"""Ordered operators over the lines and elements of documents: sections, headings, lists, tables, mastheads.

All windows are partitioned by document, and folds run over one document's array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.plans.registry import query
from leafmill.sources.html import typed



def _doc():
    return Window.partitionBy("doc_id").orderBy("pos")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)



_UP = "regexp_matches({0}, '\\p{{Lu}}') AND NOT regexp_matches({0}, '\\p{{Ll}}|\\p{{Lt}}')"
_TITLE = "regexp_matches({0}, '[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches({0}, '[\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}][\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches({0}, '(^|[^\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}])\\p{{Ll}}')"
_HEAD = f"(length(line) BETWEEN 1 AND 80 AND NOT ends_with(line, '.') AND (({_UP.format('line')}) OR ({_TITLE.format('line')})))"


def is_heading():
    line = F.col("line")
    return F.length(line).between(1, 80) & ~line.endswith(".") & (X.is_upper(line) | X.is_title(line))


def sectionize_text(lines: DataFrame) -> DataFrame:
    """(doc_id, idx, heading, level, body): a short upper- or title-case line opens a section; text before is level 0."""
    rows = lines.filter(F.col("line") != "").withColumn("_h", is_heading()).withColumn("idx", F.sum(F.col("_h").cast("int")).over(_so_far()))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "idx").agg(F.max(F.when(F.col("_h"), F.col("line"))).alias("heading"), F.max(F.col("_h").cast("int")).alias("level"), body.alias("body"))


query(
    "sectionize_text",
    f", r AS (SELECT doc_id, pos, line, {_HEAD} AS h FROM lines WHERE line <> ''), s AS (SELECT *, CAST(sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS idx FROM r) "
    "SELECT doc_id, idx, max(line) FILTER (h) AS heading, max(CAST(h AS INT)) AS level, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h), '') AS body FROM s GROUP BY doc_id, idx",
    "lines",
)(lambda t: sectionize_text(t.lines))
query(
    "sectionize_marked",
    f", r AS (SELECT doc_id, pos, line, {_HEAD} AS h FROM marked_lines WHERE line <> ''), s AS (SELECT *, CAST(sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS idx FROM r) "
    "SELECT doc_id, idx, max(line) FILTER (h) AS heading, max(CAST(h AS INT)) AS level, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h), '') AS body FROM s GROUP BY doc_id, idx",
    "marked_lines",
)(lambda t: sectionize_text(t.marked_lines))

_TYPED = ", typed AS (SELECT doc_id, pos, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list_item' ELSE 'paragraph' END AS type, CASE WHEN tag LIKE 'h%' THEN CAST(substring(tag, 2, 1) AS INT) END AS level, txt FROM elements)"
query("html_elements", _TYPED + " SELECT * FROM typed", "elements")(lambda t: typed(t.elements))
query("element_counts", _TYPED + " SELECT doc_id, type, count(*) AS n FROM typed GROUP BY doc_id, type", "elements")(lambda t: typed(t.elements).groupBy("doc_id", "type").agg(F.count("*").alias("n")))


@query(
    "sectionize_elements",
    _TYPED + ", s AS (SELECT *, CAST(sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS idx FROM typed) SELECT doc_id, idx, max(txt) FILTER (type = 'heading') AS heading, max(level) AS level, "
    "coalesce(string_agg(CASE WHEN type = 'list_item' THEN '- ' || txt ELSE txt END, chr(10) ORDER BY pos) FILTER (type <> 'heading'), '') AS body FROM s GROUP BY doc_id, idx",
    "elements",
)
def _sectionize_elements(t):
    """Sections at headings; list items are marked again in the body."""
    e = typed(t.elements).withColumn("idx", F.sum((F.col("type") == "heading").cast("int")).over(_so_far()))
    line = F.when(F.col("type") == "list_item", F.concat(F.lit("- "), "txt")).otherwise(F.col("txt"))
    body = F.array_sort(F.collect_list(F.when(F.col("type") != "heading", F.struct("pos", line.alias("line")))))
    return e.groupBy("doc_id", "idx").agg(F.max(F.when(F.col("type") == "heading", F.col("txt"))).alias("heading"), F.max("level").alias("level"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("body"))


query("outline", _TYPED + " SELECT doc_id, pos, level, left(txt, 180) AS title FROM typed WHERE type = 'heading' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 200", "elements")(
    lambda t: typed(t.elements).filter("type = 'heading'").withColumn("_n", F.row_number().over(_doc())).filter("_n <= 200").select("doc_id", "pos", "level", F.substring("txt", 1, 180).alias("title"))
)


def _levels(t) -> DataFrame:
    return t.marked_lines.filter(F.col("line").endswith(" Scope") | (F.col("line") == "SAFETY SUMMARY")).selectExpr("doc_id", "pos", "1 + (doc_id * 7 + pos * 3) % 5 AS level")


def heading_level_normalize(headings: DataFrame) -> DataFrame:
    """(doc_id, levels): each first-seen level becomes at most one deeper than the deepest so far; the choice is kept."""
    levels = F.transform(F.array_sort(F.collect_list(F.struct("pos", "level"))), lambda x: x["level"].cast("int"))
    start = F.struct(F.expr("map_from_arrays(CAST(array() AS array<int>), CAST(array() AS array<int>))").alias("seen"), F.lit(0).alias("top"), F.expr("CAST(array() AS array<int>)").alias("out"))

    def step(a, x):
        new = F.coalesce(F.element_at(a["seen"], x), F.least(x, a["top"] + 1))
        seen = F.when(F.map_contains_key(a["seen"], x), a["seen"]).otherwise(F.map_concat(a["seen"], F.create_map(x, new)))
        return F.struct(seen.alias("seen"), F.greatest(a["top"], new).alias("top"), F.concat(a["out"], F.array(new)).alias("out"))

    return headings.groupBy("doc_id").agg(levels.alias("_l")).select("doc_id", F.aggregate("_l", start, step, lambda a: a["out"]).alias("levels"))


query("heading_level_normalize")(lambda t: heading_level_normalize(_levels(t)).select("doc_id", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels")))


def list_groups(items: DataFrame) -> DataFrame:
    """Adds group_no over (doc_id, pos, kind, level): a new group after another kind, a gap in items, or a shallower level."""
    kind, level = F.lag("kind").over(_doc()), F.lag("level").over(_doc())
    new = F.coalesce((kind.isNull()) | (kind != F.col("kind")) | (F.col("level") < level), F.lit(True))
    new = F.when(F.col("kind").isNull(), False).otherwise(new)
    return items.withColumn("_new", new.cast("int")).withColumn("group_no", F.when(F.col("kind").isNotNull(), F.sum("_new").over(_so_far()))).drop("_new")


_KIND = "CASE WHEN regexp_matches(line, '^\\s*[-*\\x{2022}\\x{b7}\\x{25cf}]\\s+\\S') THEN 'bullet' WHEN regexp_matches(line, '^\\s*([0-9]{1,3}|[a-z])[.)]\\s+\\S') THEN 'number' END"
query(
    "list_groups",
    f", k AS (SELECT doc_id, pos, {_KIND} AS kind, pos % 2 AS level FROM marked_lines), n AS (SELECT *, CASE WHEN kind IS NULL THEN 0 WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind OR level < lag(level) OVER w THEN 1 ELSE 0 END AS nw FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) "
    "SELECT doc_id, pos, kind, CASE WHEN kind IS NOT NULL THEN CAST(sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) END AS group_no FROM n",
    "marked_lines",
)(lambda t: list_groups(t.marked_lines.select("doc_id", "pos", X.list_leader(F.col("line")).alias("kind"), (F.col("pos") % 2).alias("level"))).select("doc_id", "pos", "kind", "group_no"))


def islands(rows: DataFrame, flag) -> DataFrame:
    """Rows where ``flag`` holds, with island (a number a run of consecutive positions) and run_len."""
    kept = rows.filter(flag).withColumn("island", F.col("pos") - F.row_number().over(_doc()))
    return kept.withColumn("run_len", F.count("*").over(Window.partitionBy("doc_id", "island")))


_META = "regexp_matches(line, '(?i)^(version|prepared by|reviewed by|approved by|author|date|effective date|document (no|number|id)|revision|status|owner|department)\\b.*[:].*')"
query(
    "metadata_blocks",
    f", i AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marked_lines WHERE {_META}), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS run_len FROM i) SELECT doc_id, pos, run_len FROM c WHERE run_len >= 2",
    "marked_lines",
)(lambda t: islands(t.marked_lines, F.col("line").rlike(X.METADATA)).filter("run_len >= 2").select("doc_id", "pos", "run_len"))
query(
    "numbered_runs",
    ", n AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS o FROM marked_lines WHERE line <> ''), i AS (SELECT *, o - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM n WHERE regexp_matches(line, '^[0-9]+\\.\\s')), "
    "c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS run_len FROM i) SELECT doc_id, pos, CASE WHEN run_len >= 2 THEN 'number' WHEN length(line) <= 80 THEN 'heading' ELSE 'body' END AS role FROM c",
    "marked_lines",
)(lambda t: _numbered_runs(t.marked_lines))


def _numbered_runs(lines: DataFrame) -> DataFrame:
    """Adjacent numbered lines, blanks aside, are a list; a short one alone is a heading."""
    n = lines.filter("line <> ''").withColumn("_o", F.row_number().over(_doc())).filter(F.col("line").rlike("^[0-9]+\\.\\s"))
    n = n.withColumn("_i", F.col("_o") - F.row_number().over(_doc())).withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "_i")))
    return n.select("doc_id", "pos", F.when(F.col("_n") >= 2, "number").when(F.length("line") <= 80, "heading").otherwise("body").alias("role"))


query(
    "masthead_roles",
    ", b AS (SELECT doc_id, coalesce(min(pos) FILTER (line = '' OR regexp_matches(line, '^[0-9]+(\\.[0-9]+)*\\.?\\s')), 2147483647) AS stop FROM marked_lines GROUP BY doc_id), m AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM marked_lines JOIN b USING (doc_id) WHERE pos < stop) "
    "SELECT doc_id, pos, CASE WHEN n = 1 THEN 'title' WHEN n = 2 AND len(string_split(line, ' ')) <= 18 THEN 'subtitle' ELSE 'metadata' END AS role FROM m",
    "marked_lines",
)(lambda t: masthead_roles(t.marked_lines))


def masthead_roles(lines: DataFrame) -> DataFrame:
    """Roles of the lines before the first blank or numbered one: a title, a short subtitle, metadata."""
    stop = F.min(F.when((F.col("line") == "") | F.col("line").rlike("^[0-9]+(\\.[0-9]+)*\\.?\\s"), F.col("pos"))).over(Window.partitionBy("doc_id"))
    m = lines.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop"))).withColumn("_n", F.row_number().over(_doc()))
    role = F.when(F.col("_n") == 1, "title").when((F.col("_n") == 2) & (F.size(F.split("line", " ")) <= 18), "subtitle").otherwise("metadata")
    return m.select("doc_id", "pos", role.alias("role"))


query("masthead_fields", ", b AS (SELECT doc_id, coalesce(min(pos) FILTER (line = ''), 2147483647) AS stop FROM marked_lines GROUP BY doc_id) SELECT doc_id, arg_min(line, pos) AS title, coalesce(min_by(regexp_extract(line, '([A-Z]{2,}-[0-9]+)', 1), pos) FILTER (regexp_matches(line, '[A-Z]{2,}-[0-9]+')), '') AS code FROM marked_lines JOIN b USING (doc_id) WHERE pos < stop GROUP BY doc_id", "marked_lines")(
    lambda t: t.marked_lines.withColumn("_s", F.min(F.when(F.col("line") == "", F.col("pos"))).over(Window.partitionBy("doc_id"))).filter("_s IS NULL OR pos < _s").groupBy("doc_id").agg(
        F.min_by("line", "pos").alias("title"), F.coalesce(F.min_by(F.when(F.col("line").rlike("[A-Z]{2,}-[0-9]+"), F.regexp_extract("line", "([A-Z]{2,}-[0-9]+)", 1)), F.when(F.col("line").rlike("[A-Z]{2,}-[0-9]+"), F.col("pos"))), F.lit("")).alias("code")
    )
)
query("collapse_blanks", "SELECT doc_id, pos, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN line ELSE '' END AS line FROM marked_lines)) WHERE NOT (line = '' AND coalesce(prev, 'x') = '')", "marked_lines")(
    lambda t: collapse_blanks(t.marked_lines.select("doc_id", "pos", F.when(F.col("pos") % 3 == 0, F.col("line")).otherwise("").alias("line")))
)


def collapse_blanks(lines: DataFrame) -> DataFrame:
    """The first of each run of blank lines stays."""
    return lines.withColumn("_p", F.lag("line").over(_doc())).filter(~((F.col("line") == "") & F.coalesce(F.col("_p") == "", F.lit(False)))).drop("_p")


query("parent_heading", "SELECT template_id, ord, coalesce(lead(level) OVER (PARTITION BY template_id ORDER BY ord) > level, false) AS is_parent FROM slots", "slots")(
    lambda t: t.slots.select("template_id", "ord", F.coalesce(F.lead("level").over(Window.partitionBy("template_id").orderBy("ord")) > F.col("level"), F.lit(False)).alias("is_parent"))
)
query("drop_preface_slots", ", f AS (SELECT template_id, min(ord) FILTER (level = 2) AS first FROM slots GROUP BY template_id) SELECT template_id, ord, title FROM slots JOIN f USING (template_id) WHERE first IS NULL OR ord >= first", "slots")(
    lambda t: t.slots.withColumn("_f", F.min(F.when(F.col("level") == 2, F.col("ord"))).over(Window.partitionBy("template_id"))).filter("_f IS NULL OR ord >= _f").select("template_id", "ord", "title")
)
query("requirement_sort_key", "SELECT requirement_id, concat(array_to_string(list_transform(string_split(section_no, '.'), lambda x: lpad(x, 3, '0')), '.'), '.', lpad(CAST(row_number() OVER (PARTITION BY code, section_no ORDER BY requirement_id) - 1 AS VARCHAR), 3, '0')) AS sort_key FROM requirements", "requirements")(
    lambda t: t.requirements.select("requirement_id", F.concat(X.sort_key(F.col("section_no")), F.lit("."), F.lpad((F.row_number().over(Window.partitionBy("code", "section_no").orderBy("requirement_id")) - 1).cast("string"), 3, "0")).alias("sort_key"))
)
_ROLE = f"CASE WHEN contains(line, '|') THEN 'table' WHEN {_META} THEN 'metadata' WHEN regexp_matches(line, '^[0-9]+(\\.[0-9]+)+\\.?\\s') OR {_HEAD} THEN 'heading' WHEN ({_KIND}) IS NOT NULL THEN 'list' WHEN line = '' THEN 'blank' ELSE 'body' END"
query("line_roles", f"SELECT doc_id, pos, {_ROLE} AS role FROM marked_lines", "marked_lines")(lambda t: line_roles(t.marked_lines))


def line_roles(lines: DataFrame) -> DataFrame:
    """One role a line, in the order of priority table, metadata, heading, list, blank, body."""
    line = F.col("line")
    role = (
        F.when(line.contains("|"), "table")
        .when(line.rlike(X.METADATA), "metadata")
        .when(line.rlike("^[0-9]+(\\.[0-9]+)+\\.?\\s") | is_heading(), "heading")
        .when(X.list_leader(line).isNotNull(), "list")
        .when(line == "", "blank")
        .otherwise("body")
    )
    return lines.select("doc_id", "pos", role.alias("role"))


_ROLES = ("table", "metadata", "heading", "list", "blank", "body")
query("structure_summary", f", r AS (SELECT doc_id, {_ROLE} AS role FROM marked_lines) SELECT doc_id, " + ", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in _ROLES) + " FROM r GROUP BY doc_id", "marked_lines")(
    lambda t: line_roles(t.marked_lines).groupBy("doc_id").agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in _ROLES])
)


@query(
    "structure_scorecard",
    ", i AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marked_lines WHERE line = ''), e AS (SELECT doc_id, max(n) AS m FROM (SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id, island) GROUP BY doc_id) "
    "SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (line = '') AS empty, coalesce(max(m), 0) AS max_empty_run FROM marked_lines LEFT JOIN e USING (doc_id) GROUP BY doc_id",
    "marked_lines",
)
def _structure_scorecard(t):
    runs = islands(t.marked_lines, F.col("line") == "").groupBy("doc_id").agg(F.max("run_len").alias("m"))
    s = t.marked_lines.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("line") == "").alias("empty"))
    return s.join(runs, "doc_id", "left").select("doc_id", "paragraphs", "empty", F.coalesce("m", F.lit(0)).alias("max_empty_run"))


query("word_count", "SELECT doc_id, CAST(sum(len(list_filter(regexp_split_to_array(line, '[\\s\\x{0b}\\x{85}\\x{a0}]+'), lambda x: x <> ''))) AS BIGINT) AS words FROM lines GROUP BY doc_id", "lines")(
    lambda t: t.lines.groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split("line", "(?U)\\s+"), lambda x: x != ""))).alias("words"))
)
query(
    "page_estimate",
    ", w AS (SELECT doc_id, sum(len(list_filter(regexp_split_to_array(line, '[\\s\\x{0b}\\x{85}\\x{a0}]+'), lambda x: x <> ''))) AS words FROM lines GROUP BY doc_id) SELECT doc_id, CASE WHEN words > 0 THEN CAST(greatest(1, round_even(words / 380.0, 0)) AS INTEGER) END AS pages FROM w",
    "lines",
)(lambda t: t.lines.groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split("line", "(?U)\\s+"), lambda x: x != ""))).alias("w")).select("doc_id", F.when(F.col("w") > 0, F.greatest(F.lit(1), F.bround(F.col("w") / 380).cast("int"))).alias("pages")))
@query(
    "caption_dedup",
    _TYPED + ", h AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS o FROM typed) SELECT doc_id, pos, txt FROM h p WHERE NOT (type <> 'heading' AND length(txt) <= 120 AND EXISTS (SELECT 1 FROM h WHERE h.doc_id = p.doc_id AND h.type = 'heading' AND h.txt = p.txt AND h.o > p.o - 8 AND h.o <= p.o))",
    "elements",
)
def _caption_dedup(t):
    """Short paragraphs that repeat one of the last eight headings are dropped: an equi-join with a band on ordinals."""
    h = typed(t.elements).withColumn("o", F.sum((F.col("type") == "heading").cast("int")).over(_so_far()))
    heads = h.filter("type = 'heading'").select(F.col("doc_id").alias("d"), F.col("txt").alias("x"), F.col("o").alias("ho"))
    band = (F.col("doc_id") == F.col("d")) & (F.col("txt") == F.col("x")) & (F.col("ho") > F.col("o") - 8) & (F.col("ho") <= F.col("o")) & (F.col("type") != "heading") & (F.length("txt") <= 120)
    return h.join(heads, band, "left_anti").select("doc_id", "pos", "txt")


query("flat_heading_promote", ", n AS (SELECT doc_id, pos, line, regexp_matches(line, '^[0-9]+\\.\\s') AS single, regexp_matches(line, '^[0-9]+(\\.[0-9]+)+\\.?\\s') AS deep FROM marked_lines) SELECT doc_id, pos, deep OR (single AND NOT coalesce(lag(single) OVER w, false) AND NOT coalesce(lead(single) OVER w, false) AND NOT ends_with(line, '.')) AS heading FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)", "marked_lines")(
    lambda t: t.marked_lines.withColumn("single", F.col("line").rlike("^[0-9]+\\.\\s")).select("doc_id", "pos", (F.col("line").rlike("^[0-9]+(\\.[0-9]+)+\\.?\\s") | (F.col("single") & ~F.coalesce(F.lag("single").over(_doc()), F.lit(False)) & ~F.coalesce(F.lead("single").over(_doc()), F.lit(False)) & ~F.col("line").endswith("."))).alias("heading"))
)
