"""Tables in lines of text: delimited rows, label and value lines, and their grids as markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.plans.registry import query

#: Fixed value: a label of 2 to 48 characters, a colon and a value.
LABEL_VALUE = "^\\s*([^:|]{2,48}?)\\s*:\\s*(.+?)\\s*$"
BLOCK_PAIRS, ROW_PAIRS = 6, 5  #: label and value lines of a block, and of one that becomes a header row and a value row, at most


def cells(line: Column, delimiter: str) -> Column:
    """A line's trimmed cells, without empty ones at its edges."""
    parts = F.transform(F.split(F.coalesce(line, F.lit("")), "\\|" if delimiter == "|" else delimiter), lambda c: F.regexp_replace(c, "(?U)^\\s+|\\s+$", ""))
    full = F.filter(F.transform(parts, lambda c, i: F.when(c != "", i)), lambda i: i.isNotNull())
    first, last = F.array_min(full), F.array_max(full)
    return F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(parts, first + 1, last - first + 1))


def markdown(grid: Column) -> Column:
    """Rows of cells as ``| a | b |`` lines; line ends in cells become blanks."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\n", " "))), " | "), F.lit(" |"))
    return F.array_join(F.transform(grid, row), "\n")


def table_blocks(lines: DataFrame, skip: Column | None = None) -> DataFrame:
    """(doc_id, first_pos, last_pos, grid): runs of two or more adjacent lines that read as rows of one table.

    A row has two cells or more between bars, or between tabs where those give more. A run goes on while lines have its
    first row's delimiter, two cells or more, and a number of cells within one of the first row's. Where ``skip`` holds, as
    for headings and list items, no run starts. Rows are filled up to the longest with empty cells. One pass a document
    over the lines that hold a delimiter. Null lines are blank.
    """
    bars, tabs = F.size(cells(F.col("line"), "|")), F.size(cells(F.col("line"), "\t"))
    held = F.coalesce(F.col("line"), F.lit(""))
    rows = lines.withColumn("_skip", F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))).filter(held.contains("|") | held.contains("\t"))
    rows = rows.select("doc_id", "pos", "line", "_skip", F.when(held.contains("|"), bars).otherwise(0).alias("bars"), F.when(held.contains("\t"), tabs).otherwise(0).alias("tabs"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "bars", "tabs", F.col("_skip").alias("skip")))).alias("_x"))
    start = F.expr("named_struct('first', CAST(NULL AS int), 'last', CAST(NULL AS int), 'cols', 0, 'tab', false, 'out', CAST(array() AS array<struct<first: int, tab: boolean>>))")

    def step(a: Column, x: Column) -> Column:
        own = F.when(a["tab"], x["tabs"]).otherwise(x["bars"])
        goes_on = a["first"].isNotNull() & (x["pos"] == a["last"] + 1) & (own >= 2) & (F.abs(own - a["cols"]) <= 1)
        tab = x["tabs"] > F.greatest(F.lit(1), x["bars"])
        opens = ~x["skip"] & (F.greatest(x["bars"], x["tabs"]) >= 2)
        first = F.when(goes_on, a["first"]).when(opens, x["pos"].cast("int"))
        kind = F.when(goes_on, a["tab"]).otherwise(tab)
        cols = F.when(goes_on, a["cols"]).otherwise(F.when(tab, x["tabs"]).otherwise(x["bars"]))
        return F.struct(first.alias("first"), x["pos"].cast("int").alias("last"), cols.alias("cols"), kind.alias("tab"), F.array_append(a["out"], F.struct(first.alias("first"), kind.alias("tab"))).alias("out"))

    told = docs.select("doc_id", F.arrays_zip(F.transform("_x", lambda x: x["pos"]).alias("pos"), F.aggregate("_x", start, step, lambda a: a["out"]).alias("block")).alias("_z"))
    told = told.select("doc_id", F.explode("_z").alias("z")).select("doc_id", "z.pos", F.col("z.block.first").alias("first_pos"), F.col("z.block.tab").alias("tab")).filter("first_pos IS NOT NULL")
    each = told.join(rows.select("doc_id", "pos", "line"), ["doc_id", "pos"]).withColumn("row", F.when(F.col("tab"), cells(F.col("line"), "\t")).otherwise(cells(F.col("line"), "|")))
    blocks = each.groupBy("doc_id", "first_pos").agg(F.max("pos").alias("last_pos"), F.array_sort(F.collect_list(F.struct("pos", "row"))).alias("_r")).filter("last_pos > first_pos")
    return blocks.select("doc_id", "first_pos", "last_pos", X.padded(F.transform("_r", lambda x: x["row"])).alias("grid"))


_ROW = (
    "CASE WHEN (doc_id + pos) % 12 IN (2, 3, 4, 6) THEN concat('| A', pos, ' | B', CASE WHEN (pos * doc_id) % 3 = 0 THEN ' | C | D' WHEN (pos + doc_id) % 4 = 1 THEN '' ELSE ' |  | C' END, ' |') "
    "WHEN (doc_id + pos) % 12 IN (7, 8) THEN concat('x', chr(9), ' y', pos, CASE WHEN pos % 2 = 0 THEN concat(chr(9), 'z | w') ELSE '' END) ELSE line END AS line"
)


def _cells_sql(d: str) -> str:
    parts = f"list_transform(string_split(line, {d}), lambda c: trim(c))"
    return f"CASE WHEN len(list_filter({parts}, lambda c: c <> '')) = 0 THEN [] ELSE list_slice({parts}, list_position(list_transform({parts}, lambda c: c <> ''), true), len({parts}) + 1 - list_position(list_reverse(list_transform({parts}, lambda c: c <> '')), true)) END"


_TABLES = (
    f", g AS (SELECT doc_id, pos, {_ROW} FROM marked_lines), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, CASE WHEN contains(line, '|') THEN {_cells_sql(repr('|'))} ELSE [] END AS b, CASE WHEN contains(line, chr(9)) THEN {_cells_sql('chr(9)')} ELSE [] END AS t FROM g WHERE contains(line, '|') OR contains(line, chr(9))), "
    "f AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS first, CAST(NULL AS INTEGER) AS pos, CAST(0 AS BIGINT) AS cols, false AS tab FROM (SELECT DISTINCT doc_id FROM r) UNION ALL "
    "SELECT doc_id, k, CASE WHEN go THEN first WHEN greatest(len(b), len(t)) >= 2 THEN pos END, pos, CASE WHEN go THEN cols WHEN len(t) > greatest(1, len(b)) THEN len(t) ELSE len(b) END, CASE WHEN go THEN tab ELSE len(t) > greatest(1, len(b)) END "
    "FROM (SELECT r.doc_id, r.k, r.pos, r.b, r.t, f.first, f.cols, f.tab, coalesce(f.first IS NOT NULL AND r.pos = f.pos + 1 AND (CASE WHEN f.tab THEN len(r.t) ELSE len(r.b) END) >= 2 AND abs((CASE WHEN f.tab THEN len(r.t) ELSE len(r.b) END) - f.cols) <= 1, false) AS go FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1)), "
    "e AS (SELECT f.doc_id, f.first, f.pos, CASE WHEN f.tab THEN r.t ELSE r.b END AS row FROM f JOIN r USING (doc_id, k) WHERE f.first IS NOT NULL), "
    "w AS (SELECT doc_id, first, max(len(row)) AS width, max(pos) AS last FROM e GROUP BY doc_id, first HAVING count(*) >= 2) "
)
query(
    "table_blocks",
    _TABLES + "SELECT doc_id, first AS first_pos, last AS last_pos, count(*) AS n_rows, any_value(width) AS n_cols, string_agg('| ' || array_to_string(list_resize(row, width, ''), ' | ') || ' |', chr(10) ORDER BY pos) AS markdown FROM e JOIN w USING (doc_id, first) GROUP BY doc_id, first, last",
    "marked_lines",
)(
    lambda t: table_blocks(t.marked_lines.selectExpr("doc_id", "pos", _ROW)).select(
        "doc_id", "first_pos", "last_pos", F.size("grid").cast("long").alias("n_rows"), F.size(F.get("grid", F.lit(0))).cast("long").alias("n_cols"), markdown(F.col("grid")).alias("markdown")
    )
)


def metadata_kv_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, first_pos, n, grid): blocks of two to six ``Label: value`` lines as tables.

    ``lines`` are (doc_id, pos, line, eligible), with all lines of a document; eligible ones that read as a label and a value
    form a block while they are adjacent or have one blank line between them. Up to five become a header row and a row of
    values, six a table of fields and values; longer blocks are forms, and none. Null lines are blank.
    """
    own = Window.partitionBy("doc_id").orderBy("pos")
    text = F.coalesce("line", F.lit(""))
    rows = lines.withColumn("_blank", F.coalesce(F.lag(F.trim(text) == "").over(own), F.lit(False))).withColumn("_n", F.row_number().over(own))
    rows = rows.filter(F.col("eligible") & F.trim(text).rlike(LABEL_VALUE)).withColumn("_gap", F.col("_n") - F.lag("_n").over(own))
    adjacent = F.coalesce((F.col("_gap") == 1) | (F.col("_gap") == 2) & F.col("_blank"), F.lit(False))
    rows = rows.withColumn("_block", F.sum(F.when(adjacent, 0).otherwise(1)).over(own))
    part = lambda k: F.trim(F.regexp_extract(F.trim("line"), LABEL_VALUE, k))
    blocks = rows.groupBy("doc_id", "_block").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", part(1).alias("label"), part(2).alias("value")))).alias("_p"))
    labels, values = F.transform("_p", lambda p: p["label"]), F.transform("_p", lambda p: p["value"])
    wide = F.array(labels, values)
    tall = F.concat(F.array(F.array(F.lit("Field"), F.lit("Value"))), F.transform("_p", lambda p: F.array(p["label"], p["value"])))
    return blocks.filter(F.col("n").between(2, BLOCK_PAIRS)).select("doc_id", "first_pos", "n", F.when(F.col("n") <= ROW_PAIRS, wide).otherwise(tall).alias("grid"))


_FORM = "CASE WHEN (doc_id + pos) % 12 IN (5, 11) THEN '' WHEN (doc_id + pos) % 12 IN (6, 7, 8) OR (doc_id % 5 = 0 AND (doc_id + pos) % 12 IN (9, 10)) OR (doc_id % 7 = 0 AND pos % 30 < 9) THEN concat('Field ', pos % 4, ' : value ', pos) ELSE line END AS line"
query(
    "metadata_kv_tables",
    f", g AS (SELECT doc_id, pos, {_FORM} FROM marked_lines), a AS (SELECT *, coalesce(lag(trim(line) = '') OVER w, false) AS blank FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), e AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM a WHERE pos % 17 <> 3 AND regexp_matches(trim(line), '{LABEL_VALUE}')), "
    "k AS (SELECT *, sum(CASE WHEN gap = 1 OR (gap = 2 AND blank) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM e), "
    f"p AS (SELECT doc_id, block, min(pos) AS first_pos, count(*) AS n, list(trim(regexp_extract(trim(line), '{LABEL_VALUE}', 1)) ORDER BY pos) AS l, list(trim(regexp_extract(trim(line), '{LABEL_VALUE}', 2)) ORDER BY pos) AS v FROM k GROUP BY doc_id, block HAVING count(*) BETWEEN 2 AND 6) "
    "SELECT doc_id, first_pos, n, CASE WHEN n <= 5 THEN '| ' || array_to_string(l, ' | ') || ' |' || chr(10) || '| ' || array_to_string(v, ' | ') || ' |' ELSE '| Field | Value |' || chr(10) || array_to_string(list_transform(range(1, n + 1), lambda i: '| ' || l[i] || ' | ' || v[i] || ' |'), chr(10)) END AS markdown FROM p",
    "marked_lines",
)(lambda t: metadata_kv_tables(t.marked_lines.selectExpr("doc_id", "pos", _FORM, "pos % 17 <> 3 AS eligible")).select("doc_id", "first_pos", "n", markdown(F.col("grid")).alias("markdown")))
