"""What a rewrite must not lose: list markers, tables and the line between a title and its body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.plans.registry import query

#: A line with a list marker, one with a number or letter as its marker, a markdown table row, a title's marker.
_GLYPHS = "\\u2022\\u25e6\\u25aa\\u2023\\u00b7\\u25cf\\u25cb"
_COUNTED = "\\(?\\s*(?:[0-9]{1,3}|[a-zA-Z]|[ivxlcdmIVXLCDM]+)\\s*[.)\\]]"
MARKED = f"^\\s*(?:[-*+{_GLYPHS}]|{_COUNTED})\\s+\\S"
COUNTED = f"^\\s*{_COUNTED}\\s+\\S"
TABLE_ROW = "^\\s*\\|.*\\|\\s*$"
_BULLETS = "\\u2022\\u25e6\\u25aa\\u2023"
TITLE_MARKER = f"^\\s*(?:[-*{_BULLETS}]|\\(?\\s*(?:[0-9]{{1,3}}|[ivxlcdmIVXLCDM]+|[a-zA-Z])\\s*[.)\\]])\\s+"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, "(?U)^\\s+|\\s+$", "")


def restore_list(original: Column, new: Column) -> Column:
    """``new`` with the list markers that a rewrite of ``original`` lost.

    Where the original has two marked lines or more, each bare line becomes an item: numbered, if more than half of the
    original's markers count, else with a dash. Lines that have a marker or end in a colon stay, and so does the first line
    where the original began with an unmarked one, and blank ones. Null is an empty text.
    """
    olds = F.filter(_lines(original), lambda x: _bare(x) != "")
    marks = F.size(F.filter(olds, lambda x: x.rlike(MARKED)))
    counted = F.size(F.filter(olds, lambda x: x.rlike(COUNTED))) * 2 > marks
    intro = ~F.coalesce(F.get(olds, F.lit(0)).rlike(MARKED), F.lit(True))
    # A line's kind: blank, kept, or an item without its marker.
    kinds = F.transform(_lines(new), lambda x: F.struct(x.alias("line"), F.when(_bare(x) == "", "blank").when(_bare(x).rlike(MARKED) | _bare(x).endswith(":"), "kept").otherwise("item").alias("kind")))
    start = F.expr("named_struct('seen', 0, 'n', 1, 'out', CAST(array() AS array<string>))")

    def step(a: Column, x: Column) -> Column:
        item = (x["kind"] == "item") & ~((a["seen"] == 0) & intro)
        marker = F.when(counted, F.concat(a["n"].cast("string"), F.lit(". "))).otherwise("- ")
        line = F.when(item, F.concat(F.regexp_extract(x["line"], "^( *)", 1), marker, _bare(x["line"]))).otherwise(x["line"])
        return F.struct((a["seen"] + F.when(x["kind"] == "blank", 0).otherwise(1)).alias("seen"), (a["n"] + F.when(item, 1).otherwise(0)).alias("n"), F.array_append(a["out"], line).alias("out"))

    whole = F.array_join(F.aggregate(kinds, start, step, lambda a: a["out"]), "\n")
    return F.when(marks < 2, F.coalesce(new, F.lit(""))).otherwise(whole)


def protect_tables(text: Column) -> Column:
    """struct(text, blocks): runs of markdown table rows as ``[[TABLE_n]]`` lines, and the rows, trimmed, of each run."""
    start = F.expr("named_struct('out', CAST(array() AS array<string>), 'blocks', CAST(array() AS array<string>), 'open', false)")

    def step(a: Column, x: Column) -> Column:
        row, n = x.rlike(TABLE_ROW), F.size(a["blocks"])
        longer = F.concat(F.slice(a["blocks"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(a["blocks"], n - 1), F.lit("\n"), _bare(x))))
        blocks = F.when(~row, a["blocks"]).when(a["open"], longer).otherwise(F.array_append(a["blocks"], _bare(x)))
        name = F.concat(F.lit("[[TABLE_"), (n + 1).cast("string"), F.lit("]]"))
        out = F.when(~row, F.array_append(a["out"], x)).when(a["open"], a["out"]).otherwise(F.array_append(a["out"], name))
        return F.struct(out.alias("out"), blocks.alias("blocks"), row.alias("open"))

    return F.aggregate(_lines(text), start, step, lambda a: F.struct(F.array_join(a["out"], "\n").alias("text"), a["blocks"].alias("blocks")))


def restore_tables(text: Column, blocks: Column) -> Column:
    """``text`` with each ``[[TABLE_n]]`` replaced by its block, once.

    A placeholder's whole line is replaced, also with a list marker before it; one inside a line gets its table on lines of
    its own; a table whose placeholder is lost goes to the end. Further placeholders are removed. Null is an empty text.
    """
    marker = f"[ \\t]*(?:[-*{_BULLETS}][ \\t]+)?"

    def once(a: Column, found: Column, new: Column) -> Column:
        at = F.position(found, a)
        return F.concat(a.substr(F.lit(1), at - 1), new, a.substr(at + F.length(found), F.length(a)))

    def step(a: Column, b: Column) -> Column:
        name = F.concat(F.lit("[[TABLE_"), b["i"].cast("string"), F.lit("]]"))
        padded = F.concat(F.lit("\n"), a, F.lit("\n"))
        line = F.regexp_substr(padded, F.concat(F.lit(f"\\n{marker}\\[\\[TABLE_"), b["i"].cast("string"), F.lit("\\]\\][ \\t]*\\n")))
        lined = once(padded, line, F.concat(F.lit("\n"), b["block"], F.lit("\n")))
        lined = lined.substr(F.lit(2), F.length(lined) - 2)
        end = F.when(_bare(a) == "", b["block"]).otherwise(F.concat(F.regexp_replace(a, "(?U)\\s+$", ""), F.lit("\n\n"), b["block"]))
        return F.when(line.isNotNull(), F.replace(lined, name, F.lit(""))).when(a.contains(name), F.replace(once(a, name, F.concat(F.lit("\n"), b["block"], F.lit("\n"))), name, F.lit(""))).otherwise(end)

    told = F.transform(F.coalesce(blocks, F.array().cast("array<string>")), lambda b, i: F.struct((i + 1).alias("i"), b.alias("block")))
    done = F.aggregate(told, F.coalesce(text, F.lit("")), step)
    return F.regexp_replace(done, f"(?m)^{marker}\\[\\[TABLE_[0-9]+\\]\\][ \\t]*\\n?", "")


def drop_title_echo(text: Column, title: Column) -> Column:
    """The text without a first line that repeats the title, markers, numbers, a last colon and upper case aside."""

    def norm(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(_bare(s), TITLE_MARKER, ""), "^[0-9]+(?:\\.[0-9]+)*[.)]?\\s+", "")
        return F.lower(_bare(F.regexp_replace(F.regexp_replace(s, "(?U)\\s+", " "), ":+$", "")))

    first = F.regexp_extract(text, "^\\s*(\\S[^\\n]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(text, "^\\s*\\S[^\\n]*", ""), "^\\n+", "")
    return F.when((first != "") & (norm(first) == norm(F.coalesce(title, F.lit("")))), rest).otherwise(F.coalesce(text, F.lit("")))


# ------------------------------------------------------------------------------------------ registered uses

_MD = "CASE WHEN (doc_id + pos) % 12 IN (3, 4) THEN concat(' | ', line, ' | ') ELSE line END"


def _texts(t) -> DataFrame:
    """(doc_id, original, new): each document's lines, with table rows in bars, and the same without literal list markers."""
    lines = t.marked_lines.select("doc_id", "pos", F.expr(_MD).alias("line"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("x")))), lambda s: s["x"]), "\n")
    return lines.groupBy("doc_id").agg(joined(F.col("line")).alias("original"), joined(X.strip_leader(F.col("line"))).alias("new"))


_TEXTS = f", ml AS (SELECT doc_id, pos, {_MD} AS line FROM marked_lines), k AS (SELECT doc_id, pos, line, regexp_replace(line, '^\\s*([-*\\x{{2022}}\\x{{b7}}\\x{{25cf}}]|([0-9]{{1,3}}|[a-z])[.)])\\s+', '') AS bare FROM ml) "


def _re2(pattern: str) -> str:
    """A pattern with its \\uXXXX escapes as DuckDB writes them."""
    import re

    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)


query(
    "list_restore",
    _TEXTS
    + f", d AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '{_re2(MARKED)}')) AS marks, count(*) FILTER (regexp_matches(line, '{_re2(COUNTED)}')) AS counted, NOT regexp_matches(arg_min(line, pos) FILTER (trim(line) <> ''), '{_re2(MARKED)}') AS intro FROM k WHERE trim(line) <> '' GROUP BY doc_id), "
    f"o AS (SELECT doc_id, pos, bare, trim(bare) = '' AS blank, regexp_matches(trim(bare), '{_re2(MARKED)}') OR ends_with(trim(bare), ':') AS kept, coalesce(sum(CASE WHEN trim(bare) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM k), "
    "i AS (SELECT o.*, counted * 2 > marks AS num, coalesce(marks, 0) >= 2 AND NOT blank AND NOT kept AND NOT (seen = 0 AND coalesce(intro, false)) AS item FROM o LEFT JOIN d USING (doc_id)), "
    "n AS (SELECT *, sum(CAST(item AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS nr FROM i) "
    "SELECT doc_id, string_agg(CASE WHEN item THEN regexp_extract(bare, '^( *)', 1) || CASE WHEN num THEN nr || '. ' ELSE '- ' END || trim(bare) ELSE bare END, chr(10) ORDER BY pos) AS text FROM n GROUP BY doc_id",
    "marked_lines",
)(lambda t: _texts(t).select("doc_id", restore_list(F.col("original"), F.col("new")).alias("text")))

_RUNS = f", r AS (SELECT doc_id, pos, line, regexp_matches(line, '{TABLE_ROW}') AS tr, CASE WHEN regexp_matches(line, '{TABLE_ROW}') AND NOT coalesce(lag(regexp_matches(line, '{TABLE_ROW}')) OVER (PARTITION BY doc_id ORDER BY pos), false) THEN 1 ELSE 0 END AS opens FROM ml), b AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS nr FROM r) "
query(
    "table_protect",
    _TEXTS + _RUNS + "SELECT doc_id, string_agg(CASE WHEN tr THEN '[[TABLE_' || nr || ']]' ELSE line END, chr(10) ORDER BY pos) FILTER (NOT tr OR opens = 1) AS text, max(nr)::BIGINT AS n_tables FROM b GROUP BY doc_id",
    "marked_lines",
)(lambda t: _texts(t).select("doc_id", protect_tables(F.col("original")).alias("p")).select("doc_id", "p.text", F.size("p.blocks").cast("long").alias("n_tables")))
query(
    "table_restore",
    _TEXTS + _RUNS + "SELECT doc_id, string_agg(CASE WHEN tr THEN trim(line) ELSE line END, chr(10) ORDER BY pos) AS text FROM b GROUP BY doc_id",
    "marked_lines",
)(lambda t: _texts(t).select("doc_id", protect_tables(F.col("original")).alias("p")).select("doc_id", restore_tables(F.col("p.text"), F.col("p.blocks")).alias("text")))
