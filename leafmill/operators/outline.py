"""Outlines: numbers of nested lists, slots of a template's headings, printed tables of contents and their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.plans.registry import query

# ------------------------------------------------------------------------------------------ list numbers

DEEPEST = 8  #: list levels go from 0 to this one


def roman(n: Column) -> Column:
    """A number in capital Roman digits, thousands repeated; empty below 1."""
    ones = lambda a, b, c: ["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c]
    digit = lambda names, unit: F.element_at(F.array(*map(F.lit, names)), (F.floor(n / unit) % 10 + 1).cast("int"))
    return F.when(n < 1, "").otherwise(F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(ones("C", "D", "M"), 100), digit(ones("X", "L", "C"), 10), digit(ones("I", "V", "X"), 1)))


def letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, up to four letters."""
    out, rest = F.lit(""), n.cast("long")
    for _ in range(4):
        letter = F.when(rest > 0, F.char(F.lit(65) + F.pmod(rest - 1, F.lit(26)))).otherwise("")
        out, rest = F.concat(letter, out), F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(0)
    return out


def list_numbering(items: DataFrame) -> DataFrame:
    """(doc_id, pos, number, marker) of list items, in ``items`` (doc_id, pos, kind, level, format).

    ``kind`` is number, bullet, or anything else, null included, for other elements. A numbered item counts its own level;
    counters of deeper levels end with it, all end at any other element, and a bullet ends them for the next numbered
    item. A marker is a dash, or the number as decimal, upperRoman, lowerRoman, upperLetter or lowerLetter (others:
    decimal), with a full stop; two blanks before it for each level. A null level is 0; levels stop at 8.
    """
    own = Window.partitionBy("doc_id").orderBy("pos")
    rows = items.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.coalesce("level", F.lit(0)))).cast("int"))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("kind") == "number", 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Where the counter of an item's level last ended: at the last item of a smaller level.
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.lit(None).cast("int")
    for level in range(1, DEEPEST + 1):
        ended = F.when(F.col("level") == level, F.max(F.when((F.col("kind") == "number") & (F.col("level") < level), F.col("pos"))).over(before)).otherwise(ended)
    rows = rows.withColumn("_ended", ended).filter(F.col("kind").isin("number", "bullet"))
    n = F.row_number().over(Window.partitionBy("doc_id", "kind", "_run", "level", "_ended").orderBy("pos"))
    rows = rows.withColumn("number", F.when(F.col("kind") == "number", n))
    told = (
        F.when(F.col("format") == "upperRoman", roman(F.col("number")))
        .when(F.col("format") == "lowerRoman", F.lower(roman(F.col("number"))))
        .when(F.col("format") == "upperLetter", letters(F.col("number")))
        .when(F.col("format") == "lowerLetter", F.lower(letters(F.col("number"))))
        .otherwise(F.col("number").cast("string"))
    )
    marker = F.concat(F.repeat(F.lit("  "), F.col("level")), F.when(F.col("kind") == "bullet", "-").otherwise(F.concat(told, F.lit("."))))
    return rows.select("doc_id", "pos", "number", marker.alias("marker"))


_FORMATS = ("decimal", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", None)
_ITEM = (
    "CASE WHEN (doc_id + pos) % 12 IN (0, 1, 2, 3, 6, 7) THEN CASE WHEN (doc_id * 3 + pos) % 11 = 0 THEN 'bullet' ELSE 'number' END WHEN (doc_id + pos) % 12 = 9 THEN 'heading' END AS kind, "
    "CASE WHEN pos % 13 = 5 THEN NULL ELSE (doc_id + pos * pos) % 4 END AS level, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FORMATS) if f) + " END AS format"
)
query(
    "list_numbering",
    f", i0 AS (SELECT doc_id, pos, {_ITEM} FROM marked_lines), i AS (SELECT doc_id, pos, kind, CAST(coalesce(level, 0) AS INTEGER) AS level, format, sum(CASE WHEN kind = 'number' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM i0), "
    "c AS (SELECT a.doc_id, a.pos, any_value(a.kind) AS kind, any_value(a.level) AS level, any_value(a.format) AS format, CASE WHEN any_value(a.kind) = 'number' THEN 1 + count(b.pos) END AS n FROM i a LEFT JOIN i b ON b.doc_id = a.doc_id AND b.run = a.run AND b.kind = 'number' AND b.level = a.level AND b.pos < a.pos "
    "AND NOT EXISTS (SELECT 1 FROM i x WHERE x.doc_id = a.doc_id AND x.run = a.run AND x.kind = 'number' AND x.level < a.level AND x.pos > b.pos AND x.pos < a.pos) WHERE a.kind IN ('number', 'bullet') GROUP BY a.doc_id, a.pos), "
    "w AS (SELECT *, CASE WHEN n IS NULL THEN NULL WHEN n > 26 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) ELSE chr(CAST(64 + n AS INTEGER)) END AS lt, "
    "repeat('C', (n // 100)::BIGINT) || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1] AS rm FROM c) "
    "SELECT doc_id, pos, CAST(n AS INTEGER) AS number, repeat('  ', level) || CASE WHEN kind = 'bullet' THEN '-' ELSE CASE format WHEN 'upperRoman' THEN rm WHEN 'lowerRoman' THEN lower(rm) WHEN 'upperLetter' THEN lt WHEN 'lowerLetter' THEN lower(lt) ELSE CAST(n AS VARCHAR) END || '.' END AS marker FROM w",
    "marked_lines",
)(lambda t: list_numbering(t.marked_lines.selectExpr("doc_id", "pos", *_item_columns())))


def _item_columns() -> list[str]:
    kind, level, form = _ITEM.split(" AS kind, ")[0], _ITEM.split(" AS kind, ")[1].split(" AS level, ")[0], _ITEM.split(" AS level, ")[1].removesuffix(" AS format")
    return [f"{kind} AS kind", f"{level} AS level", f"{form} AS format"]


# ------------------------------------------------------------------------------------------ slots of headings

#: A placeholder in a template, a numbered title, a keyword.
PLACEHOLDER, NUMBERED_TITLE, KEYWORD = "\\{\\{\\s*[a-zA-Z0-9_]+\\s*\\}\\}", "^\\s*[0-9]+(?:\\.[0-9]+)*[.)]?\\s+\\S", "[A-Za-z]{4,}"


def unused_ids(rows: DataFrame, key: str, order: str = "ord", base: str = "base") -> DataFrame:
    """Adds slot_id: ``base``, or with _2, _3 ... behind it the first that no earlier row of ``key`` has. One fold a group."""
    start = F.expr("CAST(array() AS array<string>)")

    def step(used: Column, x: Column) -> Column:
        name = x["base"]
        spare = F.filter(F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda i: F.concat(name, F.lit("_"), i.cast("string"))), lambda c: ~F.array_contains(used, c))
        return F.concat(used, F.array(F.when(F.array_contains(used, name), F.get(spare, F.lit(0))).otherwise(name)))

    groups = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), F.col(base).alias("base")))).alias("_x"))
    ids = groups.withColumn("_ids", F.aggregate("_x", start, step))
    each = ids.select(key, F.explode(F.arrays_zip("_x", "_ids")).alias("z")).select(key, F.col("z._x.ord").alias(order), F.col("z._ids").alias("slot_id"))
    return rows.join(each, [key, order])


def slot_base(title: Column, place: Column) -> Column:
    """The title as an identifier, or slot_ and its place where nothing of it remains."""
    return F.when(X.slug(title) == "", F.concat(F.lit("slot_"), place.cast("string"))).otherwise(X.slug(title))


def heading_slots(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ord, slot_id, level, title, keywords, marker): the slots that a template's headings make.

    ``paragraphs`` are (doc_id, pos, level, text), level null for other than headings. A placeholder ``{{ name }}`` in a
    heading is its marker, unless one stands before the first heading: that is then the first one's. One behind a heading
    replaces its marker; the last counts. Keywords are the words of four letters or more, lower case. Before the first numbered
    title, slots are a masthead and go, unless one of them has a marker. Identifiers are unused ones, counted before that.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = paragraphs.withColumn("text", text).withColumn("_head", F.col("level").isNotNull() & (text != "")).withColumn("_m", F.nullif(F.regexp_substr("text", F.lit(PLACEHOLDER)), F.lit("")))
    rows = rows.withColumn("ord", F.sum(F.col("_head").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    head = lambda c: F.max(F.when(F.col("_head"), F.col(c)))
    loose = ~F.col("_head") & F.col("_m").isNotNull()
    groups = rows.groupBy("doc_id", "ord").agg(head("level").alias("level"), head("text").alias("title"), head("_m").alias("_own"), F.max_by("_m", F.when(loose, F.col("pos"))).alias("_after"), F.max(loose).alias("_has"))
    first = groups.filter("ord = 0 AND _has").select("doc_id", F.col("_after").alias("_before"))
    groups = groups.filter("ord > 0").join(first, "doc_id", "left")
    marker = F.coalesce(F.when(F.col("_has"), F.col("_after")), F.when(F.col("ord") == 1, F.col("_before")), F.col("_own"))
    keywords = F.transform(F.regexp_extract_all("title", F.lit(KEYWORD), F.lit(0)), F.lower)
    slots = unused_ids(groups.withColumn("marker", marker).withColumn("base", slot_base(F.col("title"), F.col("ord"))), "doc_id")
    own = Window.partitionBy("doc_id")
    numbered = F.min(F.when(F.col("title").rlike(NUMBERED_TITLE), F.col("ord"))).over(own)
    slots = slots.withColumn("_first", numbered).withColumn("_marked", F.max(F.col("marker").isNotNull() & (F.col("ord") < F.col("_first"))).over(own))
    kept = F.col("_first").isNull() | F.col("_marked") | (F.col("ord") >= F.col("_first"))
    return slots.filter(kept).select("doc_id", "ord", "slot_id", "level", "title", keywords.alias("keywords"), "marker")


_TITLES = "SELECT template_id, ord, CASE WHEN ord % 4 = 1 THEN 'A' WHEN ord % 7 = 2 THEN 'A 2' WHEN ord % 11 = 5 THEN '--' ELSE title END AS title FROM slots"
_SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'slot_' || {1})"
query(
    "slot_slugs",
    f", ti AS ({_TITLES}), b AS (SELECT template_id, ord, {_SLUG.format('title', 'ord')} AS base FROM ti), f AS (SELECT template_id, ord, base AS slot_id, [base] AS used FROM b WHERE ord = 0 UNION ALL "
    "SELECT template_id, ord, slot_id, list_append(used, slot_id) FROM (SELECT f.template_id, b.ord, f.used, CASE WHEN NOT list_contains(f.used, b.base) THEN b.base ELSE list_filter(list_transform(range(2, len(f.used) + 3), lambda i: b.base || '_' || i), lambda c: NOT list_contains(f.used, c))[1] END AS slot_id FROM f JOIN b ON b.template_id = f.template_id AND b.ord = f.ord + 1)) "
    "SELECT template_id, ord, slot_id FROM f",
    "slots",
)(lambda t: unused_ids(t.slots.selectExpr("template_id", "ord", "CASE WHEN ord % 4 = 1 THEN 'A' WHEN ord % 7 = 2 THEN 'A 2' WHEN ord % 11 = 5 THEN '--' ELSE title END AS title").withColumn("base", slot_base(F.col("title"), F.col("ord"))), "template_id").select("template_id", "ord", "slot_id"))

_PARAGRAPH = "CASE WHEN (doc_id + pos) % 12 IN (8, 9) AND (doc_id % 3 > 0 OR pos > 20) THEN 1 + pos % 3 END AS level, CASE WHEN (doc_id * 5 + pos) % 9 = 0 THEN concat(substring(line, 1, 30), ' {{ field_', pos % 4, ' }}') ELSE line END AS text"
query(
    "heading_slots",
    f", p AS (SELECT doc_id, pos, level, trim(text) AS text, nullif(regexp_extract(text, '\\{{\\{{\\s*[a-zA-Z0-9_]+\\s*\\}}\\}}'), '') AS m FROM (SELECT doc_id, pos, {_PARAGRAPH} FROM marked_lines)), "
    "q AS (SELECT *, level IS NOT NULL AND text <> '' AS head, sum(CASE WHEN level IS NOT NULL AND text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM p), "
    "g AS (SELECT doc_id, ord, max(level) FILTER (head) AS level, max(text) FILTER (head) AS title, max(m) FILTER (head) AS own, arg_max(m, pos) FILTER (NOT head AND m IS NOT NULL) AS aft FROM q GROUP BY doc_id, ord), "
    f"k AS (SELECT g.*, coalesce(g.aft, CASE WHEN g.ord = 1 THEN z.aft END, g.own) AS marker, {_SLUG.format('g.title', 'g.ord')} AS base FROM g LEFT JOIN g z ON z.doc_id = g.doc_id AND z.ord = 0 WHERE g.ord > 0), "
    "f AS (SELECT doc_id, ord, base AS slot_id, [base] AS used FROM k WHERE ord = 1 UNION ALL SELECT doc_id, ord, slot_id, list_append(used, slot_id) FROM (SELECT f.doc_id, k.ord, f.used, CASE WHEN NOT list_contains(f.used, k.base) THEN k.base ELSE list_filter(list_transform(range(2, len(f.used) + 3), lambda i: k.base || '_' || i), lambda c: NOT list_contains(f.used, c))[1] END AS slot_id FROM f JOIN k ON k.doc_id = f.doc_id AND k.ord = f.ord + 1)), "
    "n AS (SELECT doc_id, min(ord) AS first FROM k WHERE regexp_matches(title, '^\\s*[0-9]+(?:\\.[0-9]+)*[.)]?\\s+\\S') GROUP BY doc_id) "
    "SELECT doc_id, ord, slot_id, level, title, list_transform(regexp_extract_all(title, '[A-Za-z]{4,}'), lambda x: lower(x)) AS keywords, marker FROM k JOIN f USING (doc_id, ord) LEFT JOIN n USING (doc_id) "
    "WHERE first IS NULL OR ord >= first OR EXISTS (SELECT 1 FROM k y WHERE y.doc_id = k.doc_id AND y.ord < n.first AND y.marker IS NOT NULL)",
    "marked_lines",
)(lambda t: heading_slots(t.marked_lines.selectExpr("doc_id", "pos", *(x if x.endswith("level") else x for x in _PARAGRAPH.replace(" AS level, ", " AS level@").split("@")))))


# ------------------------------------------------------------------------------------------ printed tables of contents

#: Dots that lead to a page number, and an entry of a printed table of contents.
LEADER = "\\.{2,}\\s*[0-9]+"
ENTRY = "(?s)([0-9]+(?:\\.[0-9]+)*)\\.?\\s+(.+?)\\s*\\.{2,}\\s*([0-9]+)\\b"
LONGEST_TITLE, TITLE_WORDS = 200, 5


def _listed(pages: DataFrame, header: str | None) -> DataFrame:
    """Adds contents (three dot leaders or more on the page), and text without the lines that hold the running ``header``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    kept = lines if header is None else F.filter(lines, lambda x: ~x.rlike("(?i)" + header))
    return pages.select("doc_id", "page", kept.alias("lines"), (F.size(F.regexp_extract_all(text, F.lit(LEADER), F.lit(0))) >= 3).alias("contents"))


def _joined(rows: DataFrame, name: str) -> DataFrame:
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "lines"))), lambda x: x["lines"]))
    return rows.groupBy("doc_id").agg(F.regexp_replace(F.array_join(parts, "\n"), "\\s+", " ").alias(name))


def parse_toc(pages: DataFrame, header: str | None = None) -> DataFrame:
    """(doc_id, n, section_no, title, page, level): the entries of each document's printed table of contents, in order.

    ``pages`` are (doc_id, page, text). Contents stand on pages with three dot leaders or more; lines that hold ``header``
    (a pattern) are left out. An entry is a number, a title that may go over lines, dots and a page. Titles of over 200
    characters, empty ones and annexes are none; of a number the first entry counts. Null texts are empty.
    """
    flat = _joined(_listed(pages, header).filter("contents"), "flat")
    group = lambda k: F.regexp_extract_all("flat", F.lit(ENTRY), F.lit(k))
    each = flat.select("doc_id", F.posexplode(F.arrays_zip(group(1).alias("section_no"), group(2).alias("title"), group(3).alias("page"))).alias("at", "e"))
    each = each.select("doc_id", "at", "e.section_no", F.btrim("e.title", F.lit(" .")).alias("title"), F.col("e.page").cast("long").alias("page"))
    each = each.filter((F.col("title") != "") & (F.length("title") <= LONGEST_TITLE) & ~F.upper("title").startswith("ANNEX"))
    once = each.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "section_no").orderBy("at"))).filter("_k = 1")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return once.select("doc_id", place.alias("n"), "section_no", "title", "page", F.size(F.split("section_no", "\\.")).alias("level"))


def segment_sections(pages: DataFrame, header: str | None = None) -> DataFrame:
    """``parse_toc`` with start (0-based in the body, null if not found) and text: each entry's part of the body.

    The body are the pages behind the last page of contents, without page numbers that stand alone on a line, white space
    collapsed. Entries are looked for in their order, each behind the one found before: its number, a full stop or not, and
    the first five words of its title, whatever their case. A text goes on to the next heading found, or to the end.
    """
    rows = _listed(pages, header)
    last = rows.groupBy("doc_id").agg(F.max(F.when(F.col("contents"), F.col("page"))).alias("_last"))
    body = rows.join(last, "doc_id").filter("_last IS NULL OR page > _last").withColumn("lines", F.filter("lines", lambda x: ~x.rlike("^\\s*[0-9]+\\s*$")))
    toc = parse_toc(pages, header)
    words = F.array_join(F.slice(F.filter(F.split("title", "\\s+"), lambda w: w != ""), 1, TITLE_WORDS), " ")
    keyed = toc.withColumn("_plain", F.lower(F.concat("section_no", F.lit(" "), words))).withColumn("_dotted", F.lower(F.concat("section_no", F.lit(". "), words)))
    entries = keyed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "section_no", "title", "page", "level", "_plain", "_dotted"))).alias("toc"))
    # Places are counted in lower case, so a letter whose lower case is longer must not change: such are left as they are.
    met = entries.join(_joined(body, "flat"), "doc_id", "left").withColumn("flat", F.coalesce("flat", F.lit(""))).withColumn("low", F.when(F.length(F.lower("flat")) == F.length("flat"), F.lower("flat")).otherwise(F.translate("flat", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    found = F.expr(
        "aggregate(toc, named_struct('cursor', 1, 'starts', CAST(array() AS array<int>)), (a, e) -> transform(array(named_struct('p', locate(e._plain, low, a.cursor), 'd', locate(e._dotted, low, a.cursor))), "
        "x -> CASE WHEN x.p > 0 AND (x.d = 0 OR x.p < x.d) THEN named_struct('cursor', x.p + length(e._plain), 'starts', array_append(a.starts, x.p - 1)) "
        "WHEN x.d > 0 THEN named_struct('cursor', x.d + length(e._dotted), 'starts', array_append(a.starts, x.d - 1)) ELSE named_struct('cursor', a.cursor, 'starts', array_append(a.starts, CAST(NULL AS int))) END)[0], a -> a.starts)"
    )
    each = met.withColumn("starts", found).select("doc_id", "flat", "starts", F.posexplode("toc").alias("i", "e"))
    each = each.withColumn("start", F.get("starts", F.col("i"))).withColumn("_next", F.expr("get(filter(slice(starts, i + 2, size(starts)), s -> s IS NOT NULL), 0)"))
    stop = F.coalesce("_next", F.length("flat"))
    text = F.when(F.col("start").isNull(), "").otherwise(F.trim(F.col("flat").substr(F.col("start") + 1, stop - F.col("start"))))
    return each.select("doc_id", F.col("e.n").alias("n"), "e.section_no", "e.title", "e.page", "e.level", "start", text.alias("text"))


_PAGES = (
    ", pg AS (SELECT doc_id, 1 AS page, string_agg(CASE WHEN doc_id % 4 = 0 AND pos % 3 = 0 THEN 'Annex ' || line ELSE line END || ' ..... ' || (pos + 1), chr(10) ORDER BY pos) AS text FROM marked_lines WHERE (doc_id + pos) % 12 = 8 GROUP BY doc_id UNION ALL SELECT doc_id, 2, string_agg(line, chr(10) ORDER BY pos) FROM marked_lines GROUP BY doc_id), "
    "li AS (SELECT doc_id, page, list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, 'SAFETY')) AS lines, len(regexp_extract_all(text, '\\.{2,}\\s*[0-9]+')) >= 3 AS contents FROM pg), "
    "tf AS (SELECT doc_id, regexp_replace(array_to_string(flatten(list(lines ORDER BY page)), chr(10)), '\\s+', ' ', 'g') AS flat FROM li WHERE contents GROUP BY doc_id), "
    f"te AS (SELECT doc_id, unnest(regexp_extract_all(flat, '{ENTRY}', 1)) AS section_no, unnest(regexp_extract_all(flat, '{ENTRY}', 2)) AS title, unnest(regexp_extract_all(flat, '{ENTRY}', 3)) AS page, unnest(range(len(regexp_extract_all(flat, '{ENTRY}')))) AS idx FROM tf), "
    "tt AS (SELECT doc_id, idx, section_no, trim(title, ' .') AS title, CAST(page AS BIGINT) AS page FROM te WHERE trim(title, ' .') <> '' AND length(trim(title, ' .')) <= 200 AND NOT starts_with(upper(trim(title, ' .')), 'ANNEX') QUALIFY row_number() OVER (PARTITION BY doc_id, section_no ORDER BY idx) = 1), "
    "toc AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS n, section_no, title, page, len(string_split(section_no, '.')) AS level FROM tt) "
)


def _outline_pages(t) -> DataFrame:
    text = lambda line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("x")))), lambda s: s["x"]), "\n").alias("text")
    entry = F.concat(F.when((F.col("doc_id") % 4 == 0) & (F.col("pos") % 3 == 0), F.concat(F.lit("Annex "), "line")).otherwise(F.col("line")), F.lit(" ..... "), (F.col("pos") + 1).cast("string"))
    first = t.marked_lines.filter("(doc_id + pos) % 12 = 8").groupBy("doc_id").agg(text(entry)).select("doc_id", F.lit(1).alias("page"), "text")
    return first.union(t.marked_lines.groupBy("doc_id").agg(text(F.col("line"))).select("doc_id", F.lit(2).alias("page"), "text"))


query("toc_entries", _PAGES + "SELECT * FROM toc", "marked_lines")(lambda t: parse_toc(_outline_pages(t), "safety"))
query(
    "toc_segment",
    _PAGES + ", lp AS (SELECT doc_id, max(page) FILTER (contents) AS last FROM li GROUP BY doc_id), bd AS (SELECT doc_id, regexp_replace(array_to_string(flatten(list(list_filter(lines, lambda x: NOT regexp_full_match(x, '\\s*[0-9]+\\s*')) ORDER BY page)), chr(10)), '\\s+', ' ', 'g') AS flat FROM li JOIN lp USING (doc_id) WHERE last IS NULL OR page > last GROUP BY doc_id), "
    "k AS (SELECT toc.*, coalesce(flat, '') AS flat, translate(coalesce(flat, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, translate(array_to_string(list_filter(string_split(title, ' '), lambda w: w <> '')[1:5], ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ws FROM toc LEFT JOIN bd USING (doc_id)), "
    "sc AS (SELECT doc_id, 0 AS n, CAST(0 AS BIGINT) AS cursor, CAST(NULL AS BIGINT) AS start FROM (SELECT DISTINCT doc_id FROM k) UNION ALL "
    "SELECT doc_id, n, CASE WHEN p > 0 AND (d = 0 OR p < d) THEN cursor + p - 1 + length(section_no || ' ' || ws) WHEN d > 0 THEN cursor + d - 1 + length(section_no || '. ' || ws) ELSE cursor END, CASE WHEN p > 0 AND (d = 0 OR p < d) THEN cursor + p - 1 WHEN d > 0 THEN cursor + d - 1 END "
    "FROM (SELECT k.doc_id, k.n, sc.cursor, section_no, ws, strpos(substr(low, sc.cursor + 1), section_no || ' ' || ws) AS p, strpos(substr(low, sc.cursor + 1), section_no || '. ' || ws) AS d FROM sc JOIN k ON k.doc_id = sc.doc_id AND k.n = sc.n + 1)) "
    "SELECT k.doc_id, k.n, section_no, title, page, level, CAST(start AS INTEGER) AS start, CASE WHEN start IS NULL THEN '' ELSE trim(substr(flat, start + 1, coalesce((SELECT min(y.start) FROM sc y WHERE y.doc_id = sc.doc_id AND y.n > sc.n AND y.start IS NOT NULL), length(flat)) - start)) END AS text FROM k JOIN sc USING (doc_id, n)",
    "marked_lines",
)(lambda t: segment_sections(_outline_pages(t), "safety"))
