"""Texts and rows around an audit: a digest of a run for an assistant, and requirements that a guideline's sections make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.scoring import _CRIT, _LABEL, _SCORE, _TOP, SEVERITY_WEIGHT, is_issue, score_by_section, score_overall, severity_counts, status_label
from leafmill.operators.structure import _HEAD, sectionize_text
from leafmill.plans.registry import query

#: What a digest holds at most, and the characters that stay.
DIGEST_SECTIONS, DIGEST_ISSUES, DIGEST_CHARS, FIX_CHARS = 12, 60, 6000, 160


def audit_digest(findings: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(run_id, digest): the score and severity counts of a run, its weak sections and its worst open findings, as text.

    ``findings`` are those of the scores, with ord, finding_id and suggested_fix, ``titles`` (section, title). Up to twelve
    sections that have open findings come by number, then up to sixty open findings by severity, order, id and title, each with its
    section, severity, dimension, title and the first 160 characters of its fix; 6,000 characters stay. A run without open
    findings has its first line alone. Findings equal in all of these come by ``place``, where there is that column.
    """
    counts = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"'{s}': "), F.col(f"n_{s}").cast("string")) for s in SEVERITY_WEIGHT]), F.lit("}"))
    whole = score_overall(findings).join(status_label(findings), "run_id").join(severity_counts(findings), "run_id")
    head = F.concat(F.lit("Overall: "), F.floor((F.round(F.col("score") * 10_000) + 50) / 100).cast("int").cast("string"), F.lit("% ("), "label", F.lit("). Severity counts: "), counts, F.lit("."))
    own = Window.partitionBy("run_id")
    weak = score_by_section(findings).filter("issues > 0")
    weak = weak.withColumn("title", F.lit("")) if titles is None else weak.join(titles, "section", "left")
    number = F.col("section").try_cast("int")
    weak = weak.withColumn("_n", F.row_number().over(own.orderBy(number.asc_nulls_last(), "section"))).filter(F.col("_n") <= DIGEST_SECTIONS)
    told = F.concat("section", F.lit(" "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col("issues").cast("string"), F.lit(")"))
    lines = lambda x, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", x.alias("x")))), lambda s: s["x"]), sep)
    weak = weak.groupBy("run_id").agg(F.concat(F.lit("Sections with issues: "), lines(told, ", ")).alias("weak"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY_WEIGHT)), F.col("severity")), F.lit(0))
    order = ["ord", "finding_id", "requirement_title", *(c for c in findings.columns if c == "place")]
    worst = findings.filter(is_issue()).withColumn("_n", F.row_number().over(own.orderBy(F.when(rank == 0, 9).otherwise(rank), *order))).filter(F.col("_n") <= DIGEST_ISSUES)
    fix = F.trim(F.coalesce("suggested_fix", F.lit("")))
    shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
    line = F.concat(F.lit("- ["), shown("section_no"), F.lit("] "), shown("severity"), F.lit("/"), shown("dimension"), F.lit(": "), shown("requirement_title"), F.when(fix != "", F.concat(F.lit(" → "), F.substring(fix, 1, FIX_CHARS))).otherwise(""))
    worst = worst.groupBy("run_id").agg(F.concat(F.lit("\nTop open findings (section | severity/dimension | requirement → fix):\n"), lines(line, "\n")).alias("worst"))
    met = whole.select("run_id", head.alias("head")).join(weak, "run_id", "left").join(worst, "run_id", "left")
    return met.select("run_id", F.substring(F.concat_ws("\n", "head", "weak", "worst"), 1, DIGEST_CHARS).alias("digest"))


_FIX = "CASE WHEN ord % 3 = 0 THEN NULL WHEN ord % 3 = 1 THEN '  ' ELSE repeat(concat('Add ', requirement_title, '. '), CAST(1 + run_id % 9 AS INTEGER)) END"
query(
    "audit_digest",
    f", f AS (SELECT *, {_FIX} AS fix FROM findings), g AS (SELECT run_id, coalesce({_SCORE}, 0) AS score, {_SCORE} AS s, {_CRIT} AS c, {', '.join(f'''count(*) FILTER (status IN ('partial','non_compliant') AND severity = '{s}') AS n_{s}''' for s in SEVERITY_WEIGHT)} FROM f GROUP BY run_id), "
    f"w AS (SELECT run_id, {_TOP} AS section, count(*) FILTER (status IN ('partial','non_compliant')) AS issues FROM f GROUP BY ALL), w12 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY try_cast(section AS INTEGER) NULLS LAST, section) AS n FROM w WHERE issues > 0 QUALIFY n <= 12), "
    "ww AS (SELECT run_id, 'Sections with issues: ' || string_agg(section || '  (' || issues || ')', ', ' ORDER BY n) AS weak FROM w12 GROUP BY run_id), "
    "i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 WHEN 'info' THEN 4 ELSE 9 END, ord, finding_id, requirement_title) AS n FROM f WHERE status IN ('partial','non_compliant') QUALIFY n <= 60), "
    "ii AS (SELECT run_id, chr(10) || 'Top open findings (section | severity/dimension | requirement → fix):' || chr(10) || string_agg('- [' || coalesce(section_no, 'None') || '] ' || coalesce(severity, 'None') || '/' || coalesce(dimension, 'None') || ': ' || coalesce(requirement_title, 'None') || CASE WHEN trim(coalesce(fix, '')) <> '' THEN ' → ' || left(trim(fix), 160) ELSE '' END, chr(10) ORDER BY n) AS worst FROM i GROUP BY run_id) "
    f"SELECT run_id, left(concat_ws(chr(10), 'Overall: ' || CAST(floor((round(score * 10000) + 50) / 100) AS INTEGER) || '% (' || {_LABEL} || '). Severity counts: {{' || {" || ', ' || ".join(f"'''{s}'': ' || n_{s}" for s in SEVERITY_WEIGHT)} || '}}.', weak, worst), 6000) AS digest FROM g LEFT JOIN ww USING (run_id) LEFT JOIN ii USING (run_id)",
    "findings",
)(lambda t: audit_digest(t.placed("findings").withColumn("suggested_fix", F.expr(_FIX))))


#: A page limit and the dashes of an enumeration.
PAGE_LIMIT = "(?i)(?:limited to|maximum[:]?|max(?:imum)?\\.?\\s*)\\s*([0-9]+)\\s*page"
DASHES = "[\\u2212\\u2013\\-\\u2022]"
SHORTEST_ITEM, LONGEST_ITEM = 6, 240


def requirement_extract(sections: DataFrame) -> DataFrame:
    """(doc_id, n, k, section_no, section_title, title, requirement_text, dimension, severity, kind, constraint_spec).

    ``sections`` are (doc_id, n, section_no, title, level, text). Each makes a requirement that it is there (k 0; major on
    the first level), one for a page limit in its text (k 1), and one for each item of 6 to 240 characters behind a dash or
    bullet that stands between blanks, the first one anywhere (k from 2). Null titles and texts are empty.
    """
    title, flat = F.coalesce("title", F.lit("")), F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " ")
    rows = sections.select("doc_id", "n", "section_no", title.alias("section_title"), "level", flat.alias("t"))
    first = F.regexp_instr("t", F.lit(DASHES))
    rows = rows.withColumn("items", F.when(first > 0, F.split(F.col("t").substr(first + 1, F.length("t")), f" {DASHES} ")).otherwise(F.array().cast("array<string>"))).withColumn("pages", F.regexp_extract("t", PAGE_LIMIT, 1))
    items = F.filter(F.transform("items", lambda x, i: F.struct((i + 2).cast("int").alias("k"), F.trim(x).alias("x"))), lambda s: F.length(s["x"]).between(SHORTEST_ITEM, LONGEST_ITEM))
    none = F.lit(None).cast("string")

    def told(k, title, text, dimension, severity, kind, spec):
        return F.struct(k.cast("int").alias("k"), title.alias("title"), text.alias("requirement_text"), F.lit(dimension).alias("dimension"), severity.alias("severity"), F.lit(kind).alias("kind"), spec.alias("constraint_spec"))

    name = F.col("section_title")
    there = told(F.lit(0), F.concat(F.lit("Include section: "), F.substring(name, 1, 60)), F.concat(F.lit("The document must address section "), "section_no", F.lit(" — "), name, F.lit(".")), "structure", F.when(F.col("level") == 1, "major").otherwise("minor"), "presence", none)
    limit = told(F.lit(1), F.concat(F.lit("Limit "), F.substring(name, 1, 40), F.lit(" length")), F.concat(name, F.lit(" should be limited to "), "pages", F.lit(" pages.")), "formatting", F.lit("minor"), "constraint", F.concat(F.lit('{"type": "max_pages", "value": '), F.col("pages").try_cast("long").cast("string"), F.lit("}")))
    listed = F.transform(items, lambda s: told(s["k"], F.substring(s["x"], 1, 60), F.concat(F.lit("The "), name, F.lit(" should include: "), s["x"]), "content", F.lit("minor"), "content", none))
    every = F.concat(F.array(there), F.filter(F.array(limit), lambda x: F.col("pages") != ""), listed)
    return rows.select("doc_id", "n", "section_no", "section_title", F.explode(every).alias("r")).select("doc_id", "n", "section_no", "section_title", "r.*")


_BODY = "concat(body, CASE doc_id % 4 WHEN 0 THEN concat(' It is limited to ', 1 + doc_id % 9, ' pages.') WHEN 1 THEN ' Maximum: 12 page' ELSE '' END)"
_DASH2 = DASHES.replace("\\u2212", "\\x{2212}").replace("\\u2013", "\\x{2013}").replace("\\u2022", "\\x{2022}")
query(
    "requirement_extract",
    f", r AS (SELECT doc_id, pos, line, {_HEAD} AS h FROM marked_lines WHERE line <> ''), s AS (SELECT *, CAST(sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS idx FROM r), "
    "z AS (SELECT doc_id, idx AS n, max(line) FILTER (h) AS heading, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h), '') AS body FROM s GROUP BY doc_id, idx), "
    f"y AS (SELECT doc_id, n, regexp_extract(trim(heading), '^([0-9]+(?:\\.[0-9]+)*)\\.?(\\s|$)', 1) AS section_no, trim(regexp_replace(trim(heading), '^[0-9]+(?:\\.[0-9]+)*\\.?\\s+', '')) AS section_title, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS level, regexp_replace({_BODY}, '\\s+', ' ', 'g') AS t FROM z WHERE heading IS NOT NULL), "
    f"x AS (SELECT *, regexp_extract(t, '{PAGE_LIMIT}', 1) AS pages, CASE WHEN regexp_matches(t, '{_DASH2}') THEN string_split_regex(substr(t, 1 + length(regexp_extract(t, '^.*?{_DASH2}'))), ' {_DASH2} ') ELSE [] END AS items FROM y), "
    "i AS (SELECT doc_id, n, section_no, section_title, unnest(range(len(items))) AS k, trim(unnest(items)) AS item FROM x) "
    "SELECT doc_id, n, 0 AS k, section_no, section_title, 'Include section: ' || left(section_title, 60) AS title, 'The document must address section ' || section_no || ' — ' || section_title || '.' AS requirement_text, 'structure' AS dimension, CASE level WHEN 1 THEN 'major' ELSE 'minor' END AS severity, 'presence' AS kind, NULL AS constraint_spec FROM x "
    "UNION ALL SELECT doc_id, n, 1, section_no, section_title, 'Limit ' || left(section_title, 40) || ' length', section_title || ' should be limited to ' || pages || ' pages.', 'formatting', 'minor', 'constraint', '{\"type\": \"max_pages\", \"value\": ' || CAST(pages AS BIGINT) || '}' FROM x WHERE pages <> '' "
    "UNION ALL SELECT doc_id, n, CAST(k + 2 AS INTEGER), section_no, section_title, left(item, 60), 'The ' || section_title || ' should include: ' || item, 'content', 'minor', 'content', NULL FROM i WHERE length(item) BETWEEN 6 AND 240",
    "marked_lines",
)(lambda t: requirement_extract(_guideline(t)))


def _guideline(t) -> DataFrame:
    """The headed sections of each document, with a page limit in some."""
    s = sectionize_text(t.marked_lines).filter("heading IS NOT NULL")
    return s.select("doc_id", F.col("idx").alias("n"), X.section_number(F.col("heading")).alias("section_no"), X.strip_section_number(F.col("heading")).alias("title"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END").alias("level"), F.expr(_BODY).alias("text"))
