"""Field profiles, versions of documents and their differences, and the registered uses of the text functions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.alignment import equal_pairs, in_order_pairs
from leafmill.operators.scoring import is_issue
from leafmill.plans.registry import query


def doc_profile(lines: DataFrame) -> DataFrame:
    """Type, version and author of each document from its first lines."""
    head = lines.filter("pos < 12").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("h"))
    return head.select("doc_id", X.document_type(F.col("h")).alias("type"), X.version_of(F.col("h")).alias("version"), F.regexp_extract("h", "(?i)prepared by:\\s*([^\\n]+)", 1).alias("author"))


_KINDS = (("protocol", "protocol"), ("report", "report"), ("sop|standard operating procedure|procedure", "sop"), ("policy", "policy"), ("plan", "plan"), ("specification", "specification"))
query(
    "doc_profile",
    ", h AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS h FROM marked_lines WHERE pos < 12 GROUP BY doc_id) SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(h, '(?i)(^|[^\\p{{L}}\\p{{N}}])({p})($|[^\\p{{L}}\\p{{N}}])') THEN '{k}'" for p, k in _KINDS)
    + " ELSE 'document' END AS type, regexp_extract(h, '(?i)(?:^|[^\\p{L}\\p{N}])(?:version|rev(?:ision)?|ver)\\.?\\s*[:#]?\\s*v?([0-9]+(?:\\.[0-9]+)*)', 1) AS version, regexp_extract(h, '(?i)prepared by:\\s*([^\\n]+)', 1) AS author FROM h",
    "marked_lines",
)(lambda t: doc_profile(t.marked_lines))


@query("version_bump", "SELECT doc_id, pos, v, CASE len(p) WHEN 0 THEN v WHEN 1 THEN p[1] || '.1' ELSE array_to_string(list_append(p[:-2], CAST(p[-1] + 1 AS BIGINT)), '.') END AS bumped FROM (SELECT *, list_transform(list_filter(string_split(v, '.'), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: CAST(x AS BIGINT)) AS p FROM (SELECT doc_id, pos, regexp_extract(line, '^Version: ([0-9.]+)', 1) AS v FROM marked_lines)) WHERE v <> ''", "marked_lines")
def _version_bump(t):
    v = F.regexp_extract("line", "^Version: ([0-9.]+)", 1)
    return t.marked_lines.select("doc_id", "pos", v.alias("v")).filter("v <> ''").select("doc_id", "pos", "v", X.bump(F.col("v")).alias("bumped"))


@query("version_gt", "SELECT doc_id, max(CAST(split_part(v, '.', 1) AS INTEGER) * 1000 + CAST(split_part(v, '.', 2) AS INTEGER)) AS newest FROM (SELECT doc_id, regexp_extract(line, '^Version: ([0-9]+[.][0-9]+)', 1) AS v FROM marked_lines) WHERE v <> '' GROUP BY doc_id", "marked_lines")
def _version_gt(t):
    """The newest version of a document, compared number by number."""
    v = t.marked_lines.select("doc_id", F.regexp_extract("line", "^Version: ([0-9]+[.][0-9]+)", 1).alias("v")).filter("v <> ''")
    newest = v.groupBy("doc_id").agg(F.max(X.version_parts(F.col("v"))).alias("p"))
    return newest.select("doc_id", (F.coalesce(F.get("p", F.lit(0)), F.lit(0)) * 1000 + F.coalesce(F.get("p", F.lit(1)), F.lit(0))).alias("newest"))


#: Date formats that are tried in order; the first that parses is kept.
DATE_FORMATS = ("dd-MMM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "d MMMM yyyy", "MMMM d, yyyy", "dd MMM yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "yyyyMMdd")


def reformat_date(value, today):
    """``today`` in the format of a date string; dd-MMM-yyyy where none fits."""
    tried = [F.when(F.try_to_timestamp(value, F.lit(f)).isNotNull(), F.date_format(today, f)) for f in DATE_FORMATS]
    return F.coalesce(*tried, F.date_format(today, DATE_FORMATS[0]))


query("date_reformat", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE '?' END AS given, CASE o_orderkey % 3 WHEN 0 THEN '2024-03-09' WHEN 1 THEN '09.03.2024' ELSE '09-Mar-2024' END AS renewed FROM orders")(
    lambda t: t.orders.select("o_orderkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE '?' END").alias("given")).withColumn("renewed", reformat_date(F.col("given"), F.lit("2024-03-09").cast("date")))
)
query("section_numbers", "SELECT doc_id, pos, regexp_extract(trim(line), '^([0-9]+(?:\\.[0-9]+)*)\\.?(\\s|$)', 1) AS number, trim(regexp_replace(trim(line), '^[0-9]+(?:\\.[0-9]+)*\\.?\\s+', '')) AS bare FROM marked_lines", "marked_lines")(
    lambda t: t.marked_lines.select("doc_id", "pos", X.section_number(F.col("line")).alias("number"), X.strip_section_number(F.col("line")).alias("bare"))
)
query("list_leader_strip", "SELECT doc_id, pos, regexp_replace(line, '^\\s*([-*\\x{2022}\\x{b7}\\x{25cf}]|([0-9]{1,3}|[a-z])[.)])\\s+', '') AS bare FROM marked_lines", "marked_lines")(lambda t: t.marked_lines.select("doc_id", "pos", X.strip_leader(F.col("line")).alias("bare")))
query("uppercase_like", "SELECT doc_id, pos, length(regexp_replace(line, '[^\\p{L}]', '', 'g')) > 0 AND length(regexp_replace(line, '[^\\p{Lu}]', '', 'g')) >= 0.85 * length(regexp_replace(line, '[^\\p{L}]', '', 'g')) AND len(string_split(trim(regexp_replace(line, '[\\s\\x{0b}\\x{85}\\x{a0}]+', ' ', 'g')), ' ')) <= 12 AS upper_like FROM marked_lines", "marked_lines")(
    lambda t: t.marked_lines.select("doc_id", "pos", X.uppercase_like(F.col("line")).alias("upper_like"))
)
query("quote_norm", "SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM benchmark")(lambda t: t.benchmark.select("item_id", X.quote_norm(F.col("text")).alias("norm")))
query("bytes_humanise", "SELECT artifact_id, CASE WHEN u = 1 THEN size_bytes || ' B' ELSE n // 10 || '.' || n % 10 || CASE u WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END END AS size FROM (SELECT *, (CAST(size_bytes AS HUGEINT) * 20 + u) // (2 * u) AS n FROM (SELECT artifact_id, size_bytes, CASE WHEN size_bytes < 1024 THEN 1 WHEN size_bytes < 1048576 THEN 1024 WHEN size_bytes < 1073741824 THEN 1048576 ELSE 1073741824 END AS u FROM artifacts))", "artifacts")(
    lambda t: t.artifacts.select("artifact_id", X.humanise(F.col("size_bytes")).alias("size"))
)
query("relative_age", "SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2030-01-01') - floor(epoch(ts)) AS BIGINT) AS s FROM events)")(
    lambda t: t.events.select("event_id", X.age(F.unix_timestamp(F.lit("2030-01-01").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("age"))
)
query("score_band", "SELECT finding_id, CASE WHEN confidence >= 0.75 THEN 'good' WHEN confidence >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM findings", "findings")(lambda t: t.findings.select("finding_id", X.band(F.col("confidence").cast("double")).alias("band")))


# ------------------------------------------------------------------------------------------ versions


def line_set_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines that only one version has, counted with their repeats."""
    count = lambda df, n: df.groupBy("doc_id", "line").agg(F.count("*").alias(n))
    both = count(old, "o").join(count(new, "n"), ["doc_id", "line"], "full").select("doc_id", "line", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("n", F.lit(0)).alias("n"))
    return both.filter("o <> n").select("doc_id", "line", F.when(F.col("o") > F.col("n"), "removed").otherwise("added").alias("change"), F.abs(F.col("o") - F.col("n")).alias("times"))


query(
    "line_set_diff",
    ", o AS (SELECT doc_id, line, count(*) AS o FROM doc_versions WHERE version = 1 GROUP BY ALL), n AS (SELECT doc_id, line, count(*) AS n FROM doc_versions WHERE version = 2 GROUP BY ALL) SELECT doc_id, line, CASE WHEN coalesce(o, 0) > coalesce(n, 0) THEN 'removed' ELSE 'added' END AS change, abs(coalesce(o, 0) - coalesce(n, 0)) AS times FROM o FULL JOIN n USING (doc_id, line) WHERE coalesce(o, 0) <> coalesce(n, 0)",
    "doc_versions",
)(lambda t: line_set_diff(t.doc_versions.filter("version = 1").select("doc_id", "line"), t.doc_versions.filter("version = 2").select("doc_id", "line")))
query("section_changed", ", o AS (SELECT doc_id, line, count(*) AS o FROM doc_versions WHERE version = 1 GROUP BY ALL), n AS (SELECT doc_id, line, count(*) AS n FROM doc_versions WHERE version = 2 GROUP BY ALL) SELECT DISTINCT doc_id FROM o FULL JOIN n USING (doc_id, line) WHERE coalesce(o, 0) <> coalesce(n, 0)", "doc_versions")(
    lambda t: line_set_diff(t.doc_versions.filter("version = 1").select("doc_id", "line"), t.doc_versions.filter("version = 2").select("doc_id", "line")).select("doc_id").distinct()
)


def _word_ops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, olds, news in zip(pdf["doc_id"], pdf["olds"], pdf["news"], strict=True):
            x, y = ([r["line"].split() for r in rows] for rows in (olds, news))
            pairs = in_order_pairs(olds, news)
            for i, j in pairs:
                kept = len(equal_pairs(x[i], y[j]))
                out.append((doc, olds[i]["pos"], news[j]["pos"], kept, len(x[i]) - kept, len(y[j]) - kept))
            gone, come = set(range(len(x))) - {i for i, _ in pairs}, set(range(len(y))) - {j for _, j in pairs}
            out += [(doc, olds[i]["pos"], None, 0, len(x[i]), 0) for i in sorted(gone)]
            out += [(doc, None, news[j]["pos"], 0, 0, len(y[j])) for j in sorted(come)]
        frame = pd.DataFrame(out, columns=["doc_id", "pos", "new_pos", "kept", "deleted", "inserted"])
        yield frame.astype({"pos": "Int32", "new_pos": "Int32"})


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Words kept, deleted and inserted by line: pos in the old version, new_pos in the new, null where it has no such line.

    A line that both versions have, as often, is unchanged wherever it stands, and has no row. The others of a document
    pair in order where they are like (half of their words in common); the rest is deleted or inserted whole.
    """
    both = old.select("doc_id", "pos", "line", F.lit(0).alias("v")).union(new.select("doc_id", "pos", "line", F.lit(1)))
    at = lambda v: F.array_sort(F.collect_list(F.when(F.col("v") == v, F.col("pos"))))
    lines = both.groupBy("doc_id", "line").agg(at(0).alias("o"), at(1).alias("n")).filter("size(o) <> size(n)")
    rest = lambda a, b: F.expr(f"transform(slice({a}, size({b}) + 1, greatest(0, size({a}) - size({b}))), p -> named_struct('pos', p, 'line', line))")
    left = lines.select("doc_id", rest("o", "n").alias("o"), rest("n", "o").alias("n"))
    docs = left.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("o"))).alias("olds"), F.array_sort(F.flatten(F.collect_list("n"))).alias("news"))
    return docs.mapInPandas(_word_ops, "doc_id long, pos int, new_pos int, kept long, deleted long, inserted long")


query("version_diff")(lambda t: version_diff(t.doc_versions.filter("version = 1"), t.doc_versions.filter("version = 2")))
query(
    "changed_sections",
    ", c AS (SELECT doc_id, line, count(*) FILTER (version = 1) AS o, count(*) FILTER (version = 2) AS n FROM doc_versions GROUP BY doc_id, line) SELECT doc_id, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS n_removed, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS n_added FROM c WHERE o <> n GROUP BY doc_id",
    "doc_versions",
)(lambda t: changed_sections(t.doc_versions))


def changed_sections(versions: DataFrame) -> DataFrame:
    """(doc_id, n_removed, n_added) of documents whose lines differ: lines of version 1 or 2 alone, repeats counted."""
    c = versions.groupBy("doc_id", "line").agg(F.count_if(F.col("version") == 1).alias("o"), F.count_if(F.col("version") == 2).alias("n")).filter("o <> n")
    return c.groupBy("doc_id").agg(F.sum(F.expr("greatest(o - n, 0)")).alias("n_removed"), F.sum(F.expr("greatest(n - o, 0)")).alias("n_added"))


query("base_version_pick", "SELECT project_id, arg_max(run_id, created_at * 0 + run_id) AS base, count(*) + 1 AS target FROM (SELECT project_id, run_id, 0 AS created_at FROM runs) GROUP BY project_id", "runs")(
    lambda t: t.runs.groupBy("project_id").agg(F.max("run_id").alias("base"), (F.count("*") + 1).alias("target"))
)
query("version_digest", "SELECT project_id, string_agg(CAST(run_id AS VARCHAR) || ':' || status, ', ' ORDER BY run_id DESC) AS digest FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY run_id DESC) <= 4) GROUP BY project_id", "runs")(
    lambda t: t.runs.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("run_id")))).filter("_n <= 4").groupBy("project_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_id", "status")), asc=False), lambda x: F.concat(x["run_id"].cast("string"), F.lit(":"), x["status"])), ", ").alias("digest")
    )
)
query("rag_gap_count", "SELECT template_id, count(*) FILTER (ord % 4 = 2) AS n_rag FROM slots GROUP BY template_id", "slots")(lambda t: t.slots.groupBy("template_id").agg(F.count_if(F.col("ord") % 4 == 2).alias("n_rag")))
def slot_flags(slots: DataFrame, rules: Sequence[str] = ()) -> DataFrame:
    """(template_id, ord, kind, note): what is wrong with a slot's body, a row a note.

    ``slots`` hold template_id, ord, title, required, keywords (an array) and body. A required slot is empty, or a body is
    a placeholder, or shorter than 60 characters; none of the expected keywords occurs in it; or one of the first ten
    ``rules`` of the form 'must include: X' is broken, by an empty body too. A note's kind is missing, length or format.
    A null body counts as empty, null keywords as none.
    """
    body, title, low = F.trim(F.coalesce("body", F.lit(""))), F.col("title"), F.lower(F.trim(F.coalesce("body", F.lit(""))))
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    state = (
        F.when(F.col("required") & (body == ""), said("Required section '", title, "' is empty."))
        .when(low.startswith("[todo"), said("Section '", title, "' is a TODO placeholder."))
        .when((body != "") & (F.length(body) < 60), said("Section '", title, "' is suspiciously short (", F.length(body).cast("string"), " chars)."))
    )
    silent = (F.size("keywords") > 0) & (body != "") & ~F.exists("keywords", lambda k: low.contains(F.lower(k)))
    notes = [state, F.when(silent, said("Section '", title, "' does not mention any expected keyword."))]
    for rule in rules[:10]:
        needle = rule.split(":", 1)[1].strip().lower() if rule.lower().startswith("must include:") else ""
        if needle:
            notes.append(F.when(~low.contains(needle), F.lit(f"Format rule violated: {rule}")))
    each = slots.select("template_id", "ord", F.explode(F.array_compact(F.array(*notes))).alias("note"))
    kind = F.when(F.lower("note").rlike("empty|missing"), "missing").when(F.lower("note").rlike("short|length"), "length").otherwise("format")
    return each.select("template_id", "ord", kind.alias("kind"), "note")


_FLAGS = (
    ", b AS (SELECT template_id, ord, title, required, trim(coalesce(CASE WHEN ord = 7 THEN '[TODO] ' || line ELSE line END, '')) AS body, CASE WHEN ord % 2 = 0 THEN [lower(title), 'The'] ELSE [] END AS kw FROM slots s LEFT JOIN lines l ON l.doc_id = s.template_id AND l.pos = s.ord), "
    "nt AS (SELECT template_id, ord, CASE WHEN required AND body = '' THEN 'Required section ''' || title || ''' is empty.' WHEN starts_with(lower(body), '[todo') THEN 'Section ''' || title || ''' is a TODO placeholder.' WHEN body <> '' AND length(body) < 60 THEN 'Section ''' || title || ''' is suspiciously short (' || length(body) || ' chars).' END AS note FROM b "
    "UNION ALL SELECT template_id, ord, 'Section ''' || title || ''' does not mention any expected keyword.' FROM b WHERE len(kw) > 0 AND body <> '' AND len(list_filter(kw, lambda k: contains(lower(body), lower(k)))) = 0 "
    "UNION ALL SELECT template_id, ord, 'Format rule violated: Must include: of' FROM b WHERE NOT contains(lower(body), 'of')), "
    "fl AS (SELECT template_id, ord, CASE WHEN regexp_matches(lower(note), 'empty|missing') THEN 'missing' WHEN regexp_matches(lower(note), 'short|length') THEN 'length' ELSE 'format' END AS kind, note FROM nt WHERE note IS NOT NULL)"
)


def _filled(t) -> DataFrame:
    """Slots with a line of the document of their template's number as body; every other slot expects keywords."""
    met = t.slots.join(t.lines.selectExpr("doc_id AS template_id", "pos AS ord", "line"), ["template_id", "ord"], "left")
    return met.selectExpr("template_id", "ord", "title", "required", "CASE WHEN ord = 7 THEN concat('[TODO] ', line) ELSE line END AS body", "CASE WHEN ord % 2 = 0 THEN array(lower(title), 'The') ELSE array() END AS keywords")


def _flags(t) -> DataFrame:
    return slot_flags(_filled(t), ["Must include: of", "Use short words"])


query("slot_flags", _FLAGS + " SELECT * FROM fl", "slots lines")(_flags)
query(
    "legacy_result_score",
    _FLAGS + ", r AS (SELECT template_id AS run_id, CASE WHEN template_id % 5 = 0 THEN 0.25 END AS score, count(*) FILTER (required) AS required_total, count(*) FILTER (required AND body = '') AS missing FROM b GROUP BY template_id), "
    "c AS (SELECT template_id AS run_id, count(*) FILTER (kind = 'missing') AS critical, count(*) FILTER (kind IN ('length', 'format')) AS minor FROM fl GROUP BY template_id) "
    "SELECT run_id, round(coalesce(CAST(score AS DOUBLE), (required_total - missing) / required_total, 0), 6) AS overall, coalesce(critical, 0) AS critical, 0 AS major, coalesce(minor, 0) AS minor, 0 AS info FROM r LEFT JOIN c USING (run_id)",
    "slots lines",
)(lambda t: _legacy(t))


def _legacy(t) -> DataFrame:
    """Templates as runs with flags; every fifth has a stored score."""
    from leafmill.operators.mapping import legacy_result

    empty = F.trim(F.coalesce("body", F.lit(""))) == ""
    runs = _filled(t).groupBy(F.col("template_id").alias("run_id")).agg(F.count_if("required").alias("required_total"), F.count_if(F.col("required") & empty).alias("missing"))
    runs = runs.withColumn("score", F.when(F.col("run_id") % 5 == 0, F.lit(0.25)))
    return legacy_result(runs, _flags(t).select(F.col("template_id").alias("run_id"), "kind"))


query("suggestion_clean", "SELECT conv_id, turn, left(content, 80) AS title, left(content, 280) AS detail FROM history WHERE trim(content) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3", "history")(
    lambda t: t.history.filter(F.trim("content") != "").withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("_n <= 3").select("conv_id", "turn", F.substring("content", 1, 80).alias("title"), F.substring("content", 1, 280).alias("detail"))
)
def best_section(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, pos, hits): the section (doc_id, pos, text) with the most of a question's words; the first wins, even with 0.

    ``asked`` is (doc_id, query), a question a document. Words are runs of a-z and digits; a question's have three
    characters at least. Null texts and questions have no words.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    wanted = asked.select("doc_id", F.filter(words("query"), lambda x: F.length(x) >= 3).alias("q"))
    met = sections.join(wanted, "doc_id").select("doc_id", "pos", F.size(F.array_intersect(words("text"), "q")).cast("long").alias("hits"))
    return met.groupBy("doc_id").agg(F.max_by("pos", F.struct("hits", -F.col("pos"))).alias("pos"), F.max("hits").alias("hits"))


query(
    "best_section",
    ", m AS (SELECT count(*) AS n FROM benchmark), q AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), lambda x: length(x) >= 3) AS q FROM documents d, m JOIN benchmark b ON b.item_id = d.doc_id % n), "
    "h AS (SELECT doc_id, pos, len(list_intersect(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')), q)) AS hits FROM lines JOIN q USING (doc_id)) SELECT doc_id, arg_max(pos, (hits, -pos)) AS pos, max(hits) AS hits FROM h GROUP BY doc_id",
    "lines",
)(lambda t: _best_sections(t))


def _best_sections(t) -> DataFrame:
    """Lines as sections; each document is asked the item of its number modulo the number of items."""
    n = t.benchmark.agg(F.count("*").alias("n"))  # one row
    items = t.documents.select("doc_id").join(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"))
    return best_section(t.lines.withColumnRenamed("line", "text"), items.join(t.benchmark.select("item_id", F.col("text").alias("query")), "item_id"))


query("compliance_summary_table", ", s AS (SELECT run_id, dimension, count(*) AS total, count(*) FILTER (status IN ('partial','non_compliant')) AS issues FROM findings GROUP BY ALL) SELECT run_id, dimension, total, issues, CASE WHEN issues = 0 THEN 'ok' WHEN issues < total THEN 'partial' ELSE 'open' END AS state FROM s", "findings")(
    lambda t: t.findings.groupBy("run_id", "dimension").agg(F.count("*").alias("total"), F.count_if(is_issue()).alias("issues")).withColumn("state", F.when(F.col("issues") == 0, "ok").when(F.col("issues") < F.col("total"), "partial").otherwise("open"))
)
query("run_trace_list", "SELECT run_id, string_agg(status, '>' ORDER BY ts, event_id) AS trace FROM trace_events GROUP BY run_id", "trace_events")(
    lambda t: t.trace_events.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "status"))), lambda x: x["status"]), ">").alias("trace"))
)
