"""Joins of audits, templates, layouts and versions, each on an equality first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.retrieval import audit_tokens
from leafmill.operators.scoring import top_section
from leafmill.plans.registry import query
from leafmill.plans.shared import written

_TOP = "CASE WHEN coalesce(trim(split_part(section_no, '.', 1)), '') = '' THEN '—' ELSE split_part(section_no, '.', 1) END"

# ------------------------------------------------------------------------------------------ templates

_BODIES = ", mappings AS (SELECT template_id, ord, template_id % 1000 AS doc_id, ord % 4 AS idx, CASE ord % 4 WHEN 0 THEN 'fill' WHEN 1 THEN 'rewrite' WHEN 2 THEN 'rag' ELSE 'flag' END AS action FROM slots WHERE ord % 5 <> 4)"


def mappings(t) -> DataFrame:
    return t.slots.filter("ord % 5 <> 4").selectExpr("template_id", "ord", "template_id % 1000 AS doc_id", "ord % 4 AS idx", "CASE ord % 4 WHEN 0 THEN 'fill' WHEN 1 THEN 'rewrite' WHEN 2 THEN 'rag' ELSE 'flag' END AS action")


def sections(t) -> DataFrame:
    return t.lines.selectExpr("doc_id", "pos AS idx", "line AS body")


def slot_bodies(slots: DataFrame, mapped: DataFrame, sections: DataFrame) -> DataFrame:
    """Each slot's original body; empty where nothing is mapped; source says which section."""
    met = slots.join(mapped, ["template_id", "ord"], "left").join(sections, ["doc_id", "idx"], "left")
    source = F.when(F.col("body").isNotNull(), F.concat(F.lit("draft#section-"), "idx"))
    return met.select("template_id", "ord", "title", "level", "action", F.coalesce("body", F.lit("")).alias("original"), source.alias("source"))


_SLOT_BODIES = _BODIES + ", b AS (SELECT s.template_id, s.ord, title, level, action, coalesce(line, '') AS original, CASE WHEN line IS NOT NULL THEN 'draft#section-' || idx END AS source FROM slots s LEFT JOIN mappings m USING (template_id, ord) LEFT JOIN lines l ON l.doc_id = m.doc_id AND l.pos = m.idx)"
query("slot_bodies_join", _SLOT_BODIES + " SELECT template_id, ord, original, source FROM b", "slots lines")(lambda t: slot_bodies(t.slots, mappings(t), sections(t)).select("template_id", "ord", "original", "source"))


def slot_rewrite(bodies: DataFrame) -> DataFrame:
    """Proposed text by action: the original, a rewrite, passages (none for a parent heading), or nothing."""
    parent = F.coalesce(F.lead("level").over(Window.partitionBy("template_id").orderBy("ord")) > F.col("level"), F.lit(False))
    proposed = (
        F.when(F.col("action") == "fill", F.col("original"))
        .when(F.col("action") == "rewrite", F.concat(F.lit("Rewritten: "), "original"))
        .when((F.col("action") == "rag") & ~parent, F.concat(F.lit("Passages for "), "title"))
        .otherwise("")
    )
    return bodies.select("template_id", "ord", "original", proposed.alias("proposed"), "source")


_REWRITE = ", r AS (SELECT template_id, ord, original, CASE WHEN action = 'fill' THEN original WHEN action = 'rewrite' THEN 'Rewritten: ' || original WHEN action = 'rag' AND NOT coalesce(lead(level) OVER (PARTITION BY template_id ORDER BY ord) > level, false) THEN 'Passages for ' || title ELSE '' END AS proposed, source FROM b)"
query("slot_rewrite_join", _SLOT_BODIES + _REWRITE + " SELECT template_id, ord, proposed FROM r", "slots lines")(lambda t: slot_rewrite(slot_bodies(t.slots, mappings(t), sections(t))).select("template_id", "ord", "proposed"))
query("review_diff", _SLOT_BODIES + _REWRITE + " SELECT template_id, ord, original, trim(regexp_replace(proposed, '(?m)^\\[TODO\\]\\s.*$', '', 'g')) AS proposed, source, original <> proposed AS changed FROM r", "slots lines")(
    lambda t: _review(t)
)


#: Tasks, for each core, that the rows of both sides are dealt to.
SET_TASKS_A_CORE = 64


def slot_set_equal(slots: DataFrame, rewritten: DataFrame) -> DataFrame:
    """template_id, missing, surplus: slots without their rewrite and rewrites (or repeated ones) without a slot."""
    mark = lambda df, by: df.select("template_id", "ord", F.lit(by).alias("d"))
    both = mark(slots, 1).union(mark(rewritten, -1))
    # A number of partitions that is given stays as it is: few bytes a row would else become few tasks with large tables.
    tasks = SET_TASKS_A_CORE * both.sparkSession.sparkContext.defaultParallelism
    net = both.repartition(tasks, "template_id").groupBy("template_id", "ord").agg(F.sum("d").alias("d"))
    return net.groupBy("template_id").agg(F.sum(F.greatest("d", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("surplus"))


_MODEL = ", m AS (SELECT o_custkey AS template_id, l_partkey % 30 AS ord, CASE WHEN l_suppkey % 5 = 0 THEN 999 ELSE l_suppkey % 4 END AS idx, l_discount * 10 AS confidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
query("slot_set_equal", _MODEL.replace("m AS", "r AS") + ", a AS (SELECT template_id, ord FROM slots), d AS (SELECT template_id, ord FROM r), m AS (SELECT template_id, count(*) AS n FROM (FROM a EXCEPT ALL FROM d) GROUP BY ALL), p AS (SELECT template_id, count(*) AS n FROM (FROM d EXCEPT ALL FROM a) GROUP BY ALL), t AS (SELECT template_id FROM a UNION SELECT template_id FROM d) SELECT template_id, coalesce(m.n, 0) AS missing, coalesce(p.n, 0) AS surplus FROM t LEFT JOIN m USING (template_id) LEFT JOIN p USING (template_id)", "slots")(
    lambda t: slot_set_equal(t.slots, _model_mappings(t))
)


def _review(t) -> DataFrame:
    """A row a slot: original, proposed without TODO lines, source, and whether they differ."""
    r = slot_rewrite(slot_bodies(t.slots, mappings(t), sections(t)))
    return r.select("template_id", "ord", "original", F.trim(X.strip_todo(F.col("proposed"))).alias("proposed"), "source", (F.col("original") != F.col("proposed")).alias("changed"))


_DECISIONS = ", decisions AS (SELECT template_id, ord, CASE ord % 3 WHEN 0 THEN true WHEN 1 THEN false END AS accepted, CASE WHEN ord % 7 = 0 THEN 'Edited by reviewer' END AS edited FROM slots WHERE ord % 2 = 0)"
query("decision_overlay", _SLOT_BODIES + _REWRITE + _DECISIONS + " SELECT template_id, ord, CASE WHEN accepted IS NOT DISTINCT FROM false THEN '' ELSE coalesce(edited, proposed, original) END AS final FROM r LEFT JOIN decisions USING (template_id, ord)", "slots lines")(
    lambda t: decision_overlay(slot_rewrite(slot_bodies(t.slots, mappings(t), sections(t))), _decisions(t))
)


def _decisions(t) -> DataFrame:
    return t.slots.filter("ord % 2 = 0").selectExpr("template_id", "ord", "CASE ord % 3 WHEN 0 THEN true WHEN 1 THEN false END AS accepted", "CASE WHEN ord % 7 = 0 THEN 'Edited by reviewer' END AS edited")


def decision_overlay(diffs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rejected: nothing; else the reviewer's edit, the proposal, or the original. Undecided is not rejected."""
    met = diffs.join(decisions, ["template_id", "ord"], "left")
    return met.select("template_id", "ord", F.when(F.col("accepted").eqNullSafe(False), "").otherwise(F.coalesce("edited", "proposed", "original")).alias("final"))


query("decision_plan", _DECISIONS + ", k AS (SELECT s.template_id, s.ord, title, accepted IS NOT DISTINCT FROM false AS removed FROM slots s LEFT JOIN decisions d USING (template_id, ord)) SELECT template_id, ord, title, removed, last_value(CASE WHEN NOT removed THEN ord END IGNORE NULLS) OVER (PARTITION BY template_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM k", "slots")(
    lambda t: t.slots.join(_decisions(t), ["template_id", "ord"], "left").withColumn("removed", F.col("accepted").eqNullSafe(False)).select(
        "template_id", "ord", "title", "removed", F.last(F.when(~F.col("removed"), F.col("ord")), ignorenulls=True).over(Window.partitionBy("template_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)).alias("anchor")
    )
)
query("suggestion_overlay", _SLOT_BODIES + ", sug AS (SELECT template_id, ord, 'Suggested ' || title AS body FROM slots WHERE ord % 6 = 1) SELECT template_id, ord, coalesce(body, original) AS body FROM b LEFT JOIN sug USING (template_id, ord)", "slots lines")(
    lambda t: slot_bodies(t.slots, mappings(t), sections(t)).join(t.slots.filter("ord % 6 = 1").selectExpr("template_id", "ord", "concat('Suggested ', title) AS body"), ["template_id", "ord"], "left").select("template_id", "ord", F.coalesce("body", "original").alias("body"))
)
query(
    "mapping_validate",
    _MODEL + ", d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY template_id, ord ORDER BY seq) = 1) "
    "SELECT template_id, ord, CASE WHEN idx < 4 THEN idx END AS idx, CASE WHEN idx < 4 THEN least(1, confidence) ELSE 0 END AS confidence, CASE WHEN idx < 4 THEN 'rewrite' ELSE 'rag' END AS action FROM d SEMI JOIN slots USING (template_id, ord)",
    "slots",
)(lambda t: mapping_validate(_model_mappings(t), t.slots))


def _model_mappings(t) -> DataFrame:
    """What a model answered for the template of an order's customer, also for slots that there aren't and more than once."""
    lines = t.placed("lineitem").join(t.orders.selectExpr("o_orderkey AS l_orderkey", "o_custkey AS template_id"), "l_orderkey")
    return lines.selectExpr("template_id", "l_partkey % 30 AS ord", "CASE WHEN l_suppkey % 5 = 0 THEN 999 ELSE l_suppkey % 4 END AS idx", "l_discount * 10 AS confidence", "l_orderkey * 10 + l_linenumber AS seq", "place")


def mapping_validate(model: DataFrame, slots: DataFrame, n_sections: int = 4) -> DataFrame:
    """A model's mappings: the first of each known slot; an unknown section becomes a retrieval of confidence 0.

    Of equal seq the smallest ``place`` counts, where ``model`` has that column.
    """
    order = ["seq", *(c for c in model.columns if c == "place")]
    first = model.withColumn("_n", F.row_number().over(Window.partitionBy("template_id", "ord").orderBy(*order))).filter("_n = 1")
    known = F.col("idx") < n_sections
    rows = first.join(slots.select("template_id", "ord"), ["template_id", "ord"], "left_semi")
    return rows.select("template_id", "ord", F.when(known, F.col("idx")).alias("idx"), F.when(known, F.least(F.lit(1.0), F.col("confidence").cast("double"))).otherwise(0.0).alias("confidence"), F.when(known, "rewrite").otherwise("rag").alias("action"))


# ------------------------------------------------------------------------------------------ audits

_SAID = (
    "CASE l_suppkey % 5 WHEN 0 THEN 'Compliant' WHEN 1 THEN ' PARTIAL ' WHEN 2 THEN 'non_compliant' WHEN 3 THEN 'not_applicable' ELSE 'bogus' END AS status, CASE l_suppkey % 6 WHEN 0 THEN 'Critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' WHEN 3 THEN 'info' WHEN 4 THEN 'dire' END AS severity, "
    "CASE WHEN l_suppkey % 7 = 3 THEN NULL ELSE l_discount * 15 END AS confidence, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('quote ', l_partkey) END AS evidence, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 2 = 0 END AS grounded, "
    "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE repeat(concat('why ', l_partkey, ' '), CAST(1 + l_suppkey % 80 AS INTEGER)) END AS rationale, l_orderkey * 10 + l_linenumber AS seq"
)
_VERDICTS = f", verdicts AS (SELECT l_partkey AS requirement_id, {_SAID} FROM lineitem WHERE l_returnflag <> 'R')"
#: What is added to a rationale, and characters that stay of evidence and rationales.
UNGROUNDED = " [Quoted evidence could not be located in the document and was removed.]"
CORRECTED = " [Corrected on independent re-check: the document does address this.]"
NOT_ASSESSED = "Not assessed — the auditor did not return a verdict for this requirement."
EVIDENCE_CHARS, RATIONALE_CHARS, NOTED_CHARS = 500, 600, 700
STATUSES, SEVERITIES = ("compliant", "partial", "non_compliant", "not_applicable"), ("critical", "major", "minor", "info")


def one_of(value: Column, known: tuple[str, ...], other: Column) -> Column:
    """The value without blanks and upper case where it is known, else another."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*known), low).otherwise(other)


def bounded_severity(proposed: Column, default: Column) -> Column:
    """A proposed severity at most one step from the default one, which stands otherwise."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, SEVERITIES)), c)
    return F.when((rank(proposed) > 0) & (rank(default) > 0) & (F.abs(rank(proposed) - rank(default)) <= 1), proposed).otherwise(default)


def requirement_verdict_join(requirements: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A finding a requirement: requirement_id, status, severity, confidence, evidence, rationale.

    ``verdicts`` are (requirement_id, status, severity, confidence, evidence, grounded, rationale, seq); of several the last
    counts. Without one the requirement is not assessed: it does not apply, with confidence 0. An unknown status is a failure,
    a confidence lies between 0 and 1 (0.6 if there is none), and a severity stays within one step of the requirement's
    default. Evidence that is not grounded in the document goes, with a note, and caps the confidence at 0.4. Evidence is
    cut to 500 characters, rationales to 600, or 700 with the note. Verdicts without a requirement have no row.
    """
    said = F.struct("status", "severity", "confidence", "evidence", "grounded", "rationale")
    last = verdicts.groupBy("requirement_id").agg(F.max_by(said, "seq").alias("v"))
    met = requirements.join(last, "requirement_id", "left")
    none, default = F.col("v").isNull(), F.col("severity_default")
    cut = lambda c, n: F.nullif(F.substring(F.coalesce(c, F.lit("")), 1, n), F.lit(""))
    evidence, rationale = cut("v.evidence", EVIDENCE_CHARS), cut("v.rationale", RATIONALE_CHARS)
    invented = F.coalesce(evidence.isNotNull() & ~F.coalesce("v.grounded", F.lit(False)), F.lit(False))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("v.confidence").cast("double"), F.lit(0.6))))
    return met.select(
        "requirement_id",
        F.when(none, "not_applicable").otherwise(one_of(F.col("v.status"), STATUSES, F.lit("non_compliant"))).alias("status"),
        F.when(none, default).otherwise(bounded_severity(one_of(F.col("v.severity"), SEVERITIES, default), default)).alias("severity"),
        F.when(none, 0.0).when(invented, F.least(sure, F.lit(0.4))).otherwise(sure).alias("confidence"),
        F.when(~invented, evidence).alias("evidence"),
        F.when(none, NOT_ASSESSED).when(invented, F.substring(F.trim(F.concat(F.coalesce(rationale, F.lit("")), F.lit(UNGROUNDED))), 1, NOTED_CHARS)).otherwise(rationale).alias("rationale"),
    )


_RANKED = "CASE {0} WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 WHEN 'info' THEN 3 END"
query(
    "requirement_verdict_join",
    _VERDICTS + ", v AS (SELECT requirement_id, arg_max({'s': lower(trim(status)), 'y': lower(trim(severity)), 'c': CAST(confidence AS DOUBLE), 'e': left(evidence, 500), 'g': grounded, 'r': left(rationale, 600)}, seq) AS v FROM verdicts GROUP BY requirement_id), "
    "x AS (SELECT requirement_id, severity_default AS d, v, v.e IS NOT NULL AND NOT coalesce(v.g, false) AS bad, greatest(0, least(1, coalesce(v.c, 0.6::DOUBLE))) AS c, CASE WHEN v.y IN ('critical','major','minor','info') THEN v.y ELSE severity_default END AS y FROM requirements LEFT JOIN v USING (requirement_id)) "
    f"SELECT requirement_id, CASE WHEN v IS NULL THEN 'not_applicable' WHEN v.s IN ('compliant','partial','non_compliant','not_applicable') THEN v.s ELSE 'non_compliant' END AS status, CASE WHEN v IS NOT NULL AND abs({_RANKED.format('y')} - {_RANKED.format('d')}) <= 1 THEN y ELSE d END AS severity, "
    f"CASE WHEN v IS NULL THEN 0 WHEN bad THEN least(c, 0.4::DOUBLE) ELSE c END AS confidence, CASE WHEN NOT coalesce(bad, false) THEN v.e END AS evidence, CASE WHEN v IS NULL THEN '{NOT_ASSESSED}' WHEN bad THEN left(trim(coalesce(v.r, '') || '{UNGROUNDED}'), 700) ELSE v.r END AS rationale FROM x",
    "requirements",
)(lambda t: requirement_verdict_join(t.requirements, t.lineitem.filter("l_returnflag <> 'R'").selectExpr("l_partkey AS requirement_id", *_said())))


def _said() -> list[str]:
    names = ("status", "severity", "confidence", "evidence", "grounded", "rationale", "seq")
    out, rest = [], _SAID
    for name in names:
        value, _, rest = rest.partition(f" AS {name}")
        out.append(f"{value.removeprefix(', ')} AS {name}")
    return out


def verdict_overturn(findings: DataFrame, second: DataFrame, rationale: Column | str = "rationale") -> DataFrame:
    """finding_id, status, confidence, rationale after a second look (finding_id, second, grounded).

    Agreement raises the confidence to 0.85; an unknown status is agreement. A better status needs evidence that is grounded in
    the document, else the finding stays; any other change stands. A change raises the confidence to 0.8 and notes itself
    in the rationale, of which 700 characters stay. A missing confidence is 0. ``rationale`` may be an expression over
    findings: it is taken after the join, so that long texts made of short columns are neither moved nor sorted.
    """
    why = F.col(rationale) if isinstance(rationale, str) else rationale
    met = findings.join(second, "finding_id", "left")
    new = one_of(F.col("second"), STATUSES, F.col("status"))
    looked = F.col("second").isNotNull()
    agrees = looked & (new == F.col("status"))
    better = new.isin("compliant", "partial")
    turns = looked & (new != F.col("status")) & (~better | F.coalesce("grounded", F.lit(False)))
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    return met.select(
        "finding_id",
        F.when(turns, new).otherwise(F.col("status")).alias("status"),
        F.when(agrees, F.greatest(sure, F.lit(0.85))).when(turns, F.greatest(sure, F.lit(0.8))).otherwise(sure).alias("confidence"),
        F.when(turns, F.substring(F.trim(F.concat(F.coalesce(why, F.lit("")), F.lit(CORRECTED))), 1, NOTED_CHARS)).otherwise(why).alias("rationale"),
    )


_SECOND = "CASE ord % 4 WHEN 0 THEN 'Compliant' WHEN 1 THEN 'partial' WHEN 2 THEN 'not_applicable' ELSE 'odd' END AS second, run_id % 2 = 0 AS grounded"
_WHY = "CASE WHEN ord % 3 = 0 THEN NULL ELSE repeat(concat(requirement_title, ' '), CAST(1 + run_id % 60 AS INTEGER)) END"
query(
    "verdict_overturn",
    f", f AS (SELECT *, {_WHY} AS rationale FROM findings), s AS (SELECT finding_id, {_SECOND} FROM findings WHERE status = 'non_compliant' AND severity = 'critical'), j AS (SELECT f.*, second, grounded, CASE WHEN lower(trim(second)) IN ('compliant','partial','non_compliant','not_applicable') THEN lower(trim(second)) ELSE status END AS nw, coalesce(CAST(confidence AS DOUBLE), 0) AS c FROM f LEFT JOIN s USING (finding_id)), "
    "t AS (SELECT *, second IS NOT NULL AND nw <> status AND (nw NOT IN ('compliant','partial') OR grounded) AS turns FROM j) "
    f"SELECT finding_id, CASE WHEN turns THEN nw ELSE status END AS status, CASE WHEN second IS NOT NULL AND nw = status THEN greatest(c, 0.85::DOUBLE) WHEN turns THEN greatest(c, 0.8::DOUBLE) ELSE c END AS confidence, CASE WHEN turns THEN left(trim(coalesce(rationale, '') || '{CORRECTED}'), 700) ELSE rationale END AS rationale FROM t",
    "findings",
)(lambda t: verdict_overturn(t.findings, t.findings.filter("status = 'non_compliant' AND severity = 'critical'").selectExpr("finding_id", *_SECOND.split(", run_id")[0:1], "run_id" + _SECOND.split(", run_id")[1]), F.expr(_WHY)))


def present_sections(findings: DataFrame, alignment: DataFrame) -> DataFrame:
    """(run_id, section): top-level sections of which a run has a finding that is at least partial, or an aligned heading.

    ``findings`` hold run_id, status, section_no and ``alignment`` run_id, section_no; a blank section counts as '—'.
    """
    found = findings.filter(F.col("status").isin("compliant", "partial"))
    return found.select("run_id", top_section().alias("section")).union(alignment.select("run_id", top_section().alias("section"))).distinct()


def section_coverage_gap(runs: DataFrame, guideline: DataFrame, present: DataFrame) -> DataFrame:
    """Top-level sections (numbers without a dot) of a run's guideline that are not ``present``, as major findings.

    ``runs`` hold run_id and their guideline g, ``guideline`` (g, no, title); a null number is no section.
    """
    wanted = runs.join(guideline.filter(F.col("no").rlike("^[0-9]+$")).select("g", F.col("no").alias("section")).distinct(), "g")
    gaps = wanted.join(present, ["run_id", "section"], "left_anti")
    return gaps.select("run_id", "section", F.lit("major").alias("severity"), F.lit(0.85).alias("confidence"))


#: (characters a fragment has at least, of a gram, grams in a window): grams + window - 1 is the first number.
_SIZES = ((60, 40, 21), (42, 28, 15), (30, 20, 11), (21, 16, 6))
_PIECE = 1 << 20  #: characters of a text that are hashed at a time


def _fingerprints(text: bytes, gram: int, window: int) -> np.ndarray:
    """The smallest gram hash of each window of grams: texts that share so many characters share one (winnowing)."""
    x = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    size, part, power, done, h = 1, x, 0x9E3779B97F4A7C15, 0, None
    while True:  # the hash of a gram from those of its parts, whose lengths are powers of two
        if gram & size:
            n = len(x) - done - size + 1
            h, done = (part if h is None else h[:n] * np.uint64(power) + part[done : done + n]), done + size
        if done == gram:
            break
        n = len(x) - 2 * size + 1
        part, power, size = part[:n] * np.uint64(power) + part[size : size + n], power * power % 2**64, 2 * size
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    n, span = len(h) - window + 1, 1
    while 2 * span <= window:
        h, span = np.minimum(h[:-span], h[span:]), 2 * span
    return np.unique(np.minimum(h[:n], h[window - span : window - span + n])).view(np.int64)


def _posts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, sizes, keys, held = [], [], [], 0
        for doc, text, wanted in zip(pdf["doc_id"], pdf["t"], pdf["sizes"], strict=True):
            data = text.encode()
            for least, gram, window in _SIZES:
                if least in wanted:
                    for start in range(0, len(data) - least + 1, _PIECE):
                        found = _fingerprints(data[start : start + _PIECE + least - 1], gram, window)
                        ids, sizes, keys, held = [*ids, doc], [*sizes, least], [*keys, found], held + len(found)
                        if held > 200_000:
                            yield _post_rows(ids, sizes, keys)
                            ids, sizes, keys, held = [], [], [], 0
        if ids:
            yield _post_rows(ids, sizes, keys)


def _post_rows(ids: list, sizes: list[int], keys: list[np.ndarray]) -> pd.DataFrame:
    n = [len(k) for k in keys]
    return pd.DataFrame({"doc_id": np.repeat(ids, n), "size": np.repeat(np.array(sizes, np.int32), n), "key": np.concatenate(keys)})


def _fragment_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    of = {least: (gram, window) for least, gram, window in _SIZES}
    for pdf in batches:
        pdf["key"] = np.array([_fingerprints(p[:n].encode(), *of[n])[0] for p, n in zip(pdf["part"], pdf["size"], strict=True)], np.int64)
        yield pdf


def evidence_grounding(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """(evidence_id, doc_id) where a quote stands in a document after normalisation, whole or by its first or last 60,
    without blanks at their ends.

    Quotes of at most 20 characters are too short to verify and count as grounded, in no document: their doc_id is null.
    The first and last 60 characters of a quote meet texts on a fingerprint, an equi-join: the smallest gram hash of a
    window of characters, wherever words begin or end. Containment is then decided on the whole text.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    q = evidence.select("evidence_id", norm("quote").alias("q")).filter("q <> ''")
    short = q.filter(F.length("q") <= 20).select("evidence_id")
    parts = q.filter(F.length("q") > 20).select("evidence_id", F.explode(F.array_distinct(F.array(F.trim(F.substring("q", 1, 60)), F.trim(F.expr("right(q, 60)"))))).alias("part"))
    fits = F.coalesce(*[F.when(F.length("part") >= least, least) for least, _, _ in _SIZES])
    parts = parts.withColumn("size", fits)
    id_type, doc_type = (df.schema[c].dataType.simpleString() for df, c in ((evidence, "evidence_id"), (docs, "doc_id")))
    keys = parts.mapInPandas(_fragment_keys, f"evidence_id {id_type}, part string, size int, key long")
    d = docs.select("doc_id", norm("text").alias("t"))
    sizes = parts.agg(F.collect_set("size").alias("sizes"))  # one row of at most four numbers
    posts = d.filter("length(t) > 20").join(F.broadcast(sizes)).mapInPandas(_posts, f"doc_id {doc_type}, size int, key long")
    pairs = posts.join(keys, ["size", "key"]).select("doc_id", "evidence_id", "part").distinct()
    met = pairs.join(d, "doc_id").filter(F.col("t").contains(F.col("part"))).select("evidence_id", "doc_id").distinct()
    return met.union(short.select("evidence_id", F.lit(None).cast(doc_type)))


_N = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
query(
    "evidence_grounding",
    f", q AS (SELECT evidence_id, {_N.format('quote')} AS q FROM evidence), d AS (SELECT doc_id, {_N.format('text')} AS t FROM documents) SELECT evidence_id, doc_id FROM q JOIN d ON contains(t, q) OR contains(t, trim(left(q, 60))) OR contains(t, trim(right(q, 60))) WHERE length(q) > 20 UNION ALL SELECT evidence_id, NULL FROM q WHERE length(q) BETWEEN 1 AND 20",
    "evidence",
)(lambda t: evidence_grounding(t.evidence, t.documents))


#: Tasks, for each core, that headings are dealt to.
ALIGN_TASKS_A_CORE = 32


def align_sections(guideline: DataFrame, headings: DataFrame, least: float = 0.5) -> DataFrame:
    """(g, doc_id, no, id, score): for each document and section of its guideline the best heading of ``least`` or more.

    ``guideline`` is (g, no, title) with one row a number, ``headings`` (g, doc_id, id, heading). A heading that is the
    number, or goes on after it with a blank or a dot, scores 1 (so section 9 meets 9.4); any other the overlap of tokens,
    |A and B| / min(|A|, |B|). Of equal scores the smallest id wins; headings that share an id are scored one by one. Sections without a number and blank headings take
    no part. Each text that headings have in a guideline is scored once, by equi-joins on a number, or a token; then the
    headings, dealt by document, take its scores.
    """
    g = guideline.filter(F.coalesce("no", F.lit("")) != "").select("g", "no", audit_tokens(F.coalesce("title", F.lit(""))).alias("ta")).withColumn("na", F.size("ta"))
    d = headings.select("g", "doc_id", "id", F.trim("heading").alias("head")).filter("head <> ''")
    heads = d.select("g", "head").distinct()
    longest = g.agg(F.coalesce(F.max(F.length("no")), F.lit(1)).alias("longest"))  # one row
    ends = F.expr("filter(sequence(1, least(length(head), longest)), i -> substring(head, i + 1, 1) IN ('', ' ', '.'))")
    begun = heads.join(F.broadcast(longest)).select("g", "head", F.explode(ends).alias("i")).select("g", "head", F.expr("substring(head, 1, i)").alias("no"))
    numbered = begun.join(g.select("g", "no"), ["g", "no"]).select("g", "head", "no", F.lit(1.0).alias("score"))
    words = heads.select("g", "head", audit_tokens(F.col("head")).alias("tb")).withColumn("nb", F.size("tb"))
    met = words.withColumn("tok", F.explode("tb")).join(g.withColumn("tok", F.explode("ta")), ["g", "tok"])
    overlap = met.groupBy("g", "head", "no", "na", "nb").agg(F.count("*").alias("n")).select("g", "head", "no", (F.col("n") / F.least("na", "nb")).alias("score"))
    fits = numbered.union(overlap.filter(F.col("score") >= least)).groupBy("g", "head", "no").agg(F.max("score").alias("score"))
    # Written, so that its size is known and a small table is broadcast: then headings stay dealt by document.
    scored = written(fits.groupBy("g", "head").agg(F.collect_list(F.struct("no", "score")).alias("s")), "heading-scores")
    tasks = ALIGN_TASKS_A_CORE * d.sparkSession.sparkContext.defaultParallelism
    each = d.repartition(tasks, "g", "doc_id").join(scored, ["g", "head"]).select("g", "doc_id", "id", F.inline("s"))
    best = each.groupBy("g", "doc_id", "no").agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("x"))
    return best.select("g", "doc_id", "no", (-F.col("x.id")).alias("id"), F.round("x.score", 3).alias("score"))


_TOKS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) >= 3 OR regexp_full_match(x, '[0-9]+')))"
_GUIDE = ", guide AS (SELECT code AS g, section_no AS no, min(title) AS title FROM requirements GROUP BY ALL UNION ALL SELECT code, split_part(section_no, '.', 1), min(title) FROM requirements GROUP BY ALL)"
_ALIGN = (
    _GUIDE + ", heads AS (SELECT concat('G', f.run_id % 4) AS g, f.run_id AS doc_id, f.ord AS id, trim(CASE WHEN f.ord % 2 = 0 THEN concat(coalesce(f.section_no, ''), ' ', q.title) ELSE q.title END) AS head FROM findings f JOIN runs r ON r.run_id = f.run_id AND r.flow = 'compliance' JOIN requirements q ON q.requirement_id = f.requirement_id), "
    f"gt AS (SELECT *, {_TOKS.format('title')} AS ta FROM guide), ht AS (SELECT *, {_TOKS.format('head')} AS tb FROM heads), "
    "pa AS (SELECT g, doc_id, no, id, CASE WHEN head = no OR starts_with(head, no || ' ') OR starts_with(head, no || '.') THEN 1 ELSE len(list_intersect(ta, tb)) / least(len(ta), len(tb)) END AS s FROM gt JOIN ht USING (g)), "
    "al AS (SELECT g, doc_id, no, id, round(s, 3) AS score FROM pa WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY g, doc_id, no ORDER BY s DESC, id) = 1)"
)


def guideline_sections(t) -> DataFrame:
    """Each guideline's sections and, by their first number, top-level sections."""
    r = t.requirements.selectExpr("code AS g", "section_no AS no", "title")
    return r.groupBy("g", "no").agg(F.min("title").alias("title")).union(r.groupBy("g", F.split("no", "\\.")[0]).agg(F.min("title")))


def _compliance_runs(t) -> DataFrame:
    return t.runs.filter("flow = 'compliance'").selectExpr("run_id", "concat('G', run_id % 4) AS g")


def _alignment(t) -> DataFrame:
    heads = t.findings.join(_compliance_runs(t), "run_id").join(t.requirements.select("requirement_id", "title"), "requirement_id")
    return align_sections(guideline_sections(t), heads.selectExpr("g", "run_id AS doc_id", "ord AS id", "CASE WHEN ord % 2 = 0 THEN concat(coalesce(section_no, ''), ' ', title) ELSE title END AS heading"))


def _present(t) -> DataFrame:
    return present_sections(t.findings, _alignment(t).select(F.col("doc_id").alias("run_id"), F.col("no").alias("section_no")))


_PRESENT = _ALIGN + f", pr AS (SELECT run_id, {_TOP} AS section FROM findings WHERE status IN ('compliant','partial') UNION SELECT doc_id, split_part(no, '.', 1) FROM al)"
query("align_sections", _ALIGN + " SELECT * FROM al", "requirements findings runs")(_alignment)
query("present_sections", _PRESENT + " SELECT * FROM pr", "requirements findings runs")(_present)
query(
    "section_coverage_gap",
    _PRESENT + " SELECT r.run_id, no AS section, 'major' AS severity, 0.85::DOUBLE AS confidence FROM runs r JOIN guide ON g = concat('G', r.run_id % 4) WHERE flow = 'compliance' AND regexp_full_match(no, '[0-9]+') AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.run_id = r.run_id AND pr.section = no)",
    "requirements findings runs",
)(lambda t: section_coverage_gap(_compliance_runs(t), guideline_sections(t), _present(t)))


def det_findings(requirements: DataFrame, alignment: DataFrame) -> DataFrame:
    """Findings of page limits, by the type of a requirement's constraint; without pages or a number not applicable."""
    kind, value = F.get_json_object("constraint_spec", "$.type"), F.get_json_object("constraint_spec", "$.value")
    met = requirements.filter(kind.isin("max_pages", "min_pages")).join(alignment, "section_no", "left")
    n = value.try_cast("int")
    status = (
        F.when(F.col("pages").isNull() | n.isNull(), "not_applicable")
        .when((kind == "max_pages") & (F.col("pages") > n), "non_compliant")
        .when((kind == "min_pages") & (F.col("pages") < n), "partial")
        .otherwise("compliant")
    )
    return met.select("requirement_id", kind.alias("constraint_type"), status.alias("status"), F.lit(0.95).alias("confidence"))


query(
    "det_page_limits",
    ", al AS (SELECT section_no, CAST(count(*) % 5 AS INTEGER) AS pages FROM findings WHERE section_no IS NOT NULL GROUP BY section_no HAVING count(*) % 7 <> 0), k AS (SELECT *, json_extract_string(constraint_spec, '$.type') AS kind, json_extract_string(constraint_spec, '$.value') AS v FROM requirements) "
    "SELECT requirement_id, kind AS constraint_type, CASE WHEN pages IS NULL OR TRY_CAST(v AS INTEGER) IS NULL THEN 'not_applicable' WHEN kind = 'max_pages' AND pages > TRY_CAST(v AS INTEGER) THEN 'non_compliant' WHEN kind = 'min_pages' AND pages < TRY_CAST(v AS INTEGER) THEN 'partial' ELSE 'compliant' END AS status, 0.95::DOUBLE AS confidence FROM k LEFT JOIN al USING (section_no) WHERE kind IN ('max_pages','min_pages')",
    "requirements findings",
)(lambda t: det_findings(t.requirements, t.findings.filter("section_no IS NOT NULL").groupBy("section_no").agg(F.count("*").alias("n")).filter("n % 7 <> 0").select("section_no", (F.col("n") % 5).cast("int").alias("pages"))))
query("run_detail", "SELECT r.run_id, r.flow, r.status, count(DISTINCT finding_id) AS n_findings, coalesce((SELECT string_agg(kind, ',' ORDER BY artifact_id) FROM artifacts a WHERE a.run_id = r.run_id), '') AS artifacts FROM runs r LEFT JOIN findings f ON f.run_id = r.run_id GROUP BY r.run_id, r.flow, r.status", "runs findings artifacts")(
    lambda t: t.runs.join(t.findings.groupBy("run_id").agg(F.count_distinct("finding_id").alias("n")), "run_id", "left")
    .join(t.artifacts.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("artifact_id", "kind"))), lambda x: x["kind"]), ",").alias("k")), "run_id", "left")
    .select("run_id", "flow", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"), F.coalesce("k", F.lit("")).alias("artifacts"))
)
query("context_versions", "SELECT a.project_id, a.run_id, b.run_id AS other FROM runs a JOIN runs b USING (project_id) WHERE a.run_id <> b.run_id", "runs")(
    lambda t: t.runs.select("project_id", "run_id").join(t.runs.select("project_id", F.col("run_id").alias("other")), "project_id").filter("run_id <> other")
)

# ------------------------------------------------------------------------------------------ layout


def _page():
    return Window.partitionBy("doc_id", "page")


def bbox_exclude(blocks: DataFrame, boxes: DataFrame, most: float = 0.5) -> DataFrame:
    """Blocks whose area lies more than ``most`` in one of the page's boxes are dropped."""
    b = boxes.select("doc_id", "page", *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    w = F.greatest(F.lit(0.0), F.least("x1", "bx1") - F.greatest("x0", "bx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "by1") - F.greatest("y0", "by0"))
    inside = w * h > most * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return blocks.join(b, [blocks.doc_id == b.doc_id, blocks.page == b.page, inside], "left_anti")


query(
    "bbox_exclude",
    ", boxes AS (SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, min(x0) + 40 AS x1, min(y0) + 30 AS y1 FROM spans GROUP BY doc_id, page) SELECT doc_id, page, ord FROM spans s WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.doc_id = s.doc_id AND b.page = s.page AND greatest(0, least(s.x1, b.x1) - greatest(s.x0, b.x0)) * greatest(0, least(s.y1, b.y1) - greatest(s.y0, b.y0)) > 0.5 * (s.x1 - s.x0) * (s.y1 - s.y0))",
    "spans",
)(lambda t: bbox_exclude(t.spans, t.spans.groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0")).selectExpr("doc_id", "page", "x0", "y0", "x0 + 40 AS x1", "y0 + 30 AS y1")).select("doc_id", "page", "ord"))
query(
    "superscript_attach",
    ", s AS (SELECT *, y1 - 3 AS base FROM spans WHERE size < 14 AND bold), l AS (SELECT * FROM spans WHERE NOT bold) SELECT s.doc_id, s.ord, l.ord AS line FROM s JOIN l ON l.doc_id = s.doc_id AND l.page = s.page AND l.y1 - s.base BETWEEN -1 AND greatest(8, 0.9 * l.size) AND s.x0 <= l.x1 + 4 AND s.x1 >= l.x0 - 4 QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.ord ORDER BY abs(l.y1 - s.base), l.ord) = 1",
    "spans",
)(lambda t: _superscripts(t.spans))


def _superscripts(spans: DataFrame) -> DataFrame:
    """A raised span goes to the page's line with the nearest baseline that overlaps it sideways."""
    s = spans.filter("size < 14 AND bold").selectExpr("doc_id", "page", "ord", "y1 - 3 AS base", "x0 AS sx0", "x1 AS sx1")
    line = spans.filter("NOT bold").selectExpr("doc_id", "page", "ord AS line", "y1", "size", "x0", "x1")
    gap = F.col("y1") - F.col("base")
    met = s.join(line, ["doc_id", "page"]).filter(gap.between(-1, F.greatest(F.lit(8.0), 0.9 * F.col("size"))) & (F.col("sx0") <= F.col("x1") + 4) & (F.col("sx1") >= F.col("x0") - 4))
    return met.groupBy("doc_id", "ord").agg(F.min_by("line", F.struct(F.abs(gap), "line")).alias("line"))


query("reading_order", "SELECT doc_id, page, ord, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord) AS INTEGER) AS n FROM spans", "spans")(
    lambda t: t.spans.select("doc_id", "page", "ord", F.row_number().over(_page().orderBy("y0", "x0", "ord")).alias("n"))
)
query("block_grouping", ", b AS (SELECT *, CASE WHEN lag(y1) OVER w IS NULL OR y0 - lag(y1) OVER w > 1.2 * (y1 - y0) OR abs(size - lag(size) OVER w) > 2 OR bold <> lag(bold) OVER w THEN 1 ELSE 0 END AS nw FROM spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, ord, x0, text, size, bold)) SELECT doc_id, page, ord, CAST(sum(nw) OVER (PARTITION BY doc_id, page ORDER BY y0, ord, x0, text, size, bold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block FROM b", "spans")(
    lambda t: block_grouping(t.spans).select("doc_id", "page", "ord", "block")
)


def block_grouping(lines: DataFrame) -> DataFrame:
    """Adds block: a new one after a gap of 1.2 line heights, a change of size by more than 2, or of boldness."""
    w = _page().orderBy("y0", "ord", "x0", "text", "size", "bold")
    new = F.lag("y1").over(w).isNull() | (F.col("y0") - F.lag("y1").over(w) > 1.2 * (F.col("y1") - F.col("y0"))) | (F.abs(F.col("size") - F.lag("size").over(w)) > 2) | (F.col("bold") != F.lag("bold").over(w))
    return lines.withColumn("_n", new.cast("int")).withColumn("block", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))


query("font_stats", ", s AS (SELECT doc_id, size, sum(length(text)) AS w FROM spans GROUP BY ALL), b AS (SELECT doc_id, arg_max(size, (w, -size)) AS body FROM s GROUP BY doc_id) SELECT doc_id, body, (SELECT count(*) FROM s WHERE s.doc_id = b.doc_id AND s.size > b.body) AS larger FROM b", "spans")(
    lambda t: font_stats(t.spans)
)


def font_stats(spans: DataFrame) -> DataFrame:
    """Each document's body size, the one of most characters, and the number of larger sizes."""
    s = spans.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("w"))
    body = s.groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body"), F.collect_set("size").alias("_s"))
    return body.select("doc_id", "body", F.size(F.filter("_s", lambda x: x > F.col("body"))).cast("long").alias("larger"))


query("heading_scale", ", s AS (SELECT DISTINCT doc_id, size FROM spans), b AS (SELECT doc_id, min(size) AS body FROM s GROUP BY doc_id) SELECT doc_id, size, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS INTEGER) AS level FROM s JOIN b USING (doc_id) WHERE size > body + 0.6 QUALIFY level <= 4", "spans")(
    lambda t: t.spans.groupBy("doc_id").agg(F.min("size").alias("b"), F.collect_set("size").alias("s")).select("doc_id", F.posexplode(F.slice(F.sort_array(F.filter("s", lambda x: x > F.col("b") + 0.6), False), 1, 4)).alias("p", "size")).select("doc_id", "size", (F.col("p") + 1).alias("level"))
)
query("formatting_profile", "SELECT doc_id, string_agg(DISTINCT font, ',' ORDER BY font) AS fonts, count(*) AS n, count(DISTINCT size) AS n_sizes FROM spans GROUP BY doc_id", "spans")(
    lambda t: t.spans.groupBy("doc_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("font")), 1, 20), ",").alias("fonts"), F.count("*").alias("n"), F.count_distinct("size").alias("n_sizes"))
)
query("style_dedup_registry", ", k AS (SELECT doc_id, concat_ws('|', font, CAST(CAST(size AS INTEGER) AS VARCHAR), CAST(bold AS VARCHAR)) AS key, min(ord) AS first FROM spans GROUP BY ALL) SELECT doc_id, key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first, key) AS INTEGER) AS style FROM k", "spans")(
    lambda t: t.spans.groupBy("doc_id", F.concat_ws("|", "font", F.col("size").cast("int").cast("string"), F.col("bold").cast("string")).alias("key")).agg(F.min("ord").alias("first")).select("doc_id", "key", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "key")).alias("style"))
)
def style_ref_remap(elements: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, ord, style): each element's style in a target's styles.

    ``elements`` are (doc_id, ord, heading, ref), ``styles`` (doc_id, n, style) in the order n, equal ones by name. A reference that the target
    has stays; else a heading takes the first style named like a heading and others the first that is not, or the
    target's first style where it has none of that kind; null without any style.
    """
    first = lambda cond: F.min_by("style", F.when(cond, F.struct("n", "style")))
    head = F.lower("style").contains("head")
    firsts = styles.groupBy("doc_id").agg(first(head).alias("h"), first(~head).alias("b"), first(F.lit(True)).alias("any"))
    have = styles.select("doc_id", F.col("style").alias("ref"), F.lit(True).alias("has")).distinct()
    met = elements.join(have, ["doc_id", "ref"], "left").join(firsts, "doc_id", "left")
    other = F.coalesce(F.when(F.col("heading"), F.col("h")).otherwise(F.col("b")), F.col("any"))
    return met.select("doc_id", "ord", F.when(F.col("has"), F.col("ref")).otherwise(other).alias("style"))


query(
    "style_ref_remap",
    ", e AS (SELECT doc_id, ord, page, bold, CASE WHEN bold THEN 'Heading ' || font ELSE font END AS ref FROM spans), st AS (SELECT doc_id, ref AS style, min(ord) AS n FROM e WHERE page = 1 GROUP BY ALL), "
    "f AS (SELECT doc_id, arg_min(style, (n, style)) FILTER (contains(lower(style), 'head')) AS h, arg_min(style, (n, style)) FILTER (NOT contains(lower(style), 'head')) AS b, arg_min(style, (n, style)) AS a FROM st GROUP BY doc_id) "
    "SELECT e.doc_id, e.ord, CASE WHEN st.style IS NOT NULL THEN e.ref WHEN bold THEN coalesce(h, a) ELSE coalesce(b, a) END AS style FROM e LEFT JOIN st ON st.doc_id = e.doc_id AND st.style = e.ref LEFT JOIN f ON f.doc_id = e.doc_id",
    "spans",
)(lambda t: _restyled(t))


def _restyled(t) -> DataFrame:
    """Spans against the styles of their document's first page."""
    e = t.spans.selectExpr("doc_id", "ord", "page", "bold AS heading", "CASE WHEN bold THEN concat('Heading ', font) ELSE font END AS ref")
    return style_ref_remap(e, e.filter("page = 1").groupBy("doc_id", F.col("ref").alias("style")).agg(F.min("ord").alias("n")))


# ------------------------------------------------------------------------------------------ token sets and term vectors

_PAIRS = "SELECT x.l_partkey AS a, y.l_partkey AS b, {0} AS ta, {1} AS tb FROM (SELECT DISTINCT x.l_partkey, y.l_partkey AS other FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1) x JOIN (SELECT p_partkey AS l_partkey FROM part) y ON y.l_partkey = x.other JOIN part a ON a.p_partkey = x.l_partkey JOIN part b ON b.p_partkey = y.l_partkey"


PAIR_TASKS_A_CORE = 16  #: tasks a core for the lines of orders and for their pairs, whose rows are few bytes shuffled but many in memory


def neighbours(t) -> DataFrame:
    """(a, b): each two parts that follow one another in an order."""
    tasks = PAIR_TASKS_A_CORE * t.spark.sparkContext.defaultParallelism
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a")).repartition(tasks, "l_orderkey", "l_linenumber")
    behind = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b")).repartition(tasks, "l_orderkey", "l_linenumber")
    return lines.join(behind.hint("merge"), ["l_orderkey", "l_linenumber"]).select("a", "b").repartition(tasks, "a", "b").distinct()


def _title_pairs(t) -> DataFrame:
    p = t.part.select("p_partkey", audit_tokens(F.col("p_name")).alias("tok"))
    return neighbours(t).join(p.select(F.col("p_partkey").alias("a"), F.col("tok").alias("ta")), "a").join(p.select(F.col("p_partkey").alias("b"), F.col("tok").alias("tb")), "b")


for _name, _union in (("token_overlap", False), ("token_jaccard", True)):
    _d = "len(list_distinct(list_concat(ta, tb)))" if _union else "least(len(ta), len(tb))"
    query(_name, f"SELECT a, b, round(len(list_intersect(ta, tb)) / {_d}, 6) AS score FROM ({_PAIRS.format(_TOKS.format('a.p_name'), _TOKS.format('b.p_name'))})")(
        lambda t, u=_union: _title_pairs(t).select("a", "b", F.round(F.size(F.array_intersect("ta", "tb")) / (F.size(F.array_union("ta", "tb")) if u else F.least(F.size("ta"), F.size("tb"))), 6).alias("score"))
    )


def tfidf_cosine(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, score): cosine of tf-idf vectors for pairs of items (g, id, tokens); idf within the group g.

    Weights are tf * (ln((n + 1) / (df + 1)) + 1). An item that stands for several has their number in ``times``. The dot
    product is an equi-join on group and term.
    """
    items = items if "times" in items.columns else items.withColumn("times", F.lit(1))
    n = items.groupBy("g").agg(F.sum("times").alias("n"))
    tf = items.select("g", "id", "times", F.explode("tokens").alias("term")).groupBy("g", "id", "term").agg(F.count("*").alias("tf"), F.first("times").alias("times"))
    df = tf.groupBy("g", "term").agg(F.sum("times").alias("df"))
    w = tf.join(df, ["g", "term"]).join(n, "g").select("g", "id", "term", (F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    left = pairs.join(w.select(F.col("id").alias("a"), "term", F.col("w").alias("wa")), "a")
    dot = left.join(w.select(F.col("id").alias("b"), "term", F.col("w").alias("wb")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    met = dot.join(norm.select(F.col("id").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("id").alias("b"), F.col("norm").alias("nb")), "b")
    return met.select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("score"))


def tfidf_cosine_of_copies(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """``tfidf_cosine`` of the pairs (a, b) of one group, where items, an id once, with equal words in a group are one bag.

    Terms meet once for each two bags that pairs have, so a pair is moved with its bags and not with its terms. Items are not
    broadcast to the pairs: every task would hold all of them.
    """
    tasks = PAIR_TASKS_A_CORE * pairs.sparkSession.sparkContext.defaultParallelism
    rows = items.select("g", "id", F.array_sort("tokens").alias("tokens"))
    bags = rows.groupBy("g", "tokens").agg(F.min("id").alias("bag"), F.count("*").alias("times"))
    held = rows.join(bags, ["g", "tokens"]).select("g", "id", "bag")
    of = lambda name: held.select("g", F.col("id").alias(name), F.col("bag").alias(f"_{name}")).repartition(tasks, name, *["g"] * (name == "b")).hint("merge")
    met = pairs.repartition(tasks, "a").join(of("a"), "a").repartition(tasks, "b", "g").join(of("b"), ["b", "g"]).select("a", "b", "_a", "_b")
    asked = met.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    scores = tfidf_cosine(bags.select("g", F.col("bag").alias("id"), "tokens", "times"), asked)
    return met.join(scores.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "score"), ["_a", "_b"]).select("a", "b", "score")


query(
    "tfidf_cosine",
    ", it AS (SELECT code AS g, requirement_id AS id, list_filter(regexp_extract_all(lower(title), '[a-z]{3,}'), lambda x: true) AS toks FROM requirements), n AS (SELECT g, count(*) AS n FROM it GROUP BY g), tf AS (SELECT g, id, term, count(*) AS tf FROM (SELECT g, id, unnest(toks) AS term FROM it) GROUP BY ALL), df AS (SELECT g, term, count(*) AS df FROM tf GROUP BY ALL), "
    "w AS (SELECT tf.g, id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (g, term) JOIN n USING (g)), nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id) "
    "SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w) / (any_value(na.norm) * any_value(nb.norm)), 6) AS score FROM (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1) pr JOIN w x ON x.id = pr.a JOIN w y ON y.id = pr.b AND y.term = x.term AND y.g = x.g JOIN nm na ON na.id = x.id JOIN nm nb ON nb.id = y.id GROUP BY x.id, y.id",
    "requirements",
)(lambda t: _tfidf(t))


def _tfidf(t) -> DataFrame:
    items = t.requirements.select(F.col("code").alias("g"), F.col("requirement_id").alias("id"), F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{3,}"), F.lit(0)).alias("tokens"))
    return tfidf_cosine_of_copies(items, neighbours(t))


_STEM = (
    "CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND ends_with(w, 'sses') THEN left(w, length(w) - 2) WHEN length(w) > 4 AND ends_with(w, 'ses') THEN left(w, length(w) - 1) "
    "WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) WHEN length(w) > 4 AND ends_with(w, 'ing') THEN left(w, length(w) - 3) WHEN length(w) > 4 AND ends_with(w, 'ed') THEN left(w, length(w) - 2) ELSE w END"
)
query("tokenize_map", f"SELECT requirement_id, array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(concat_ws(' ', title, requirement_text), '[a-zA-Z]{{3,}}'), lambda w: lower(w)), lambda w: w NOT IN {X.STOPWORDS}), lambda w: {_STEM}), ' ') AS tokens FROM requirements", "requirements")(lambda t: t.requirements.select("requirement_id", F.array_join(X.map_tokens(F.concat_ws(" ", "title", "requirement_text")), " ").alias("tokens")))


def keyword_missing(texts: DataFrame) -> DataFrame:
    """(doc_id, missing, flagged): the keywords of (doc_id, text, keywords) that a text lacks, upper case aside; flagged if it has none.

    Without keywords nothing is missing. Null texts have no keyword.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    lacking = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: ~low.contains(F.lower(k)))
    rows = texts.withColumn("_m", lacking)
    return rows.select("doc_id", F.array_join("_m", ",").alias("missing"), ((F.size("_m") > 0) & (F.size("_m") == F.size("keywords"))).alias("flagged"))


_WORDS = "list_transform(regexp_extract_all(t, '[A-Za-z]{4,}'), lambda x: lower(x))"
query(
    "keyword_missing",
    f"SELECT doc_id, array_to_string(list_filter(k, lambda x: NOT contains(low, x)), ',') AS missing, len(k) > 0 AND len(list_filter(k, lambda x: NOT contains(low, x))) = len(k) AS flagged FROM (SELECT doc_id, lower(coalesce(text, '')) AS low, {_WORDS.replace('(t,', '(p_name,')} AS k FROM documents JOIN part ON p_partkey = doc_id)",
)(lambda t: keyword_missing(t.documents.join(t.part, F.col("p_partkey") == F.col("doc_id")).select("doc_id", "text", F.transform(F.regexp_extract_all("p_name", F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower).alias("keywords"))))
