"""Compliance scores and counts over audit findings, one row a finding, for all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.plans.registry import query

#: Fixed values of the score.
SEVERITY_WEIGHT = {"critical": 4.0, "major": 3.0, "minor": 2.0, "info": 1.0}
OTHER_WEIGHT = 2.0
CREDIT = {"compliant": 1.0, "partial": 0.5}
DIMENSIONS = ("content", "structure", "formatting", "style", "tone")
ISSUES = ("non_compliant", "partial")
NO_SECTION = "—"


def _case(column: str, values: dict, other) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def confidence(column: str = "confidence") -> Column:
    """Null counts as 0.7; NaN as 1; else clamped to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(column).cast("double"), F.lit(0.7))))


def weight() -> Column:
    return _case("severity", SEVERITY_WEIGHT, OTHER_WEIGHT) * (F.lit(0.6) + F.lit(0.4) * confidence())


def applies() -> Column:
    return F.col("status") != "not_applicable"


def weighted_score() -> Column:
    """Weighted credit over weight, of findings that apply; null where none does."""
    credit = _case("status", CREDIT, 0.0)
    total = F.sum(F.when(applies(), weight()))
    # Half up to four places with a margin far above the error of a sum, so that the order of summation decides no tie.
    ratio = F.sum(F.when(applies(), weight() * credit)) / F.when(total != 0, total)
    return F.floor(ratio * 10_000 + 0.5000001) / 10_000


def top_section(column: str = "section_no") -> Column:
    first = F.split(F.col(column), "\\.")[0]
    return F.when(F.coalesce(F.trim(first), F.lit("")) == "", F.lit(NO_SECTION)).otherwise(first)


def label(score: Column, critical: Column) -> Column:
    return (
        F.when(critical, "failing").when(score.isNull(), "n/a").when(score >= 0.9, "strong").when(score >= 0.75, "moderate").when(score >= 0.5, "weak").otherwise("failing")
    )


def critical_fail() -> Column:
    return F.max((F.col("severity") == "critical") & (F.col("status") == "non_compliant"))


def is_issue() -> Column:
    return F.col("status").isin(*ISSUES)


def score_overall(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id").agg(F.coalesce(weighted_score(), F.lit(0.0)).alias("score"))


def score_by_dimension(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("dimension").isin(*DIMENSIONS)).groupBy("run_id", "dimension").agg(weighted_score().alias("score"))


def score_by_section(findings: DataFrame) -> DataFrame:
    """Score, label, open issues and findings of each top-level section."""
    s = findings.groupBy("run_id", top_section().alias("section")).agg(
        weighted_score().alias("_score"), critical_fail().alias("_critical"), F.count_if(is_issue()).alias("issues"), F.count("*").alias("total")
    )
    return s.select("run_id", "section", F.coalesce("_score", F.lit(0.0)).alias("score"), label(F.col("_score"), F.col("_critical")).alias("label"), "issues", "total")


def score_grouping_sets(findings: DataFrame) -> DataFrame:
    """The run, dimension and section scores from one pass; grain says which."""
    base = findings.withColumn("section", top_section())
    sets = base.groupingSets([["run_id"], ["run_id", "dimension"], ["run_id", "section"]], "run_id", "dimension", "section")
    out = sets.agg(weighted_score().alias("score"), F.grouping_id().alias("_g"))
    grain = F.when(F.col("_g") == 3, "run").when(F.col("_g") == 1, "dimension").otherwise("section")
    return out.select("run_id", grain.alias("grain"), F.coalesce("dimension", "section").alias("key"), "score")


def status_label(findings: DataFrame) -> DataFrame:
    s = findings.groupBy("run_id").agg(weighted_score().alias("_score"), critical_fail().alias("critical_fail"))
    return s.select("run_id", "critical_fail", label(F.col("_score"), F.col("critical_fail")).alias("label"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Open issues of each of the four severities; zeros are kept."""
    return findings.groupBy("run_id").agg(*[F.count_if(is_issue() & (F.col("severity") == s)).alias(f"n_{s}") for s in SEVERITY_WEIGHT])


def requirement_histogram(requirements: DataFrame) -> DataFrame:
    sets = requirements.groupingSets([["code", "dimension"], ["code", "severity_default"]], "code", "dimension", "severity_default")
    out = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    return out.select("code", F.when(F.col("_g") == 1, "dimension").otherwise("severity").alias("kind"), F.coalesce("dimension", "severity_default").alias("key"), "n")


_WEIGHT = "(CASE severity WHEN 'critical' THEN 4 WHEN 'major' THEN 3 WHEN 'minor' THEN 2 WHEN 'info' THEN 1 ELSE 2 END * (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * least(1, greatest(0, coalesce(CAST(confidence AS DOUBLE), CAST(0.7 AS DOUBLE))))))"
_CREDIT = "(CASE status WHEN 'compliant' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0::DOUBLE END)"
_SCORE = f"(floor(sum({_WEIGHT} * {_CREDIT}) FILTER (status <> 'not_applicable') / nullif(sum({_WEIGHT}) FILTER (status <> 'not_applicable'), 0) * 10000 + 0.5000001) / 10000)"
_TOP = "CASE WHEN coalesce(trim(split_part(section_no, '.', 1)), '') = '' THEN '—' ELSE split_part(section_no, '.', 1) END"
_CRIT = "bool_or(severity = 'critical' AND status = 'non_compliant')"
_LABEL = "CASE WHEN c THEN 'failing' WHEN s IS NULL THEN 'n/a' WHEN s >= 0.9 THEN 'strong' WHEN s >= 0.75 THEN 'moderate' WHEN s >= 0.5 THEN 'weak' ELSE 'failing' END"

query("score_overall", f"SELECT run_id, coalesce({_SCORE}, 0) AS score FROM findings GROUP BY run_id", "findings")(lambda t: score_overall(t.findings))
query("score_by_dimension", f"SELECT run_id, dimension, {_SCORE} AS score FROM findings GROUP BY run_id, dimension", "findings")(lambda t: score_by_dimension(t.findings))
query(
    "score_by_section",
    f", g AS (SELECT run_id, {_TOP} AS section, {_SCORE} AS s, {_CRIT} AS c, count(*) FILTER (status IN ('partial','non_compliant')) AS issues, count(*) AS total FROM findings GROUP BY ALL) "
    f"SELECT run_id, section, coalesce(s, 0) AS score, {_LABEL} AS label, issues, total FROM g",
    "findings",
)(lambda t: score_by_section(t.findings))
query(
    "score_grouping_sets",
    f"SELECT run_id, 'run' AS grain, NULL AS key, {_SCORE} AS score FROM findings GROUP BY run_id UNION ALL SELECT run_id, 'dimension', dimension, {_SCORE} FROM findings GROUP BY run_id, dimension "
    f"UNION ALL SELECT run_id, 'section', {_TOP}, {_SCORE} FROM findings GROUP BY run_id, {_TOP}",
    "findings",
)(lambda t: score_grouping_sets(t.findings))
query("status_label", f", g AS (SELECT run_id, {_SCORE} AS s, {_CRIT} AS c FROM findings GROUP BY run_id) SELECT run_id, c AS critical_fail, {_LABEL} AS label FROM g", "findings")(lambda t: status_label(t.findings))
query("severity_counts", "SELECT run_id, " + ", ".join(f"count(*) FILTER (status IN ('partial','non_compliant') AND severity = '{s}') AS n_{s}" for s in SEVERITY_WEIGHT) + " FROM findings GROUP BY run_id", "findings")(
    lambda t: severity_counts(t.findings)
)
query(
    "requirement_histogram",
    "SELECT code, 'dimension' AS kind, dimension AS key, count(*) AS n FROM requirements GROUP BY code, dimension UNION ALL SELECT code, 'severity', severity_default, count(*) FROM requirements GROUP BY code, severity_default",
    "requirements",
)(lambda t: requirement_histogram(t.requirements))


@query("severity_chip_counts", "SELECT run_id, coalesce(severity, 'all') AS severity, count(*) AS n FROM findings WHERE status IN ('partial','non_compliant') GROUP BY GROUPING SETS ((run_id, severity), (run_id))", "findings")
def _severity_chip_counts(t):
    """Counts under the issues view for each severity, and for all of them."""
    sets = t.findings.filter(is_issue()).groupingSets([["run_id", "severity"], ["run_id"]], "run_id", "severity").agg(F.count("*").alias("n"))
    return sets.select("run_id", F.coalesce("severity", F.lit("all")).alias("severity"), "n")


@query(
    "open_issue_count",
    ", triage AS (SELECT l_orderkey AS run_id, concat(l_orderkey, '-', l_linenumber) AS finding_id, CASE WHEN l_linenumber % 2 = 0 THEN 'resolved' ELSE 'open' END AS state FROM lineitem WHERE l_linenumber % 3 <> 0) "
    "SELECT run_id, count(*) AS n_issues, count(*) FILTER (coalesce(state, 'open') = 'open') AS n_open FROM findings LEFT JOIN triage USING (run_id, finding_id) WHERE status IN ('partial','non_compliant') GROUP BY run_id",
    "findings",
)
def _open_issue_count(t):
    """Issues whose triage state is open or absent."""
    triage = t.lineitem.filter("l_linenumber % 3 <> 0").selectExpr("l_orderkey AS run_id", "concat(l_orderkey, '-', l_linenumber) AS finding_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'resolved' ELSE 'open' END AS state")
    met = t.findings.filter(is_issue()).join(triage, ["run_id", "finding_id"], "left")
    return met.groupBy("run_id").agg(F.count("*").alias("n_issues"), F.count_if(F.coalesce("state", F.lit("open")) == "open").alias("n_open"))


@query(
    "score_summary_text",
    f", d AS (SELECT run_id, dimension, {_SCORE} AS s FROM findings GROUP BY run_id, dimension), g AS (SELECT run_id, coalesce({_SCORE}, 0) AS score, count(*) FILTER (status IN ('partial','non_compliant')) AS issues FROM findings GROUP BY run_id) "
    "SELECT run_id, concat('Overall score ', CAST(CAST(round(score * 100) AS INTEGER) AS VARCHAR), '% with ', CAST(issues AS VARCHAR), ' open issues. Strong: ', coalesce((SELECT string_agg(dimension, ', ' ORDER BY dimension) FROM d WHERE d.run_id = g.run_id AND s >= 0.75), 'none'), '.') AS summary FROM g",
    "findings",
)
def score_summary_text(t):
    """A deterministic summary: score, open issues and the dimensions of at least 0.75."""
    strong = score_by_dimension(t.findings).filter("score >= 0.75").groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("dimension")), ", ").alias("strong"))
    s = t.findings.groupBy("run_id").agg(F.coalesce(weighted_score(), F.lit(0.0)).alias("score"), F.count_if(is_issue()).alias("issues"))
    text = F.concat(F.lit("Overall score "), F.round(F.col("score") * 100).cast("int"), F.lit("% with "), "issues", F.lit(" open issues. Strong: "), F.coalesce("strong", F.lit("none")), F.lit("."))
    return s.join(strong, "run_id", "left").select("run_id", text.alias("summary"))


@query(
    "legacy_score",
    "SELECT run_id, round(greatest(0, 1 - CAST(count(*) FILTER (status IN ('partial','non_compliant')) AS DOUBLE) / greatest(1, count(DISTINCT section_no))), 3) AS score FROM findings GROUP BY run_id",
    "findings",
)
def legacy_score(t):
    """1 less flags over slots, not below 0."""
    g = t.findings.groupBy("run_id").agg(F.count_if(is_issue()).alias("flags"), F.countDistinct("section_no").alias("slots"))
    return g.select("run_id", F.round(F.greatest(F.lit(0.0), 1 - F.col("flags") / F.greatest(F.lit(1), F.col("slots"))), 3).alias("score"))


query("requirement_count", "SELECT code, count(*) AS n FROM requirements GROUP BY code", "requirements")(lambda t: t.requirements.groupBy("code").agg(F.count("*").alias("n")))
query("dimension_coverage", "SELECT code, string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS dimensions FROM requirements WHERE enabled GROUP BY code", "requirements")(
    lambda t: t.requirements.filter("enabled").groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("dimension")), ",").alias("dimensions"))
)


@query(
    "slot_coverage",
    ", filled AS (SELECT DISTINCT o_custkey AS template_id, l_partkey % 25 AS ord FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT s.template_id, count(*) FILTER (required) AS required_total, count(f.ord) FILTER (required) AS filled, "
    "coalesce(string_agg(CASE WHEN required AND f.ord IS NULL THEN title END, ',' ORDER BY s.ord), '') AS missing FROM slots s LEFT JOIN filled f ON s.template_id = f.template_id AND s.ord = f.ord GROUP BY s.template_id",
    "slots",
)
def _slot_coverage(t):
    """Required slots, how many are filled, and the titles of the missing ones in order."""
    filled = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("o_custkey AS template_id", "l_partkey % 25 AS ord", "true AS has").distinct()
    met = t.slots.join(filled, ["template_id", "ord"], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("required") & F.col("has").isNull(), F.struct("ord", "title"))))
    return met.groupBy("template_id").agg(
        F.count_if("required").alias("required_total"), F.count_if(F.col("required") & F.col("has").isNotNull()).alias("filled"), F.array_join(F.transform(missing, lambda x: x["title"]), ",").alias("missing")
    )
