"""Filters, projections, orderings and limits over audit and project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.scoring import is_issue, top_section
from leafmill.plans.registry import query

_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 WHEN 'info' THEN 3 ELSE 4 END"
_TOP = "CASE WHEN coalesce(trim(split_part(section_no, '.', 1)), '') = '' THEN '—' ELSE split_part(section_no, '.', 1) END"


def severity_rank():
    return F.expr(_RANK)


def findings_filter(findings: DataFrame, dimension=None, severity=None, status=None, section=None) -> DataFrame:
    """Optional equality on three columns and a prefix of the section number; None filters nothing."""
    for column, value in (("dimension", dimension), ("severity", severity), ("status", status)):
        if value is not None:
            findings = findings.filter(F.col(column) == value)
    return findings if section is None else findings.filter(F.col("section_no").startswith(section))


query("findings_filter", "SELECT run_id, finding_id, section_no, status FROM findings WHERE dimension = 'structure' AND severity = 'major' AND starts_with(section_no, '1')", "findings")(
    lambda t: findings_filter(t.findings, dimension="structure", severity="major", section="1").select("run_id", "finding_id", "section_no", "status")
)


def findings_view_filter(findings: DataFrame, dimension=None, top=None, text="", view="all", severity=None) -> DataFrame:
    """The reader's view: dimension, top section, contained text, status view (issues: partial or worse), severity."""
    out = findings_filter(findings, dimension=dimension, severity=severity)
    if top is not None:
        out = out.filter(top_section() == top)
    if text:
        out = out.filter(F.lower("requirement_title").contains(text.lower()) | F.lower(F.coalesce("section_no", F.lit(""))).contains(text.lower()))
    if view == "issues":
        return out.filter(is_issue())
    return out if view == "all" else out.filter(F.col("status") == view)


query("findings_view_filter", f"SELECT run_id, finding_id FROM findings WHERE {_TOP} = '3' AND (contains(lower(requirement_title), '7') OR contains(lower(coalesce(section_no, '')), '7')) AND status IN ('partial','non_compliant')", "findings")(
    lambda t: findings_view_filter(t.findings, top="3", text="7", view="issues").select("run_id", "finding_id")
)
query("finding_projection", "SELECT CAST(finding_id AS VARCHAR) AS id, section_no AS section, requirement_title AS title, dimension, severity, status, confidence FROM findings", "findings")(
    lambda t: t.findings.select(F.col("finding_id").cast("string").alias("id"), F.col("section_no").alias("section"), F.col("requirement_title").alias("title"), "dimension", "severity", "status", "confidence")
)


@query("guideline_list", "SELECT code, n FROM (SELECT code, count(*) AS n, bool_or(enabled) AS ready FROM requirements GROUP BY code) WHERE ready ORDER BY code", "requirements")
def _guideline_list(t):
    g = t.requirements.groupBy("code").agg(F.count("*").alias("n"), F.max("enabled").alias("ready"))
    return g.filter("ready").select("code", "n").orderBy("code")


def requirement_select(requirements: DataFrame, code: str, dimensions=None) -> DataFrame:
    """The enabled rows of a guideline, of some dimensions only where given, with a sort key that pads section numbers."""
    out = requirements.filter(F.col("enabled") & (F.col("code") == code))
    return out if dimensions is None else out.filter(F.col("dimension").isin(*dimensions))


query("requirement_select", "SELECT requirement_id, section_no, title, dimension FROM requirements WHERE enabled AND code = 'G1' AND dimension IN ('content', 'style')", "requirements")(
    lambda t: requirement_select(t.requirements, "G1", ("content", "style")).select("requirement_id", "section_no", "title", "dimension")
)


def deterministic_split(requirements: DataFrame) -> DataFrame:
    """Whether a requirement's constraint is one that rules can check, by its type."""
    kind = F.get_json_object("constraint_spec", "$.type")
    return requirements.select("requirement_id", kind.alias("constraint_type"), F.coalesce(kind.isin("max_pages", "min_pages", "cross_reference", "defined_at_first_use"), F.lit(False)).alias("deterministic"))


query("deterministic_split", "SELECT requirement_id, json_extract_string(constraint_spec, '$.type') AS constraint_type, constraint_spec IS NOT NULL AS deterministic FROM requirements", "requirements")(
    lambda t: deterministic_split(t.requirements)
)


def suspect_findings(findings: DataFrame, most: int = 40) -> DataFrame:
    """Per run the first findings in order that deserve a second look: critical, or major without evidence."""
    bad = (F.col("status") == "non_compliant") & F.col("requirement_id").isNotNull() & ((F.col("severity") == "critical") | ((F.col("severity") == "major") & (F.coalesce("evidence", F.lit("")) == "")))
    return findings.filter(bad).withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("ord"))).filter(F.col("_n") <= most).drop("_n")


query(
    "suspect_findings",
    "SELECT run_id, finding_id, severity FROM findings WHERE status = 'non_compliant' AND requirement_id IS NOT NULL AND (severity = 'critical' OR (severity = 'major' AND coalesce(evidence, '') = '')) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ord) <= 40",
    "findings",
)(lambda t: suspect_findings(t.findings).select("run_id", "finding_id", "severity"))


def project_progress(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """completed with a run that is done, in_progress with any run, else not_started."""
    r = runs.groupBy("project_id").agg(F.max(F.col("status") == "done").alias("done"))
    progress = F.when(F.col("done"), "completed").when(F.col("done").isNotNull(), "in_progress").otherwise("not_started")
    return projects.join(r, "project_id", "left").select("project_id", "name", progress.alias("progress"))


_PROGRESS = "SELECT project_id, name, CASE WHEN done THEN 'completed' WHEN done IS NOT NULL THEN 'in_progress' ELSE 'not_started' END AS progress FROM projects LEFT JOIN (SELECT project_id, bool_or(status = 'done') AS done FROM runs GROUP BY project_id) USING (project_id)"
query("project_progress", _PROGRESS, "projects runs")(lambda t: project_progress(t.projects, t.runs))
query("project_search", f", p AS ({_PROGRESS}) SELECT * FROM p WHERE (contains(lower(name), '#00000001') OR contains(CAST(project_id AS VARCHAR), '77')) AND progress = 'completed'", "projects runs")(
    lambda t: project_progress(t.projects, t.runs).filter((F.lower("name").contains("#00000001") | F.col("project_id").cast("string").contains("77")) & (F.col("progress") == "completed"))
)
query("issue_flags", "SELECT run_id, finding_id AS slot_id, CASE status WHEN 'non_compliant' THEN 'missing' ELSE 'weak' END AS kind, requirement_title AS message FROM findings WHERE status IN ('partial','non_compliant')", "findings")(
    lambda t: t.findings.filter(is_issue()).select("run_id", F.col("finding_id").alias("slot_id"), F.when(F.col("status") == "non_compliant", "missing").otherwise("weak").alias("kind"), F.col("requirement_title").alias("message"))
)
query("artifact_light", "SELECT artifact_id AS id, kind, size_bytes FROM artifacts", "artifacts")(lambda t: t.artifacts.select(F.col("artifact_id").alias("id"), "kind", "size_bytes"))
query("content_block_filter", "SELECT doc_id, pos, line FROM marked_lines WHERE trim(line) <> '' AND NOT contains(line, ' | ')", "marked_lines")(
    lambda t: t.marked_lines.filter((F.trim("line") != "") & ~F.col("line").contains(" | "))
)


@query(
    "needs_ocr",
    ", pages2 AS (SELECT doc_id, page, sum(length(text)) AS chars, count(*) AS drawings FROM spans GROUP BY doc_id, page) SELECT doc_id, avg(chars) < 50 OR (avg(chars) FILTER (page <= 8) < 350 AND sum(drawings) >= 200 AND sum(drawings) > 2 * sum(chars)) AS needs_ocr FROM pages2 GROUP BY doc_id",
    "spans",
)
def _needs_ocr(t):
    """Documents with hardly any text a page, or little text under very many drawings on the first eight pages."""
    p = t.spans.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("drawings"))
    few = F.avg("chars") < 50
    drawn = (F.avg(F.when(F.col("page") <= 8, F.col("chars"))) < 350) & (F.sum("drawings") >= 200) & (F.sum("drawings") > 2 * F.sum("chars"))
    return p.groupBy("doc_id").agg((few | drawn).alias("needs_ocr"))


# ------------------------------------------------------------------------------------------ orderings and limits

query("findings_sorted", f"SELECT run_id, finding_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY {_RANK}, coalesce(section_no, ''), ord) AS INTEGER) AS rank FROM findings", "findings")(
    lambda t: t.findings.select("run_id", "finding_id", F.row_number().over(Window.partitionBy("run_id").orderBy(severity_rank(), F.coalesce("section_no", F.lit("")), "ord")).alias("rank"))
)
_NUMERIC = f"CASE WHEN {_TOP} = '—' THEN 1 ELSE 0 END, TRY_CAST({_TOP} AS INTEGER)"
query("findings_grouped", f"SELECT run_id, finding_id, {_TOP} AS section, CAST(row_number() OVER (PARTITION BY run_id ORDER BY {_NUMERIC}, {_RANK}, ord) AS INTEGER) AS rank FROM findings", "findings")(
    lambda t: t.findings.withColumn("section", top_section()).select(
        "run_id", "finding_id", "section", F.row_number().over(Window.partitionBy("run_id").orderBy((F.col("section") == "—").cast("int"), F.expr("try_cast(section AS int)"), severity_rank(), "ord")).alias("rank")
    )
)


def top_issues(findings: DataFrame, most: int = 15) -> DataFrame:
    """Each run's heaviest issues; ties stay in order."""
    w = Window.partitionBy("run_id").orderBy(_issue_weight().desc(), "ord")
    return findings.filter(is_issue()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def _issue_weight():
    return F.expr("CASE severity WHEN 'critical' THEN 4 WHEN 'major' THEN 3 WHEN 'minor' THEN 2 WHEN 'info' THEN 1 ELSE 2 END")


_ISSUE_WEIGHT = "CASE severity WHEN 'critical' THEN 4 WHEN 'major' THEN 3 WHEN 'minor' THEN 2 WHEN 'info' THEN 1 ELSE 2 END"
query("top_issues", f"SELECT run_id, finding_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY {_ISSUE_WEIGHT} DESC, ord) AS INTEGER) AS rank FROM findings WHERE status IN ('partial','non_compliant') QUALIFY rank <= 15", "findings")(
    lambda t: top_issues(t.findings).select("run_id", "finding_id", "rank")
)
query("projects_page", "SELECT project_id, name FROM projects ORDER BY project_id DESC LIMIT 50 OFFSET 20", "projects")(lambda t: t.projects.select("project_id", "name").orderBy(F.desc("project_id")).offset(20).limit(50))
query("runs_recent", "SELECT project_id, run_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) AS INTEGER) AS recency FROM runs", "runs")(
    lambda t: t.runs.select("project_id", "run_id", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("run_id"))).alias("recency"))
)
query("first_document_name", "SELECT project_id, arg_min(flow || '-' || run_id, (created_at, run_id)) AS name FROM runs GROUP BY project_id", "runs")(
    lambda t: t.runs.groupBy("project_id").agg(F.min_by(F.concat("flow", F.lit("-"), "run_id"), F.struct("created_at", "run_id")).alias("name"))
)
query("latest_version", "SELECT project_id, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY run_id DESC) = 1", "runs")(
    lambda t: t.runs.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("run_id")))).filter("_n = 1").select("project_id", "run_id", "status")
)
query("conversation_order", "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n FROM history", "history")(
    lambda t: t.history.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))
)


@query(
    "history_tail",
    "SELECT conv_id, left(string_agg(role || ': ' || content, chr(10) ORDER BY turn), 1500) AS tail FROM (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id",
    "history",
)
def _history_tail(t):
    """The last four messages of a conversation in order, 1,500 characters at most."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = t.history.withColumn("_n", F.row_number().over(w)).filter("_n <= 4")
    text = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.concat(x["role"], F.lit(": "), x["content"]))
    return last.groupBy("conv_id").agg(F.substring(F.array_join(text, "\n"), 1, 1500).alias("tail"))


@query("latest_artifact", "SELECT run_id, arg_max(artifact_id, artifact_id) AS artifact_id, count(*) AS n FROM artifacts GROUP BY run_id", "artifacts")
def _latest_artifact(t):
    return t.artifacts.groupBy("run_id").agg(F.max_by("artifact_id", "artifact_id").alias("artifact_id"), F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------ set operations

@query("findings_union", "SELECT source, count(*) AS n FROM (SELECT 'model' AS source FROM findings WHERE requirement_id IS NOT NULL UNION ALL SELECT 'rule' FROM findings WHERE requirement_id IS NULL) GROUP BY source", "findings")
def _findings_union(t):
    model = t.findings.filter("requirement_id IS NOT NULL").withColumn("source", F.lit("model"))
    rule = t.findings.filter("requirement_id IS NULL").withColumn("source", F.lit("rule"))
    return model.unionByName(rule).groupBy("source").agg(F.count("*").alias("n"))


@query("toc_distinct", "SELECT code, section_no, min(requirement_id) AS first_id FROM requirements GROUP BY code, section_no", "requirements")
def _toc_distinct(t):
    w = Window.partitionBy("code", "section_no").orderBy("requirement_id")
    return t.requirements.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("code", "section_no", F.col("requirement_id").alias("first_id"))
