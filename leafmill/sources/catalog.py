"""Sources, sinks and table maintenance: scans, validation, exports, upserts, deletes and appends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.plans.registry import query
from leafmill.plans.shared import new_folder as scratch
from leafmill.plans.shared import spread, store

MAX_UPLOAD = 100 << 20
ALLOWED = ("docx", "doc", "pdf", "txt")
PROFILE = "name string, corpus_path string, glossary map<string,string>, format_rules array<string>"


#: Files that a corpus keeps in one folder, and characters of texts that a scan holds at a time.
FILES_PER_FOLDER, TEXT_BATCH = 1000, 4 << 20


def _entries(folder: str, deep: bool):
    """A function of batches of (path, folder): each folder becomes what lies in it, .txt files stay."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, _ = store(folder)
        for pdf in batches:
            for path, is_folder in zip(pdf["path"], pdf["folder"], strict=True):
                found = files.get_file_info(fs.FileSelector(path, recursive=deep)) if is_folder else []
                out = [(x.path, x.type == fs.FileType.Directory) for x in found] if is_folder else [(path, False)]
                yield pd.DataFrame([x for x in out if x[0].endswith(".txt") or (x[1] and not deep)], columns=["path", "folder"])

    return listed


def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of all .txt files under a folder; doc_id is the path below it; unreadable files are skipped.

    Tasks list the folder and read its files, so no list of files comes to the driver: one lists the first level, each folder
    found there is walked by one task, and the files of all are dealt anew.
    """
    _, root = store(folder)
    root = root.rstrip("/")
    tasks = 4 * spark.sparkContext.defaultParallelism

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = store(folder)
        out, held = [], 0
        for pdf in batches:
            for path in pdf["path"]:
                try:
                    with files.open_input_stream(path) as f:
                        text = f.read().decode("utf-8", "replace")
                except OSError:
                    continue
                out.append((path[len(root) + 1 :], text))
                held += len(text)
                if held > TEXT_BATCH:
                    yield pd.DataFrame(out, columns=["doc_id", "text"])
                    out, held = [], 0
        yield pd.DataFrame(out, columns=["doc_id", "text"])

    entry = "path string, folder boolean"
    first = spark.createDataFrame([(root, True)], entry).mapInPandas(_entries(folder, False), entry).repartition(tasks, "path")
    return first.mapInPandas(_entries(folder, True), entry).select("path").repartition(tasks, "path").mapInPandas(read, "doc_id string, text string")


def corpus_store(docs: DataFrame, folder: str) -> int:
    """Stores (doc_id, text) as one .txt file each under a folder, and returns their number; null texts have no file.

    Each task writes its own files, a thousand a folder, named by id, task and row: a repeated task writes the same ones.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = store(folder)
        task, n = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                own = f"{root.rstrip('/')}/{task}-{n // FILES_PER_FOLDER}"
                if n % FILES_PER_FOLDER == 0:
                    files.create_dir(own)
                with files.open_output_stream(f"{own}/{doc}-{task}-{n}.txt") as f:
                    f.write(text.encode())
                n += 1
        yield pd.DataFrame({"n": [n]})

    rows = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def domain_profiles(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """A row a wanted profile_id from one JSON file each; absent files and keys take defaults."""
    found = spark.read.schema(PROFILE).option("multiLine", "true").json(folder).withColumn("profile_id", F.regexp_extract(F.input_file_name(), "([^/]+)\\.json$", 1))
    met = wanted.join(found, "profile_id", "left")
    return met.select(
        "profile_id",
        F.coalesce("name", "profile_id").alias("name"),
        F.coalesce("glossary", F.expr("map_from_arrays(CAST(array() AS array<string>), CAST(array() AS array<string>))")).alias("glossary"),
        F.coalesce("format_rules", F.expr("CAST(array() AS array<string>)")).alias("format_rules"),
        "corpus_path",
    )


def glossary_head(profiles: DataFrame, most: int = 50) -> DataFrame:
    """The first terms of each profile's glossary, by term."""
    return profiles.select("profile_id", F.posexplode(F.slice(F.array_sort(F.map_entries("glossary")), 1, most)).alias("n", "e")).select("profile_id", "n", "e.key", "e.value")


def ingest_validate(files: DataFrame, allowed: tuple[str, ...] = ALLOWED, most: int = MAX_UPLOAD) -> DataFrame:
    """Adds reason: why a file (name, size_bytes) is not accepted; null if it is."""
    reason = F.when(~X.extension(F.col("name")).isin(*allowed), "type").when(F.col("size_bytes") > most, "too large").when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty")
    return files.withColumn("reason", reason)


query(
    "ingest_validate",
    ", f AS (SELECT concat('file', l_linenumber, '.', CASE l_suppkey % 5 WHEN 0 THEN 'exe' WHEN 1 THEN 'PDF' WHEN 2 THEN 'docx' WHEN 3 THEN 'txt' ELSE 'doc' END) AS name, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE CAST(floor(l_extendedprice * 3000) AS BIGINT) END AS size_bytes FROM lineitem) "
    "SELECT CASE WHEN ends_with(lower(name), '.exe') THEN 'type' WHEN size_bytes > 104857600 THEN 'too large' WHEN size_bytes = 0 THEN 'empty' END AS reason, count(*) AS n FROM f GROUP BY ALL".replace(", f AS", "WITH f AS", 1),
)(
    lambda t: ingest_validate(
        t.lineitem.selectExpr("concat('file', l_linenumber, '.', CASE l_suppkey % 5 WHEN 0 THEN 'exe' WHEN 1 THEN 'PDF' WHEN 2 THEN 'docx' WHEN 3 THEN 'txt' ELSE 'doc' END) AS name", "CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE CAST(floor(l_extendedprice * 3000) AS BIGINT) END AS size_bytes")
    ).groupBy("reason").agg(F.count("*").alias("n"))
)


def content_hash_dedup(docs: DataFrame) -> DataFrame:
    """The smallest id of each distinct content, with the content's hash and number of copies."""
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


query("content_hash_dedup", "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")(lambda t: content_hash_dedup(t.documents))
query("artifact_key", "SELECT artifact_id, 'runs/' || run_id || '/' || regexp_replace(kind || ' v1', '[^A-Za-z0-9._-]+', '_', 'g') || '.bin' AS key, 'bin' AS ext FROM artifacts", "artifacts")(
    lambda t: t.artifacts.withColumn("key", F.concat(F.lit("runs/"), "run_id", F.lit("/"), X.safe_filename(F.concat("kind", F.lit(" v1"))), F.lit(".bin"))).select("artifact_id", "key", X.extension(F.col("key")).alias("ext"))
)

#: Deliverable -> (label, flows that make it).
DELIVERABLES = (("rendered_docx", "Document", "regenerate,style"), ("rendered_pdf", "PDF", "regenerate,style"), ("compliance_report_json", "Findings JSON", "compliance"), ("compliance_report_csv", "Findings CSV", "compliance"))


def export_catalog(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per finished run the deliverables of its flow: the first artifact of each kind, or why there is none."""
    spec = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(name).alias("label"), F.lit(flows).alias("flows")) for k, name, flows in DELIVERABLES])
    wanted = runs.filter("status = 'done'").select("run_id", "flow", F.explode(spec).alias("s")).filter(F.array_contains(F.split("s.flows", ","), F.col("flow")))
    first = artifacts.groupBy("run_id", "kind").agg(F.min("artifact_id").alias("artifact_id"))
    met = wanted.select("run_id", "s.kind", "s.label").join(first, ["run_id", "kind"], "left")
    return met.select("run_id", "kind", "label", "artifact_id", F.col("artifact_id").isNotNull().alias("available"), F.when(F.col("artifact_id").isNull(), "not produced").alias("reason"))


query(
    "export_catalog",
    ", s AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}', '{f}')" for k, n, f in DELIVERABLES) + ") v(kind, label, flows)), a AS (SELECT run_id, kind, min(artifact_id) AS artifact_id FROM artifacts GROUP BY ALL) SELECT r.run_id, s.kind, label, artifact_id, artifact_id IS NOT NULL AS available, CASE WHEN artifact_id IS NULL THEN 'not produced' END AS reason FROM runs r JOIN s ON list_contains(string_split(flows, ','), flow) LEFT JOIN a ON a.run_id = r.run_id AND a.kind = s.kind WHERE status = 'done'",
    "runs artifacts",
)(lambda t: export_catalog(t.runs, t.artifacts))


#: The columns of the flat export, in order, and those of a finding that it takes from the citation.
CSV_COLUMNS = "section dimension status severity confidence requirement_title doc_location evidence rationale suggested_fix citation_section citation_quote".split()


def findings_flat(findings: DataFrame) -> DataFrame:
    """The columns of the flat export: the citation's section and quote beside the finding's own; missing ones are null."""
    have = set(findings.columns)
    own = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    cited = lambda f: F.col(f"citation.{f}").cast("string") if "citation" in have else F.lit(None).cast("string")
    special = {"section": F.coalesce(own("section"), own("section_no")), "citation_section": cited("guideline_section"), "citation_quote": cited("quote")}
    return findings.select(*[special.get(c, own(c)).alias(c) for c in CSV_COLUMNS])


def findings_csv(findings: DataFrame, path: str) -> None:
    """Writes the flat export of findings, with a header; quotes and line breaks in texts survive."""
    findings_flat(findings).write.csv(path, header=True, escape='"', quoteAll=True)


@query("findings_csv_sink", "SELECT section_no AS section, dimension, status, severity, confidence, requirement_title, NULL::VARCHAR AS doc_location, evidence, NULL::VARCHAR AS rationale, NULL::VARCHAR AS suggested_fix, section_no AS citation_section, evidence AS citation_quote FROM findings", "findings")
def _findings_csv_sink(t):
    path = scratch(t.spark, "findings")
    findings_csv(t.findings.withColumn("citation", F.struct(F.col("section_no").alias("guideline_section"), F.col("evidence").alias("quote"))), path)
    schema = ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in CSV_COLUMNS)
    return t.spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)


def report_json(findings: DataFrame) -> DataFrame:
    """(run_id, report): the nested payload of a run as JSON, its findings in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "finding_id", "status", "severity")))
    return findings.groupBy("run_id").agg(F.count("*").alias("n"), rows.alias("findings")).select("run_id", "n", F.to_json(F.struct("run_id", "findings")).alias("report"))


query("report_json_sink", "SELECT run_id, count(*) AS n, len(list(finding_id)) AS n_json FROM findings GROUP BY run_id", "findings")(
    lambda t: report_json(t.findings).select("run_id", "n", F.json_array_length(F.get_json_object("report", "$.findings")).cast("long").alias("n_json"))
)
query("content_json_sink", "SELECT doc_id, count(*) AS n_elements, count(*) FILTER (tag = 'li') AS n_omitted FROM elements GROUP BY doc_id", "elements")(lambda t: _content_json(t))


def _content_json(t) -> DataFrame:
    """Elements written as JSON with heavy content blanked, read back and counted."""
    path = scratch(t.spark, "content")
    t.elements.select("doc_id", "pos", "tag", F.when(F.col("tag") == "li", "<omitted>").otherwise(F.col("txt")).alias("txt")).write.json(path)
    back = t.spark.read.schema("doc_id long, pos int, tag string, txt string").json(path)
    return back.groupBy("doc_id").agg(F.count("*").alias("n_elements"), F.count_if(F.col("txt") == "<omitted>").alias("n_omitted"))


query("formatting_json_sink", "SELECT doc_id, count(DISTINCT font) AS n_fonts, max(size) AS max_size FROM spans GROUP BY doc_id", "spans")(lambda t: _formatting_json(t))


def _formatting_json(t) -> DataFrame:
    path = scratch(t.spark, "formatting")
    t.spans.groupBy("doc_id").agg(F.struct(F.array_sort(F.collect_set("font")).alias("fonts"), F.max("size").alias("max_size")).alias("styling")).write.json(path)
    return t.spark.read.schema("doc_id long, styling struct<fonts:array<string>,max_size:double>").json(path).select("doc_id", F.size("styling.fonts").cast("long").alias("n_fonts"), "styling.max_size")


def change_report(old: DataFrame, new: DataFrame, most: int = 1500) -> DataFrame:
    """(doc_id, pos, before, after) of the positions whose text differs, cut to ``most`` characters and a mark.

    Positions are those of sections, which a rewrite keeps: one that only one version has comes with the other side null.
    Where lines have moved, ``version_phrases`` pairs them first.
    """
    cut = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(" …"))).otherwise(F.col(c))
    met = old.select("doc_id", "pos", F.col("line").alias("b")).join(new.select("doc_id", "pos", F.col("line").alias("a")), ["doc_id", "pos"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return met.select("doc_id", "pos", cut("b").alias("before"), cut("a").alias("after"))


query("change_report", ", o AS (SELECT * FROM doc_versions WHERE version = 1), n AS (SELECT * FROM doc_versions WHERE version = 2) SELECT doc_id, pos, CASE WHEN length(o.line) > 60 THEN left(o.line, 60) || ' …' ELSE o.line END AS before, CASE WHEN length(n.line) > 60 THEN left(n.line, 60) || ' …' ELSE n.line END AS after FROM o FULL JOIN n USING (doc_id, pos) WHERE o.line IS DISTINCT FROM n.line", "doc_versions")(
    lambda t: change_report(t.doc_versions.filter("version = 1"), t.doc_versions.filter("version = 2"), 60)
)

# ------------------------------------------------------------------------------------------ tables


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All rows of both by key, the last write winning: rows carry batch and pos."""
    both = old.unionByName(new)
    w = Window.partitionBy(key).orderBy(F.desc("batch"), F.desc("pos"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


query("vector_upsert", ", u AS (SELECT id, collection, 1 AS batch, id AS pos FROM hits UNION ALL SELECT id % 400, collection + 100, 2, id FROM hits WHERE id % 3 = 0) SELECT id, collection FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC, pos DESC) = 1", "hits")(
    lambda t: upsert(t.hits.selectExpr("id", "collection", "1 AS batch", "id AS pos"), t.hits.filter("id % 3 = 0").selectExpr("id % 400 AS id", "collection + 100 AS collection", "2 AS batch", "id AS pos")).select("id", "collection")
)


def replace_guideline(old: DataFrame, new: DataFrame) -> DataFrame:
    """The codes of ``new`` replace theirs in ``old`` with all their rows."""
    return old.join(new.select("code").distinct(), "code", "left_anti").unionByName(new)


query("guideline_replace", ", new AS (SELECT requirement_id + 1000000000 AS requirement_id, 'G1' AS code, 'New ' || title AS title FROM requirements WHERE code = 'G2') SELECT requirement_id, code, title FROM requirements WHERE code NOT IN (SELECT code FROM new) UNION ALL SELECT * FROM new", "requirements")(
    lambda t: replace_guideline(t.requirements.select("requirement_id", "code", "title"), t.requirements.filter("code = 'G2'").selectExpr("requirement_id + 1000000000 AS requirement_id", "'G1' AS code", "concat('New ', title) AS title"))
)
query("guideline_publish", ", g AS (SELECT DISTINCT code, 'extracted' AS status FROM requirements), p AS (SELECT * FROM (VALUES ('G0', 'ready'), ('G1', 'bogus'), ('G2', NULL)) v(code, new)) SELECT code, CASE WHEN new IN ('ingesting','extracted','ready') THEN new ELSE status END AS status, new IS NOT NULL AND new NOT IN ('ingesting','extracted','ready') AS rejected FROM g LEFT JOIN p USING (code)", "requirements")(
    lambda t: publish(t.requirements.select("code").distinct().withColumn("status", F.lit("extracted")), F.create_map(F.lit("G0"), F.lit("ready"), F.lit("G1"), F.lit("bogus")))
)


def publish(guidelines: DataFrame, changes) -> DataFrame:
    """Status changes (a map of code to status) where the new status exists; others are marked rejected."""
    new = F.element_at(changes, F.col("code"))
    known = new.isin("ingesting", "extracted", "ready")
    return guidelines.select("code", F.when(F.coalesce(known, F.lit(False)), new).otherwise(F.col("status")).alias("status"), F.coalesce(new.isNotNull() & ~known, F.lit(False)).alias("rejected"))


def cascade_delete(dead: DataFrame, runs: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What stays of ``runs`` and its ``children`` (tables with a run_id) when the projects ``dead`` go, by anti-joins.

    Rows of a null project or run, and children of a run that is in no table, stay.
    """
    gone = runs.join(dead.select("project_id").distinct(), "project_id", "left_semi").select("run_id").distinct()
    kept = {name: df.join(gone, "run_id", "left_anti") for name, df in children.items()}
    return {"runs": runs.join(dead.select("project_id").distinct(), "project_id", "left_anti"), **kept}


query(
    "cascade_delete",
    ", gone AS (SELECT run_id FROM runs JOIN projects USING (project_id) WHERE project_id % 10 = 0), k AS (SELECT 'runs' AS child, run_id FROM runs UNION ALL SELECT 'findings', run_id FROM findings UNION ALL SELECT 'artifacts', run_id FROM artifacts) SELECT child, run_id, count(*) AS n FROM k WHERE run_id NOT IN (SELECT run_id FROM gone) GROUP BY ALL",
    "projects runs findings artifacts",
)(lambda t: _after_delete(t))


def _after_delete(t) -> DataFrame:
    """Rows that stay of each table, by run, when every tenth project goes."""
    kept = cascade_delete(t.projects.filter("project_id % 10 = 0"), t.runs, {"findings": t.findings, "artifacts": t.artifacts})
    one, *others = [df.select(F.lit(name).alias("child"), "run_id") for name, df in kept.items()]
    for other in others:
        one = one.union(other)
    return one.groupBy("child", "run_id").agg(F.count("*").alias("n"))


query("version_append", ", v AS (SELECT project_id, count(*) AS version FROM runs WHERE status = 'done' GROUP BY project_id) SELECT r.run_id, project_id, coalesce(version, 0) + row_number() OVER (PARTITION BY project_id ORDER BY r.run_id) AS version FROM runs r LEFT JOIN v USING (project_id) WHERE status = 'running'", "runs")(
    lambda t: t.runs.filter("status = 'running'").join(t.runs.filter("status = 'done'").groupBy("project_id").agg(F.count("*").alias("v")), "project_id", "left").select("run_id", "project_id", (F.coalesce("v", F.lit(0)) + F.row_number().over(Window.partitionBy("project_id").orderBy("run_id"))).alias("version"))
)


@query("findings_append", "SELECT run_id, count(*) AS n FROM findings GROUP BY run_id", "findings")
def _findings_append(t):
    """Two appends to a table of findings, read back by run."""
    path = scratch(t.spark, "appended")
    for half in ("run_id % 2 = 0", "run_id % 2 = 1"):
        t.findings.filter(half).select("run_id", "finding_id", "status").repartitionByRange(4, "run_id").write.mode("append").parquet(path)
    return t.spark.read.schema("run_id long, finding_id string, status string").parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


query("elements_scan", "SELECT doc_id, pos, tag, txt FROM elements", "elements")(lambda t: _stored_elements(t))


def _stored_elements(t) -> DataFrame:
    """Content stored as one JSON array a document, parsed into element rows again."""
    stored = t.elements.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "tag", "txt")))).alias("content"))
    return stored.select("doc_id", F.explode(F.from_json("content", "array<struct<pos:int,tag:string,txt:string>>")).alias("e")).select("doc_id", "e.pos", "e.tag", "e.txt")


@query("corpus_scan", "SELECT CAST(doc_id AS VARCHAR) AS name, length(text) AS n_chars FROM documents")
def _corpus_scan(t):
    """Documents stored as one text file each, found again by a recursive scan; null texts have no file and no length."""
    path = scratch(t.spark, "corpus")
    corpus_store(spread(t.documents), path)
    name = F.nullif(F.regexp_extract("doc_id", "([^/]*)-[0-9]+-[0-9]+\\.txt$", 1), F.lit(""))
    back = corpus_scan(t.spark, path).select(name.alias("name"), F.length("text").cast("long").alias("n_chars"))
    return back.union(t.documents.filter("text IS NULL").select(F.col("doc_id").cast("string"), F.lit(None).cast("long")))


@query("domain_profile_scan", "SELECT n_name AS profile_id, CASE WHEN n_nationkey % 3 = 0 THEN 'Profile ' || n_name ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS n_terms FROM nation")
def _domain_profile_scan(t):
    path = scratch(t.spark, "profiles")
    some = t.nation.filter("n_nationkey % 3 = 0").selectExpr("n_name AS profile_id", "named_struct('name', concat('Profile ', n_name), 'glossary', map(n_name, 'term')) AS p")
    some.select("profile_id", F.to_json("p").alias("value")).repartition("profile_id").write.partitionBy("profile_id").text(path)
    found = t.spark.read.schema(PROFILE).option("recursiveFileLookup", "true").json(path).withColumn("profile_id", F.url_decode(F.regexp_extract(F.input_file_name(), "profile_id=([^/]+)/", 1)))
    met = t.nation.select(F.col("n_name").alias("profile_id")).join(found, "profile_id", "left")
    return met.select("profile_id", F.coalesce("name", "profile_id").alias("name"), F.coalesce(F.size("glossary"), F.lit(0)).alias("n_terms")).select("profile_id", "name", F.greatest(F.lit(0), F.col("n_terms")).alias("n_terms"))
