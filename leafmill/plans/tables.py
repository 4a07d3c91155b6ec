"""The tables that operators run on: the given ones, and projections of them in the shape of audit and layout data.

A derived table is a list of expressions over one given table that mean the same in Spark SQL and in DuckDB, or one
form for each engine where positions have to be exploded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_DIMENSION = "CASE {0} % 5 WHEN 0 THEN 'content' WHEN 1 THEN 'structure' WHEN 2 THEN 'formatting' WHEN 3 THEN 'style' ELSE 'tone' END"

PROJECTIONS: dict[str, tuple[str, list[str]]] = {
    "findings": ("lineitem", [
        "l_orderkey AS run_id",
        "concat(l_orderkey, '-', l_linenumber) AS finding_id",
        "l_linenumber AS ord",
        "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_partkey END AS requirement_id",
        "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE concat(1 + l_partkey % 16, '.', 1 + l_suppkey % 9) END AS section_no",
        "concat('Requirement ', l_partkey) AS requirement_title",
        _DIMENSION.format("l_partkey") + " AS dimension",
        "CASE l_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' WHEN 3 THEN 'info' ELSE 'unknown' END AS severity",
        "CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 'compliant' WHEN 1 THEN 'partial' WHEN 2 THEN 'non_compliant' ELSE 'not_applicable' END AS status",
        "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_discount * 12 END AS confidence",
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('quote ', l_partkey) END AS evidence",
    ]),
    "requirements": ("part", [
        "p_partkey AS requirement_id",
        "concat('G', p_size % 4) AS code",
        "concat(1 + p_partkey % 16, '.', 1 + p_size % 9) AS section_no",
        "p_name AS title",
        "concat('The document must address ', p_type) AS requirement_text",
        _DIMENSION.format("p_partkey") + " AS dimension",
        "CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' ELSE 'info' END AS severity_default",
        "CASE p_partkey % 6 WHEN 0 THEN '{\"type\":\"max_pages\",\"value\":3}' WHEN 1 THEN '{\"type\":\"min_pages\",\"value\":2}' "
        "WHEN 2 THEN '{\"type\":\"cross_reference\",\"value\":\"16.1.1\"}' WHEN 3 THEN '{\"type\":\"defined_at_first_use\"}' ELSE NULL END AS constraint_spec",
        "p_partkey % 19 <> 0 AS enabled",
    ]),
    "runs": ("orders", [
        "o_orderkey AS run_id",
        "o_custkey AS project_id",
        "CASE o_orderkey % 3 WHEN 0 THEN 'regenerate' WHEN 1 THEN 'style' ELSE 'compliance' END AS flow",
        "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'error' END AS status",
        "o_orderdate AS created_at",
    ]),
    "projects": ("customer", ["c_custkey AS project_id", "c_name AS name", "c_mktsegment AS flow_hint"]),
    "artifacts": ("lineitem", [
        "l_orderkey AS run_id",
        "concat(l_orderkey, ':', l_linenumber) AS artifact_id",
        "CASE l_linenumber % 4 WHEN 0 THEN 'rendered_docx' WHEN 1 THEN 'rendered_pdf' WHEN 2 THEN 'compliance_report_json' ELSE 'compliance_report_csv' END AS kind",
        "CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes",
    ]),
    "spans": ("lineitem", [
        "l_orderkey AS doc_id",
        "1 + l_linenumber % 2 AS page",
        "l_linenumber AS ord",
        "CAST(50 + l_partkey % 400 AS DOUBLE) AS x0",
        "CAST(50 + l_partkey % 400 + l_quantity AS DOUBLE) AS x1",
        "CAST(l_linenumber * 14 AS DOUBLE) AS y0",
        "CAST(l_linenumber * 14 + 11 AS DOUBLE) AS y1",
        "CAST(CASE l_suppkey % 7 WHEN 0 THEN 18 WHEN 1 THEN 14 ELSE 11 END AS DOUBLE) AS size",
        "l_suppkey % 5 = 0 AS bold",
        "CASE l_suppkey % 3 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Calibri' ELSE 'Georgia' END AS font",
        "concat('text ', l_partkey) AS text",
    ]),
    "page_lines": ("lineitem", [
        "l_suppkey AS doc_id",
        "1 + l_orderkey % (1 + l_suppkey % 9) AS page",
        "l_orderkey * 8 + l_linenumber AS ord",
        "CAST(l_linenumber * 110 - 80 AS DOUBLE) AS y0",
        "CAST(l_linenumber * 110 - 69 AS DOUBLE) AS y1",
        "CASE l_linenumber WHEN 1 THEN CASE l_partkey % 4 WHEN 0 THEN concat('Only  here ', CASE WHEN l_partkey % 8 = 0 THEN l_returnflag ELSE '' END) ELSE concat('Study Report ', l_suppkey, '  Page ', 1 + l_orderkey % (1 + l_suppkey % 9)) END "
        "WHEN 3 THEN 'A body line that repeats' WHEN 4 THEN '12' WHEN 7 THEN CASE l_partkey % 3 WHEN 0 THEN concat('Page ', 1 + l_orderkey % 7, ' of 12') WHEN 1 THEN 'CONFIDENTIAL' ELSE '' END ELSE concat('text ', l_partkey) END AS text",
    ]),
    "trace_events": ("events", [
        "user_id AS run_id",
        "event_id",
        "ts",
        "event_type AS agent",
        "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'hitl' ELSE 'running' END AS status",
        "props AS payload",
    ]),
    "hits": ("embeddings", ["vec_id AS id", "label AS collection", "embedding AS vector"]),
    "history": ("conversations", ["conv_id", "turn", "role", "text AS content"]),
    "evidence": ("benchmark", [
        "item_id AS evidence_id",
        "CASE item_id % 4 WHEN 0 THEN concat('(', text, ')') WHEN 1 THEN concat(substring(text, 1, 60), ' [...] ', 'missing tail words here') WHEN 2 THEN 'p. 12' ELSE text END AS quote",
    ]),
    "marked_lines": ("lines", [
        "doc_id",
        "pos",
        "CASE (doc_id + pos) % 12 WHEN 0 THEN concat(pos + 1, '. ', substring(line, 1, 40)) WHEN 1 THEN concat('- ', substring(line, 1, 60)) "
        "WHEN 2 THEN concat('- ', substring(line, 1, 60)) WHEN 3 THEN concat('A', pos, ' | B | C') WHEN 4 THEN concat('A', pos, ' | B | C') WHEN 5 THEN '' "
        "WHEN 6 THEN concat('Version: ', pos % 4, '.', doc_id % 10) WHEN 7 THEN concat('Prepared By: Author ', doc_id % 7) "
        "WHEN 8 THEN concat(1 + pos % 9, '.', 1 + doc_id % 9, ' Scope') WHEN 9 THEN 'SAFETY SUMMARY' ELSE line END AS line",
    ]),
}

#: Page heights of ``page_lines``: a row a page.
PAGE_SIZES = "SELECT DISTINCT 1 + l_orderkey % (1 + l_suppkey % 9) AS page, l_suppkey AS doc_id, CAST(700 + 40 * (l_orderkey % (1 + l_suppkey % 9) % 4) AS DOUBLE) AS height FROM lineitem"

#: Derived tables whose rows are exploded with a position: (DuckDB SQL, tables it needs).
EXPLODED = {
    "lines": "SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, trim(unnest(a)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)",
    "chunks": "SELECT doc_id, i AS pos, substring(t, i*500+1, 500) AS text FROM (SELECT doc_id, t, unnest(range(CAST((length(t)-1)//500 AS BIGINT)+1)) AS i FROM "
    "(SELECT doc_id, trim(regexp_replace(text,'[\\s\\x{0b}\\x{85}\\x{a0}]+',' ','g')) AS t FROM documents) WHERE length(t)>0)",
    "elements": "SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS tag, trim(unnest(b)) AS txt FROM (SELECT page_id AS doc_id, "
    "regexp_extract_all(html, '<(h1|h2|h3|p|li)(?:\\s[^>]*)?>([^<]*)', 1) AS a, regexp_extract_all(html, '<(h1|h2|h3|p|li)(?:\\s[^>]*)?>([^<]*)', 2) AS b FROM pages)",
    "slots": "SELECT c_custkey AS template_id, n.n_nationkey AS ord, n.n_name AS title, 1 + n.n_regionkey % 3 AS level, n.n_nationkey % 4 <> 3 AS required FROM customer CROSS JOIN nation n",
    "page_sizes": PAGE_SIZES,
    "doc_versions": "SELECT doc_id, 1 AS version, pos, line FROM lines UNION ALL SELECT doc_id, 2 AS version, pos, CASE WHEN pos % 5 = 0 THEN replace(line, 'the ', 'that ') ELSE line END AS line FROM lines WHERE pos % 7 <> 6",
}
NEEDS = {"marked_lines": ["lines"], "doc_versions": ["lines"]}


class Tables:
    """The tables of one folder by name, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in PROJECTIONS:
            source, expressions = PROJECTIONS[name]
            return getattr(self, source).selectExpr(*expressions)
        raise AttributeError(name)

    def placed(self, name: str) -> DataFrame:
        """A given table or a projection with ``place``, where a row stands in its table: file, then row of the file.

        An ORDER BY that leaves ties open is read in this order, so that reruns agree.
        """
        source, expressions = (name, ["*"]) if name in BASE else PROJECTIONS[name]
        return getattr(self, source).selectExpr(*expressions, "struct(_metadata.file_path, _metadata.row_index) AS place")

    @property
    def lines(self) -> DataFrame:
        return self.documents.selectExpr("doc_id", "posexplode(split(text, '\\n')) AS (pos, l)").selectExpr("doc_id", "pos", "trim(l) AS line")

    @property
    def chunks(self) -> DataFrame:
        from leafmill.operators.retrieval import chunk

        return chunk(self.documents, size=500)

    @property
    def elements(self) -> DataFrame:
        from leafmill.sources.html import html_elements

        return html_elements(self.pages)

    @property
    def page_sizes(self) -> DataFrame:
        page = "1 + l_orderkey % (1 + l_suppkey % 9) AS page"
        return self.lineitem.selectExpr(page, "l_suppkey AS doc_id", "CAST(700 + 40 * (l_orderkey % (1 + l_suppkey % 9) % 4) AS DOUBLE) AS height").distinct()

    @property
    def slots(self) -> DataFrame:
        n = self.nation.selectExpr("n_nationkey AS ord", "n_name AS title", "1 + n_regionkey % 3 AS level", "n_nationkey % 4 <> 3 AS required")
        # A template a customer, each with the same 25 slots.
        return self.customer.selectExpr("c_custkey AS template_id").crossJoin(F.broadcast(n))

    @property
    def doc_versions(self) -> DataFrame:
        old = self.lines.selectExpr("doc_id", "1 AS version", "pos", "line")
        new = self.lines.filter("pos % 7 <> 6").selectExpr("doc_id", "2 AS version", "pos", "CASE WHEN pos % 5 = 0 THEN replace(line, 'the ', 'that ') ELSE line END AS line")
        return old.union(new)


def sql_tables(names: list[str], body: str) -> str:
    """DuckDB SQL: the named derived tables as common table expressions, then ``body``, which may begin with another."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*NEEDS.get(n, []), n) if x not in wanted]
    parts = []
    for n in wanted:
        source, expressions = PROJECTIONS.get(n, ("", []))
        parts.append(f"{n} AS (" + (EXPLODED[n] if n in EXPLODED else f"SELECT {', '.join(expressions)} FROM {source}") + ")")
    body = body.strip()
    if not parts:
        return body
    return "WITH RECURSIVE " + ", ".join(parts) + ("" if body.startswith(",") else " ") + body
