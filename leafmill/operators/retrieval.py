"""Chunking, tokenising and ranked retrieval: BM25, cosine and their fallback."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.plans.registry import query
from leafmill.plans.shared import spread, written

#: Fixed values of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25
TOKEN = "[a-zA-Z][a-zA-Z0-9_-]+"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def chunk(docs: DataFrame, size: int = 500, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, text): windows of the white-space-collapsed text; a tail inside the previous window is kept."""
    step = max(1, size - overlap)
    rows = docs.select(F.col(id_col).alias("doc_id"), collapsed(F.col(text_col)).alias("t")).filter("length(t) > 0")
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("t") - 1) / step).cast("long"))))
    return rows.select("doc_id", "pos", F.col("t").substr((F.col("pos") * step + 1).cast("int"), F.lit(size)).alias("text"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


#: Postings, for each of the k, that the floor of a query's k-th score is taken from. Results don't depend on it.
SEED_POSTINGS = 64
#: Scores are compared with the floor with this much room, as they are rounded to six places.
ROOM = 1e-5
#: Chunks whose scores one task adds up: their sums, one a chunk and query, stay in its memory at any size of the corpus.
CHUNKS_A_TASK = 2000


def counted_terms(words: DataFrame, *keep: str) -> DataFrame:
    """(*keep, term, tf) of rows with a sorted array ``w``: the lengths of its runs, so that no row leaves its task."""
    last = F.filter(F.transform("w", lambda x, i: F.when((i + 1 == F.size("w")) | (F.get("w", i + 1) != x), i + 1)), lambda e: e.isNotNull())
    runs = words.select(*keep, "w", last.alias("_ends"))
    before = lambda i: F.coalesce(F.get("_ends", i - 1), F.lit(0))
    return runs.select(*keep, F.inline(F.transform("_ends", lambda e, i: F.struct(F.get("w", e - 1).alias("term"), (e - before(i)).cast("long").alias("tf")))))


def _postings(chunks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Written tables, postings (c, doc_id, pos, term, impact) of the terms that queries use and queries' terms, and the number of chunks.

    A posting's impact is its part of a score without the term's idf. A query's term has its weight (times x idf) and df.
    """
    each_chunk = spread(chunks).select("doc_id", "pos", F.array_sort(tokens(F.col("text"))).alias("w")).withColumn("n", F.size("w").cast("double")).withColumn("c", F.monotonically_increasing_id())
    words = written(each_chunk, "bm25-words")
    stats = words.agg(F.count("*").cast("double").alias("n_chunks"), F.avg("n").alias("avgdl"))
    frequency = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighted = written(frequency.join(F.broadcast(stats), how="cross").select("term", "df", idf.alias("idf")), "bm25-terms")  # one row of totals
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weight = F.col("times") * F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))
    mean = weighted.agg(F.avg("idf").alias("mean_idf"))
    terms = written(asked.join(weighted, "term").join(F.broadcast(mean), how="cross").select("query_id", "term", weight.alias("weight"), "df"), "bm25-query-terms")
    counted = counted_terms(words, "c", "doc_id", "pos", "n").join(terms.select("term").distinct(), "term", "left_semi").join(F.broadcast(stats), how="cross")
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avgdl")))
    return written(counted.select("c", "doc_id", "pos", "term", impact.alias("impact")), "bm25-postings"), terms, words.count()


def _added(postings: DataFrame, terms: DataFrame, n_chunks: int) -> DataFrame:
    """(c, doc_id, pos, query_id, part): what the terms add to the score of each chunk that has one of them.

    Postings are dealt by chunk, a bounded number of chunks a task; where the terms are few enough to be broadcast, sums need
    no other exchange.
    """
    tasks = max(postings.sparkSession.sparkContext.defaultParallelism, -(-n_chunks // CHUNKS_A_TASK))
    met = postings.repartition(tasks, "c").join(terms.select("query_id", "term", "weight"), "term")
    return met.groupBy("c", "doc_id", "pos", "query_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("part"))


def _floors(postings: DataFrame, terms: DataFrame, n_chunks: int, k: int) -> DataFrame:
    """(query_id, floor): a score that k chunks of a query have at least, by its rarest terms; no row where they have fewer.

    Only chunks at or above the floor need to be ranked, which spares most of the sort.
    """
    own = Window.partitionBy("query_id")
    before = F.coalesce(F.sum("df").over(own.orderBy(F.desc("weight"), "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    seeds = terms.withColumn("seed", before < SEED_POSTINGS * k)
    # A term's impact is at most K1 + 1, so terms of negative weight take away that much of it at most.
    low = seeds.filter("NOT seed").groupBy("query_id").agg(F.sum(F.least(F.lit(0.0), F.col("weight") * (K1 + 1))).alias("low"))
    first = _added(postings, seeds.filter("seed"), n_chunks).withColumn("_n", F.row_number().over(own.orderBy(F.desc("part")))).filter(F.col("_n") == k)
    return first.join(low, "query_id", "left").select("query_id", (F.col("part") + F.coalesce("low", F.lit(0.0)) - ROOM).alias("floor"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int | None = 4, per: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(query_id, rank, doc_id, pos, score): for each query (query_id, text) its k best chunks of positive score.

    Texts are tokenised once. Document frequencies are plain counts of each chunk's distinct terms, added up on the map
    side. Scores come from an equi-join on the term, so no query meets a chunk that shares none of its terms. Ranks are
    taken within ``per``; those of a query among the chunks that reach a floor that k chunks are known to reach.
    Repeated query terms count repeatedly. A negative idf is replaced by ``EPSILON`` times the mean idf of all terms. Ties
    go to the smaller doc_id and pos; without ``k`` all scores come back, unranked. Null texts have no terms.
    """
    postings, terms, n_chunks = _postings(chunks, queries)
    parts = _added(postings, terms, n_chunks)
    if k is not None and per == ("query_id",):
        floor = written(_floors(postings, terms, n_chunks, k), "bm25-floors")
        parts = parts.join(floor, "query_id", "left").filter("floor IS NULL OR part >= floor")
    total = parts.select("query_id", "doc_id", "pos", F.round("part", 6).alias("score")).filter("score > 0")
    if k is None:
        return total
    w = Window.partitionBy(*per).orderBy(F.desc("score"), "doc_id", "pos")
    return total.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "pos", "score")


_BM25 = """
, w AS (SELECT doc_id, pos, regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9_-]+') AS w FROM chunks)
, st AS (SELECT CAST(count(*) AS DOUBLE) AS n_chunks, avg(len(w)) AS avgdl FROM w)
, e AS (SELECT doc_id, pos, len(w) AS n, unnest(w) AS term FROM w)
, df AS (SELECT term, CAST(count(DISTINCT (doc_id, pos)) AS DOUBLE) AS df FROM e GROUP BY term)
, idf0 AS (SELECT term, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS idf FROM df, st)
, idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0)
, a AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9_-]+')) AS term FROM benchmark) GROUP BY ALL)
, p AS (SELECT doc_id, pos, n, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM a) GROUP BY ALL)
, s AS (SELECT query_id, doc_id, pos, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))), 6) AS score FROM p JOIN idf USING (term) JOIN a USING (term), st GROUP BY query_id, doc_id, pos)
, top AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS INTEGER) AS rank, doc_id, pos, score FROM s)
"""


def benchmark_queries(t) -> DataFrame:
    return t.benchmark.selectExpr("item_id AS query_id", "text")


query("bm25_topk", _BM25 + "SELECT * FROM top WHERE rank <= 4 AND score > 0", "chunks")(lambda t: bm25(t.chunks, benchmark_queries(t)))
query("domain_search", _BM25 + "SELECT query_id, rank, doc_id, pos, left(c.text, 400) AS text, round(score, 3) AS score FROM top JOIN chunks c USING (doc_id, pos) WHERE rank <= 4 AND score > 0", "chunks")(
    lambda t: bm25(t.chunks, benchmark_queries(t)).join(t.chunks, ["doc_id", "pos"]).select("query_id", "rank", "doc_id", "pos", F.substring("text", 1, 400).alias("text"), F.round("score", 3).alias("score"))
)


@query(
    "doc_chunk_topk",
    _BM25 + "SELECT query_id, string_agg(c.text, chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN chunks c USING (doc_id, pos) WHERE rank <= 10 AND score > 0 GROUP BY query_id",
    "chunks",
)
def _doc_chunk_topk(t):
    """The ten best chunks of a query, best first, joined by blank lines."""
    met = bm25(t.chunks, benchmark_queries(t), 10).join(t.chunks, ["doc_id", "pos"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return met.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))


@query(
    "rag_fill",
    _BM25 + "SELECT b.item_id AS query_id, coalesce(string_agg('[' || doc_id || '#' || pos || '] ' || c.text, chr(10) || chr(10) ORDER BY rank), '[TODO] No source passage found.') AS body FROM benchmark b LEFT JOIN (SELECT * FROM top WHERE rank <= 4 AND score > 0) x ON x.query_id = b.item_id LEFT JOIN chunks c USING (doc_id, pos) GROUP BY b.item_id",
    "chunks",
)
def _rag_fill(t):
    """A body a query from its source-tagged passages, or a line that says what is missing."""
    met = bm25(t.chunks, benchmark_queries(t)).join(t.chunks, ["doc_id", "pos"])
    tagged = F.concat(F.lit("["), "doc_id", F.lit("#"), "pos", F.lit("] "), "text")
    body = met.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", tagged.alias("p")))), lambda x: x["p"]), "\n\n").alias("body"))
    return benchmark_queries(t).select("query_id").join(body, "query_id", "left").select("query_id", F.coalesce("body", F.lit("[TODO] No source passage found.")).alias("body"))


query("chunk_fixed", "SELECT doc_id, pos, text FROM chunks", "chunks")(lambda t: chunk(t.documents, 500))
for _name, _size, _overlap in (("chunk_overlap", 700, 80), ("chunk_overlap_wide", 900, 120)):
    _step = _size - _overlap
    query(
        _name,
        f"SELECT doc_id, i AS pos, substring(t, CAST(i * {_step} + 1 AS INTEGER), {_size}) AS text FROM (SELECT doc_id, t, unnest(range(CAST((length(t) - 1) // {_step} AS BIGINT) + 1)) AS i FROM (SELECT doc_id, trim(regexp_replace(text,'[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}]+',' ','g')) AS t FROM documents) WHERE length(t) > 0)",
    )(lambda t, s=_size, o=_overlap: chunk(t.documents, s, o))

query("tokenize_bm25", "SELECT doc_id, pos, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens FROM (SELECT doc_id, pos, regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9_-]+') AS w FROM chunks)", "chunks")(
    lambda t: t.chunks.select("doc_id", "pos", tokens(F.col("text")).alias("w")).select("doc_id", "pos", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))
)
query(
    "tokenize_audit",
    "SELECT doc_id, pos, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 OR regexp_full_match(x, '[0-9]+')))), ' ') AS terms FROM chunks",
    "chunks",
)(lambda t: t.chunks.select("doc_id", "pos", F.array_join(F.array_sort(audit_tokens(F.col("text"))), " ").alias("terms")))


def audit_tokens(text: Column) -> Column:
    """The set of runs of a-z and digits that have three characters or are numbers."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) >= 3) | x.rlike("^[0-9]+$")))


query(
    "doc_frequency",
    ", e AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9_-]+')) AS term FROM chunks) SELECT term, count(DISTINCT (doc_id, pos)) AS df, count(*) AS tf FROM e GROUP BY term",
    "chunks",
)(lambda t: document_frequency(t.chunks))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """(term, df, tf): chunks that hold a term and its occurrences, by one aggregation; a first occurrence marks its chunk."""
    each = chunks.select(tokens(F.col("text")).alias("w")).select("w", F.posexplode("w").alias("at", "term"))
    return each.groupBy("term").agg(F.count_if(F.array_position("w", F.col("term")) == F.col("at") + 1).alias("df"), F.count("*").alias("tf"))



def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where one is zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Components of the vectors of one block: a block of a collection's vectors meets one of its queries in a task, so that memory
#: stays the same at any size. Results don't depend on it, nor on the rows and columns that are scored at once.
BLOCK_COMPONENTS, SCORED_ROWS, SCORED_COLUMNS = 1 << 18, 32, 2048
#: Tasks a core for the meetings of blocks.
BLOCK_TASKS_A_CORE = 4


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in double precision) for each length; a null vector has none."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64"), np.cumsum(lengths)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, values[(ends[rows] - n)[:, None] + np.arange(n)]


def _squares(vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        out += vectors[:, d] * vectors[:, d]
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all rows, added up component by component as ``cosine`` does, so that both give the same numbers."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, len(b), SCORED_COLUMNS):
        columns = np.ascontiguousarray(b[at : at + SCORED_COLUMNS].T)
        sums = np.zeros((len(a), columns.shape[1]))
        part = np.empty_like(sums)
        for d in range(a.shape[1]):
            np.multiply(a[:, d, None], columns[d], out=part)
            sums += part
        out[:, at : at + SCORED_COLUMNS] = sums
    return out


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Six places, half away from zero, as the engine rounds."""
    each, back = np.unique(scores, return_inverse=True)
    return np.array([float(Decimal(repr(float(x))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) if np.isfinite(x) else x for x in each])[back]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k places of largest rounded score, ties to the first; a score of NaN is the largest."""
    scores = np.where(np.isnan(scores), np.inf, scores)
    near = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - 2e-6) if len(scores) > k else np.arange(len(scores))
    return near[np.argsort(-_rounded(scores[near]), kind="stable")[:k]]


def _nearest(k: int):
    """A function of a block of queries and one of vectors that gives the k nearest (query_id, id, score) of each query in the block."""

    def nearest(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        vectors = vectors.take(pc.sort_indices(vectors["id"], null_placement="at_start"))
        blocks = [(rows, v, np.sqrt(_squares(v))) for rows, v in _matrices(vectors["x"].combine_chunks())]
        asked, found, scores = [], [], []
        for of, q in _matrices(queries["x"].combine_chunks()) if vectors.num_rows else ():
            for at in range(0, len(of), SCORED_ROWS):
                some = q[at : at + SCORED_ROWS]
                lengths, score = np.sqrt(_squares(some)), np.zeros((len(some), vectors.num_rows))
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    for rows, v, norms in blocks:
                        norm = lengths[:, None] * norms
                        # Vectors of another length have no score and come last.
                        value = _dots(some, v) / norm if v.shape[1] == q.shape[1] else -np.inf
                        score[:, rows] = np.where((norm > 0) | np.isnan(norm), value, 0.0)
                for row, place in zip(score, of[at : at + SCORED_ROWS], strict=True):
                    best = _best(row, k)
                    asked.append(np.full(len(best), place))
                    found.append(best)
                    scores.append(row[best])
        asked, found, scores = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((asked, "int64"), (found, "int64"), (scores, "float64")))
        return pa.table({"query_id": queries["query_id"].take(pa.array(asked)), "id": vectors["id"].take(pa.array(found)), "score": pa.array(scores, mask=np.isneginf(scores))})

    return nearest


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest vectors by cosine of each query (query_id, collection, query) within its collection, exactly.

    Each block of a collection's vectors meets each block of its queries in one task, which keeps k a query; no pair is made
    a row. Vectors and queries are cut into blocks by the components that a collection has.
    """
    types = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": vectors.schema["id"].dataType.simpleString()}
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c)).alias("x")
    blocks = lambda df, c, name: df.groupBy("collection").agg(F.ceil(F.sum(F.greatest(F.coalesce(F.size(c), F.lit(1)), F.lit(1))) / BLOCK_COMPONENTS).alias(name))
    cut = blocks(vectors, "vector", "_vs").join(blocks(queries, "query", "_qs"), "collection")
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    v = vectors.join(cut, "collection").select(F.col("collection").alias("_c"), "id", whole("vector"), dealt("id", "_vs").alias("_v"), copies("_qs").alias("_q"))
    q = queries.join(cut, "collection").select(F.col("collection").alias("_c"), "query_id", whole("query"), dealt("query_id", "_qs").alias("_q"), copies("_vs").alias("_v"))
    tasks, cell = BLOCK_TASKS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism, ["_c", "_v", "_q"]
    met = q.repartition(tasks, *cell).groupBy(*cell).cogroup(v.repartition(tasks, *cell).groupBy(*cell)).applyInArrow(_nearest(k), ", ".join(f"{n} {t}" for n, t in types.items()) + ", score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_HITS = "SELECT q.id AS query_id, h.id, round(list_dot_product(q.vector::DOUBLE[], h.vector::DOUBLE[]) / (sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[])) * sqrt(list_dot_product(h.vector::DOUBLE[], h.vector::DOUBLE[]))), 6) AS score FROM hits q JOIN hits h USING (collection) WHERE q.id % 100 = 0"


def _asked(t) -> DataFrame:
    return t.hits.filter("id % 100 = 0").selectExpr("id AS query_id", "collection", "vector AS query")


for _name, _k in (("vector_search", 5), ("vector_topk", 3)):
    query(_name, f", s AS ({_HITS}) SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= {_k}", "hits")(
        lambda t, k=_k: vector_search(t.hits, _asked(t), k)
    )


@query(
    "retrieval_fallback",
    _BM25
    + ", n AS (SELECT q.id AS query_id, h.id, round(list_dot_product(q.vector::DOUBLE[], h.vector::DOUBLE[]) / (sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[])) * sqrt(list_dot_product(h.vector::DOUBLE[], h.vector::DOUBLE[]))), 6) AS score "
    "FROM hits q JOIN benchmark b ON b.item_id = q.id JOIN hits h ON h.collection = CASE WHEN length(b.text) > 200 THEN -1 ELSE q.collection END WHERE h.id NOT IN (SELECT item_id FROM benchmark)), "
    "v AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score FROM n QUALIFY rank <= 4), v4 AS (SELECT * FROM v) "
    "SELECT query_id, 'vector' AS via, id, NULL AS pos, rank FROM v4 UNION ALL SELECT query_id, 'bm25', doc_id, pos, rank FROM top WHERE rank <= 4 AND score > 0 AND query_id NOT IN (SELECT query_id FROM v4)",
    "chunks hits",
)
def _retrieval_fallback(t):
    """Every item's vector is searched among the vectors that belong to no item; items of over 200 characters ask a collection without any."""
    items = t.benchmark.select(F.col("item_id").alias("id"), F.when(F.length("text") > 200, -1).alias("absent"))
    asked = t.hits.join(items, "id").select(F.col("id").alias("query_id"), F.coalesce("absent", "collection").alias("collection"), F.col("vector").alias("query"))
    found = retrieval_fallback(t.hits.join(items, "id", "left_anti"), asked, t.chunks, benchmark_queries(t))
    return found.select("query_id", "via", "id", "pos", "rank")


def retrieval_fallback(vectors: DataFrame, asked: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 4, floor: float | None = None) -> DataFrame:
    """(query_id, via, id, pos, rank, score): a query's k nearest vectors; where there is no vector hit, its BM25 hits.

    ``asked`` are the queries (query_id, text) that have a vector: (query_id, collection, query). Any vector of the
    collection is a hit, unless a ``floor`` is given that its score has to reach.
    """
    near = vector_search(vectors, asked, k)
    near = near if floor is None else near.filter(F.col("score") >= floor)
    v = near.select("query_id", F.lit("vector").alias("via"), "id", F.lit(None).cast("long").alias("pos"), "rank", "score")
    b = bm25(chunks, queries, k=k).join(v, "query_id", "left_anti")  # after BM25, whose plan holds the queries repeatedly
    return v.union(b.select("query_id", F.lit("bm25").alias("via"), F.col("doc_id").alias("id"), "pos", "rank", "score"))


#: A document of so many characters goes to an audit whole, a longer one as so many chunks a query.
WHOLE_DOCUMENT, CONTEXT_CHUNKS = 30_000, 10


def audit_context(docs: DataFrame, queries: DataFrame, whole: int = WHOLE_DOCUMENT, k: int = CONTEXT_CHUNKS) -> DataFrame:
    """(doc_id, query_id, context): what an audit reads of each document.

    A document of at most ``whole`` characters is read whole, once for all queries (query_id is null). Of a longer one each
    query reads its k best chunks (900 characters, 120 shared with the next), best first, joined by blank lines; a query
    that none of its chunks answers has no row. A null text has none either, an empty one is read as it is.
    """
    short = docs.filter(F.length("text") <= whole).select("doc_id", F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.col("text").alias("context"))
    pieces = chunk(docs.filter(F.length("text") > whole), 900, 120)
    met = bm25(pieces, queries, k, per=("query_id", "doc_id")).join(pieces, ["doc_id", "pos"])
    best = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return short.union(met.groupBy("doc_id", "query_id").agg(F.array_join(best, "\n\n").alias("context")))


_LONG = f", long_chunks AS (SELECT doc_id, i AS pos, substring(t, CAST(i * 780 + 1 AS INTEGER), 900) AS text FROM (SELECT doc_id, t, unnest(range(CAST((length(t) - 1) // 780 AS BIGINT) + 1)) AS i FROM (SELECT doc_id, trim(regexp_replace(text,'[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}]+',' ','g')) AS t FROM documents WHERE length(text) > {WHOLE_DOCUMENT}) WHERE length(t) > 0))"
query(
    "audit_context",
    "WITH " + _LONG[2:] + _BM25.replace("FROM chunks)", "FROM long_chunks)").replace("PARTITION BY query_id ORDER", "PARTITION BY query_id, doc_id ORDER")
    + f"SELECT doc_id, NULL AS query_id, text AS context FROM documents WHERE length(text) <= {WHOLE_DOCUMENT} UNION ALL SELECT doc_id, query_id, string_agg(c.text, chr(10) || chr(10) ORDER BY rank) FROM top JOIN long_chunks c USING (doc_id, pos) WHERE rank <= {CONTEXT_CHUNKS} AND score > 0 GROUP BY doc_id, query_id",
)(lambda t: audit_context(t.documents, benchmark_queries(t)))


@query("corpus_index", "SELECT concat(doc_id, '#', pos) AS chunk_id, doc_id, length(text) AS n_chars FROM chunks", "chunks")
def _corpus_index(t):
    return t.chunks.select(F.concat("doc_id", F.lit("#"), "pos").alias("chunk_id"), "doc_id", F.length("text").cast("long").alias("n_chars"))
