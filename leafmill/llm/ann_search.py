"""Approximate nearest neighbours by cosine: probed lists scanned with adaptive dimension sampling.

Equal vectors are one entry with their smallest ids. Entries are dealt to inverted lists by the nearest of a bounded
number of centroids; a query probes the lists of its nearest centroids, as many as a bounded sample needs for the recall
aimed at. Vectors are rotated by a random orthogonal matrix and compared in blocks of columns: after each block a
hypothesis test abandons candidates whose partial distance says that they are, almost surely, farther than the nearest
found so far. A first round scans each query's nearest list; its k-th distance bounds the second round over the other
lists, where the bound is tightened as distances become known. Survivors get the exact cosine in double precision.

Lists are packed into shards of bounded size and a task scans one shard for many queries, so that a query's vector is
copied once a shard that it probes, not once a list, and a task returns k + 1 rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._shared import written

K = 5
SAMPLE = 20_000  #: vectors that the centroids are fitted on, about; chosen by a hash of the id
MAX_LISTS = 4_096
TARGET = 0.95  #: recall that the number of probed lists is fitted to, on the sample
TRIALS = 300  #: vectors of the sample that are searched for it
MIN_PROBES = 8
BLOCK = 16  #: columns compared at a time
EPSILON = 2.1  #: of the hypothesis test; larger abandons later
CHUNK_ENTRIES = 16_384  #: entries in a shard
CHUNK_QUERIES = 2_048
AT_ONCE = 128  #: queries that are compared with a shard at a time
SALTS = (4_096, 64)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    # Scaled first, so that very large or small components neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column, dim: int) -> Column:
    """Vectors that take part: of the given dimension, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0)


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """(va, vb, ids): each vector's n smallest ids, by salted rounds, so that a very common vector is never in one task whole."""
    keys = ["va", "vb"]
    for salts in (*SALTS, 1):
        w = Window.partitionBy(*keys, F.pmod(F.xxhash64("id"), F.lit(salts))).orderBy("id")
        rows = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[at : at + 4096] @ c.T).argmax(axis=1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), x[rng.choice(len(x), k)])
    return c


def probes_needed(x: np.ndarray, centroids: np.ndarray, k: int, target: float = TARGET, trials: int = TRIALS) -> float:
    """The share of lists that queries from the sample ``x`` must probe to find ``target`` of their k nearest in it."""
    asked = np.linspace(0, len(x) - 1, min(trials, len(x))).astype(int)
    home = np.concatenate([(x[at : at + 4096] @ centroids.T).argmax(axis=1) for at in range(0, len(x), 4096)])
    order = np.argsort(-(x[asked] @ centroids.T), axis=1)
    place = np.argsort(order, axis=1)  # of each list among a query's probes
    sim = x[asked] @ x.T
    sim[np.arange(len(asked)), asked] = -2
    near = np.argsort(-sim, axis=1)[:, : min(k, len(x) - 1)]
    found_at = np.sort(place[np.arange(len(asked))[:, None], home[near]].ravel())
    return 1.0 if not len(found_at) else (found_at[int(np.ceil(target * len(found_at))) - 1] + 1) / len(centroids)


def _top(queries: np.ndarray, values: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each query's k smallest values."""
    order = np.lexsort((ties, values, queries))
    q = queries[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def scan(entries, ids, allowed, queries, bounds, rotated, k: int, epsilon: float = EPSILON, block: int = BLOCK):
    """(query index, entry index, exact cosine) of the k nearest entries of each query that the tests leave.

    entries, queries: unit vectors; ids break ties; allowed: boolean matrix, which entries each query looks at; bounds:
    squared distances within which a query's k nearest are known to lie (infinite, where nothing is known).
    """
    dim = entries.shape[1]
    e, q = entries @ rotated, queries @ rotated
    at = min(block, dim)
    first = (e[:, :at] ** 2).sum(1)[None, :] - 2 * (q[:, :at] @ e[:, :at].T) + (q[:, :at] ** 2).sum(1)[:, None]
    first = np.where(allowed, np.maximum(first, 0), np.inf)

    def tighten(qi, ei, part):
        """Bounds from the full distances of each query's most promising candidates."""
        best = _top(qi, part, ids[ei], 2 * k)
        full = ((e[ei[best]] - q[qi[best]]) ** 2).sum(1)
        kth = _top(qi[best], full, ids[ei[best]], k)
        count = np.bincount(qi[best][kth], minlength=len(q))
        most = np.full(len(q), -1.0)
        np.maximum.at(most, qi[best][kth], full[kth])
        return np.where(count >= k, np.minimum(bounds, most), bounds)

    some = np.argpartition(first, min(2 * k, first.shape[1]) - 1, axis=1)[:, : 2 * k]
    qi, ei = np.repeat(np.arange(len(q)), some.shape[1]), some.ravel()
    real = np.isfinite(first[qi, ei])
    bounds = tighten(qi[real], ei[real], first[qi[real], ei[real]])
    factor = lambda at: (1 + epsilon / np.sqrt(at)) ** 2 * at / dim if at < dim else 1 + 1e-9
    qi, ei = np.nonzero(first <= (bounds * factor(at) + 1e-12)[:, None])
    keep = np.isfinite(first[qi, ei])
    qi, ei = qi[keep], ei[keep]
    part = first[qi, ei]
    while at < dim:
        to = min(at + block, dim)
        part = part + ((e[ei, at:to] - q[qi, at:to]) ** 2).sum(1)
        at = to
        if at < dim:
            bounds = tighten(qi, ei, part)
        keep = part <= bounds[qi] * factor(at) + 1e-12
        qi, ei, part = qi[keep], ei[keep], part[keep]
    cos = np.einsum("ij,ij->i", entries[ei], queries[qi])
    best = _top(qi, -cos, ids[ei], k)
    return qi[best], ei[best], cos[best]


def _lists(items: DataFrame, centroids: np.ndarray) -> DataFrame:
    """items (rep, least, vec) with the nearest list of each."""
    shared = items.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf["list"] = np.concatenate([(_unit(pdf["vec"][at : at + 2048]) @ shared.value.T).argmax(axis=1) for at in range(0, len(pdf), 2048)]).astype(np.int32)
                yield pdf

    return items.select("rep", "least", "vec").mapInPandas(run, "rep long, least long, vec array<float>, list int")


def _shards(counts: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each list: small lists share one, large ones have several."""
    base, pieces = np.zeros(lists, np.int64), np.ones(lists, np.int64)
    at = used = 0
    for i in range(lists):
        n = counts.get(i, 0)
        if used and used + n > CHUNK_ENTRIES:
            at, used = at + 1, 0
        base[i], pieces[i] = at, -(-max(n, 1) // CHUNK_ENTRIES)
        used += n
        if pieces[i] > 1:
            at, used = at + int(pieces[i]), 0
    return base, pieces


def _probing(items: DataFrame, centroids: np.ndarray, base: np.ndarray, pieces: np.ndarray, start: int, stop: int) -> DataFrame:
    """items (rep, vec, bound): a row a shard with the lists of it among the query's nearest ones, from ``start`` to ``stop``."""
    shared = items.sparkSession.sparkContext.broadcast((centroids, base, pieces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, base, pieces = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                order = np.argsort(-(_unit(part["vec"]) @ c.T), axis=1, kind="stable")[:, start:stop]
                out = []
                for rep, vec, bound, lists in zip(part["rep"], part["vec"], part["bound"], order, strict=True):
                    lists = np.sort(lists)
                    for some in np.split(lists, np.flatnonzero(np.diff(base[lists])) + 1):
                        out += [(int(base[some[0]]) + j, rep, vec, bound, some) for j in range(int(pieces[some].max()))] if len(some) else []
                yield pd.DataFrame(out, columns=["shard", "rep", "vec", "bound", "lists"])

    return items.select("rep", "vec", "bound").mapInPandas(run, "shard long, rep long, vec array<float>, bound double, lists array<int>")


def _found(entries: DataFrame, asking: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """(query, rep, least, score): the k nearest entries of each query in each shard that it asks.

    Queries of a shard that many ask are dealt over parts, each of which has the shard's entries. How many is a table with
    a row a shard, which grows with the vectors: Spark broadcasts it while it is small.
    """
    parts = written(asking.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("pieces")), "ann-parts")
    left = entries.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    right = asking.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")).drop("pieces")

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.empty(0, np.int64), "rep": np.empty(0, np.int64), "least": np.empty(0, np.int64), "score": np.empty(0)})]
        if candidates.empty or queries.empty:
            return out[0]
        e, least, reps = _unit(candidates["vec"]), candidates["least"].to_numpy(), candidates["rep"].to_numpy()
        code, home = np.unique(candidates["list"].to_numpy(), return_inverse=True)
        for at in range(0, len(queries), AT_ONCE):
            some = queries.iloc[at : at + AT_ONCE]
            probed = np.stack([np.isin(code, lists) for lists in some["lists"]])
            bounds = some["bound"].fillna(np.inf).to_numpy(float)
            qi, ei, cos = scan(e, least, probed[:, home], _unit(some["vec"]), bounds, turn, k)
            out.append(pd.DataFrame({"query": some["rep"].to_numpy()[qi], "rep": reps[ei], "least": least[ei], "score": cos}))
        return pd.concat(out)

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(search, "query long, rep long, least long, score double")


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = K,
    lists: int | None = None,
    probe_percent: int | None = None,
    target: float = TARGET,
    sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows nearest by cosine of each row where ``is_query`` holds.

    Every row but the query's own is a candidate; ties go to the smaller id; with fewer than k candidates all come.
    Vectors that are null, zero, of another than the most common dimension, or that hold null or non-finite components
    take no part, neither do rows with a null id. Repeated rows (equal id and vector) count once. Other columns are
    only read by ``is_query``. Scores are exact; which candidates are found is approximate, though equal vectors are
    found together. ``probe_percent`` of the lists are probed, or as many as bring the recall to ``target`` on the sample
    (about ``sample`` vectors, chosen by a hash). An empty table gives an empty result.
    """
    empty = "query_id long, rank int, vec_id long, score double"
    dims = vectors.filter(F.size(f"`{vector_col}`") > 0).groupBy(F.size(f"`{vector_col}`").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim, vec = int(dims[0]), F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.cast("array<float>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vec"), dim))
    rows = rows.withColumn("va", F.xxhash64("vec")).withColumn("vb", F.xxhash64(F.lit(1), F.reverse("vec")))
    keyed = written(rows.groupBy("id", "va", "vb").agg(F.max("asks").alias("asks")), "ann-keys")
    entries = _smallest(keyed.select("id", "va", "vb"), k + 1).withColumn("rep", F.element_at("ids", 1))
    asked = keyed.filter("asks").select("va", "vb").distinct().withColumn("asked", F.lit(True))
    entries = entries.join(asked, ["va", "vb"], "left")
    own = rows.select(F.col("id").alias("_id"), F.col("va").alias("_a"), F.col("vb").alias("_b"), "vec")
    entries = entries.join(own, (F.col("rep") == F.col("_id")) & (F.col("va") == F.col("_a")) & (F.col("vb") == F.col("_b")))
    # An id with several vectors stays apart by its vector's key: rep is made unique here.
    entries = entries.dropDuplicates(["va", "vb"]).select(F.col("va").alias("rep"), "vb", "ids", "asked", "vec")
    entries = written(entries, "ann-entries")
    n = entries.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], empty)
    share = entries if n <= sample else entries.filter(F.pmod(F.xxhash64("rep", "vb"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    fitted = _unit([r[0] for r in share.select("vec").orderBy("rep", "vb").collect()])  # about SAMPLE vectors at most
    count = min(lists or max(1, int(np.sqrt(n))), MAX_LISTS, len(fitted))
    centroids = kmeans(fitted, count)
    share_of_lists = probe_percent / 100 if probe_percent else probes_needed(fitted, centroids, k, target)
    probes = min(count, max(MIN_PROBES, int(np.ceil(count * share_of_lists))))

    entries = entries.withColumn("least", F.element_at("ids", 1))
    dealt = written(_lists(entries, centroids), "ann-lists")
    base, pieces = _shards({int(r[0]): int(r[1]) for r in dealt.groupBy("list").count().collect()}, count)  # at most MAX_LISTS rows
    where = vectors.sparkSession.createDataFrame([(i, int(base[i]), int(pieces[i])) for i in range(count)], "list int, base long, pieces int")
    dealt = dealt.join(F.broadcast(where), "list").withColumn("shard", F.col("base") + F.pmod(F.xxhash64("rep"), F.col("pieces"))).drop("base", "pieces")
    turn, asked_for = rotation(dim), entries.filter("asked").select("rep", "vec")
    found = None
    for start, stop in ((0, 1), (1, probes)):
        if start < stop:
            asking = asked_for.withColumn("bound", F.lit(None).cast("double"))
            if found is not None:
                known = found.groupBy("query").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
                asking = asked_for.join(known.hint("merge"), F.col("rep") == F.col("query"), "left")
                asking = asking.withColumn("bound", F.when(F.col("_n") > k, 2.0 - 2.0 * F.col("_least") + 1e-9))
            asking = written(_probing(asking, centroids, base, pieces, start, stop), "ann-queries")
            more = _found(dealt, asking, turn, k + 1)
            if found is None:  # a list in several shards gives a query several times k + 1 rows
                w = Window.partitionBy("query").orderBy(F.desc("score"), "least")
                found = written(more.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).drop("_r"), "ann-nearest")
            else:
                found = found.union(more)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    near = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).drop("least")
    near = near.join(entries.select(F.col("rep").alias("_rep"), "ids").hint("merge"), F.col("rep") == F.col("_rep"))
    best = near.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    asks = keyed.filter("asks").select(F.col("id").alias("query_id"), F.col("va").alias("_q"))
    each = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("far"), i.alias("vec_id")))))
    each = F.slice(F.array_sort(F.filter(each, lambda x: x["vec_id"] != F.col("query_id"))), 1, k)
    met = asks.join(best, F.col("_q") == F.col("query"))
    out = met.select("query_id", F.posexplode(each).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op3_ann_search(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
