"""Removal of byte strings that occur more than once in the corpus: a filter, then a difference-cover suffix sort.

A difference cover over every byte would sort two thirds of all positions (see the README for figures), so positions
that can't repeat are ruled out first, and text that is shared for certain is shortened to one symbol:

1. Filter. Each window of ``length`` bytes chooses its gram of ``GRAM`` bytes with the smallest hash. A gram that occurs
   once rules out all windows that chose it. Consecutive windows that chose one occurrence of a gram are a context;
   occurrences of one context repeat throughout. Where a gram has several contexts, each is cut into bins of at most
   ``WIDTH`` windows. The bytes that all windows of a bin have in common are its core; equal windows have equal cores,
   so a core that occurs in one bin only rules its windows out, and occurrences of one bin repeat throughout.
2. What remains are strings: bytes left of a core, the core as one symbol, bytes right of it. A window is ``WIDTH`` = 9
   consecutive symbols. They are sorted by the difference-cover algorithm: triples at the positions 1 and 2 modulo 3 are
   sorted and named by rank (``_named``); names recurse, so triples of names rank the sampled suffixes by 9 symbols; the
   remaining suffixes are merged by their first symbols and the rank of the next sampled suffix (``_before``).
3. Adjacent suffixes are compared by their prefixes of 9 symbols; equal ones repeat.

All steps are Spark sorts, aggregations and joins over rows; the merge splits the order at a bounded sample of suffixes,
so that a task holds about ``PART`` of them, however many are equal.

Grams have 64-bit names, which only filter. What decides is a 64-bit name of a context among the contexts of one gram, a
128-bit name of a core, and bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from leafmill.llm._shared import hot_join, written
from leafmill.llm.minhash_dedup import _groups, _mix

LENGTH = 200
GRAM = 64
WIDTH = 9  #: windows in a bin and symbols in a window: three triples of three
SLICE = 2 << 20  #: bytes of text that are hashed at a time
PART = 200_000  #: suffixes that one task merges, about
MAX_PARTS = 20_000  #: and the number of such tasks at most; the order is split at as many suffixes
SAMPLE_PER_PART = 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


class _Powers:
    """Powers of the hash's base and of its inverse, grown to the longest slice seen."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[_U(1), np.full(n, _U(_BASE))])
            self.down = np.cumprod(np.r_[_U(1), np.full(n, _U(_BACK))])


_POWERS = _Powers()


def prefix_sums(b: np.ndarray) -> np.ndarray:
    _POWERS.reach(len(b) + 1)
    out = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * _POWERS.up[: len(b)], out=out[1:])
    return out


def names(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of the byte strings [start, end): equal strings have equal names."""
    return _mix((sums[end] - sums[start]) * _POWERS.down[start] + (end - start).astype(_U))


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h)
    grid = np.full(-(-n // w) * w, ~_U(0))
    grid[:n] = h
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram name, context name, start, windows) of each run of consecutive windows that choose one gram.

    Long texts are taken in slices, which may cut a run in two: windows choose alike all the same.
    """
    if len(b) < length:
        none = np.empty(0, np.int64)
        return none.astype(_U), none.astype(_U), none, none
    if len(b) > SLICE + length:
        parts = [(at, runs(b[at : at + SLICE + length - 1], length, gram)) for at in range(0, len(b) - length + 1, SLICE)]
        return tuple(np.concatenate([p[j] + at if j == 2 else p[j] for at, p in parts]) for j in range(4))
    sums = prefix_sums(b)
    at = np.arange(len(b) - gram + 1)
    grams = names(sums, at, at + gram)
    chosen = _window_minima(grams, length - gram + 1)
    # A window chooses its leftmost smallest gram: a run also ends where that gram starts the window, as another with the
    # same name may follow in periodic text.
    start = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (grams[: len(chosen) - 1] == chosen[:-1])])
    end = np.r_[start[1:], len(chosen)]
    return chosen[start], names(sums, start, end - 1 + length), start, end - start


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _all_runs(length: int, gram: int, only_grams: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [(k, *runs(_bytes(t), length, gram)) for k, t in zip(pdf["key"], pdf["text"], strict=True)]
            g = np.concatenate([p[1] for p in parts] or [np.empty(0, _U)]).view(np.int64)
            if only_grams:
                yield pd.DataFrame({"gram": g})
                continue
            yield pd.DataFrame(
                {
                    "gram": g,
                    "ctx": np.concatenate([p[2] for p in parts] or [np.empty(0, _U)]).view(np.int64),
                    "key": np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts]),
                    "start": np.concatenate([p[3] for p in parts] or [np.empty(0)]).astype(np.int32),
                    "windows": np.concatenate([p[4] for p in parts] or [np.empty(0)]).astype(np.int32),
                }
            )

    return run


# ------------------------------------------------------------------------------------------------ bins


def bins(raw: bytes, gram_names: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int, gram: int, width: int = WIDTH) -> Iterator[tuple]:
    """(context's index, core name, left bytes, right bytes, windows, first window) of each bin of some contexts of a text.

    A window's place is the number of bytes before its gram; a bin holds ``width`` consecutive places. Its core is what
    the windows of all these places hold: ``length - width + 1`` bytes.
    """
    size = windows - 1 + length
    for some in np.split(np.arange(len(start)), np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1):
        ends = np.cumsum(size[some])
        base = ends - size[some]
        b = np.frombuffer(b"".join(raw[start[i] : start[i] + size[i]] for i in some), np.uint8)
        at = np.arange(len(b) - gram + 1)
        owner = np.searchsorted(ends, at, "right")
        inside = (at + gram <= ends[owner]) & (at - base[owner] <= length - gram)
        met = np.flatnonzero(inside & (names(prefix_sums(b), at, at + gram).view(np.int64) == gram_names[some][owner]))
        which, first = np.unique(owner[met], return_index=True)
        place = np.empty(len(some), np.int64)
        place[which] = met[first] - base[which] + start[some][which]
        for q in range(-(-(length - gram + 1) // width)):
            low = place - q * width
            lo, hi = np.maximum(start[some], low - width + 1), np.minimum(start[some] + windows[some] - 1, low)
            for j in np.flatnonzero(lo <= hi):
                core, a, z = int(low[j]), int(lo[j]), int(hi[j])
                end = core + length - width + 1
                yield int(some[j]), xxh3_128_digest(raw[core:end]), raw[a:core], raw[end : z + length], z - a + 1, a


BINS = "core binary, left binary, right binary, windows int, key long, first int, times long"


def _cut(length: int, gram: int):
    """Texts with the contexts wanted of them -> their bins."""
    kinds = pa.schema([("core", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("windows", pa.int32()), ("key", pa.int64()), ("first", pa.int32()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, wanted in zip(batch["key"].to_pylist(), batch["text"], batch["wanted"], strict=True):
                gram_names, start, windows, times = (wanted.values.field(name).to_numpy() for name in ("gram", "start", "windows", "times"))
                raw, times = text.as_buffer().to_pybytes(), times.tolist()
                for i, core, left, right, n, first in bins(raw, gram_names, start.astype(np.int64), windows.astype(np.int64), length, gram):
                    out.append((core, left, right, n, key, first, times[i]))
                    if len(out) >= 100_000:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], kinds)
                        out = []
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], kinds)

    return run


# ------------------------------------------------------------------------------------------------ difference cover


def _symbols(core: int, left: bytes, right: bytes) -> list[int]:
    """A string's symbols: bytes, its core as 256 plus the core's number, and -1 beyond the end."""
    return [*left, 256 + core, *right, -1, -1]


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings -> the triples of symbols at the positions 1 and 2 modulo 3."""
    for pdf in batches:
        out = []
        for key, core, left, right in zip(pdf["id"].tolist(), pdf["core_id"].tolist(), pdf["left"], pdf["right"], strict=True):
            s = _symbols(core, left, right)
            out += [(key, i, s[i], s[i + 1], s[i + 2]) for i in range(1, len(s) - 2) if i % 3]
        yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 5), columns=["id", "i", "x0", "x1", "x2"]).astype({"i": np.int32})


def _named(triples: DataFrame, name: str) -> DataFrame:
    """(id, i, name) of triples (id, i, x0, x1, x2): names are in the order of the triples, equal for equal ones."""
    keys = ["x0", "x1", "x2"]
    order = triples.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys).withColumn("name", F.monotonically_increasing_id())
    return hot_join(triples, written(order, name), keys, ["id", "i"]).select("id", "i", "name")


def _by_string(named: DataFrame) -> DataFrame:
    """(id, ranks): a map from position to name for each string; a string has fewer than twice ``WIDTH`` symbols."""
    return named.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "name"))).alias("ranks"))


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings with the ranks of their sampled suffixes -> a row a window, with what the merge compares."""
    columns = ["id", "t", "kind", "x0", "x1", "r0", "r1", "r2"]
    for pdf in batches:
        out: list[tuple] = []
        prefixes: list[bytes] = []
        for key, core, left, right, windows, ranks in zip(pdf["id"].tolist(), pdf["core_id"].tolist(), pdf["left"], pdf["right"], pdf["windows"].tolist(), pdf["ranks"], strict=True):
            s, rank, before = _symbols(core, left, right), dict(ranks), len(left)
            tag = core.to_bytes(8, "big")
            for t in range(windows):
                prefixes.append(tag + bytes([before - t]) + left[t:] + right[: t + WIDTH - 1 - before])
                out.append((key, t, t % 3, s[t], s[t + 1], rank.get(t, -1), rank.get(t + 1, -1), rank.get(t + 2, -1)))
        yield pd.DataFrame(np.array(out, np.int64).reshape(-1, len(columns)), columns=columns).astype({"t": np.int32, "kind": np.int32}).assign(prefix=prefixes)


#: What orders two suffixes, by their positions modulo 3: a rank where both have it, else symbols and the rank behind them.
_COMPARED = {(0, 0): ("x0", "r1"), (0, 1): ("x0", "r1"), (0, 2): ("x0", "x1", "r2"), (1, 1): ("r0",), (1, 2): ("r0",), (2, 2): ("r0",)}


def _before(some: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
    """For each of ``rows`` the number of ``some`` that sort before it."""
    out = np.zeros(len(rows), np.int64)
    theirs, ours = some["kind"].to_numpy(), rows["kind"].to_numpy()
    for a in range(3):
        for b in range(3):
            left, right = np.flatnonzero(theirs == a), np.flatnonzero(ours == b)
            if len(left) and len(right):
                cols = _COMPARED[min(a, b), max(a, b)]
                keys = [np.r_[some[c].to_numpy()[left], rows[c].to_numpy()[right]] for c in cols]
                # Own rows come first among equal ones, so that only smaller ones count.
                theirs_too = np.r_[np.ones(len(left), np.int8), np.zeros(len(right), np.int8)]
                order = np.lexsort([theirs_too, *keys[::-1]])
                count = np.empty(len(order), np.int64)
                count[order] = np.cumsum(theirs_too[order])
                out[right] += count[len(left) :]
    return out


def _dealt(splits: pd.DataFrame):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["part"] = _before(splits, pdf).astype(np.int32)
            yield pdf

    return run


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suffixes by part -> those whose prefix equals a neighbour's (edge 0), and each part's first and last (edge 1, 2)."""
    for g in _groups(batches, "part"):
        # Other ranks may split what is equal in 9 symbols; the parts' order and this one agree in them.
        g = g.iloc[np.argsort(_before(g, g), kind="stable")]
        prefix = g["prefix"].to_numpy()
        same = prefix[1:] == prefix[:-1]
        hit = np.r_[same, False] | np.r_[False, same]
        out = [g[hit].assign(edge=0), g.iloc[:1].assign(edge=1), g.iloc[-1:].assign(edge=2)]
        yield pd.concat(out)[["id", "t", "part", "edge", "prefix"]]


def repeated_windows(strings: DataFrame) -> DataFrame:
    """(id, t) of the windows of ``strings`` that equal another: strings have id, core_id, left, right, windows."""
    spark = strings.sparkSession
    triples = written(strings.mapInPandas(_sampled, "id long, i int, x0 long, x1 long, x2 long"), "suffix-triples")
    ranks = _by_string(_named(triples, "suffix-names"))
    behind = lambda k: F.coalesce(F.element_at("ranks", F.col("i") + k), F.lit(-1))
    again = ranks.select("id", "ranks", F.explode(F.map_keys("ranks")).alias("i")).select("id", "i", behind(0).alias("x0"), behind(3).alias("x1"), behind(6).alias("x2"))
    ranks = _by_string(_named(written(again, "suffix-triples"), "suffix-names"))
    # A string of one symbol has no sampled position.
    met = strings.join(ranks.hint("merge"), "id", "left").withColumn("ranks", F.coalesce("ranks", F.expr("cast(map() as map<int, bigint>)")))
    fields = "id long, t int, kind int, x0 long, x1 long, r0 long, r1 long, r2 long"
    suffixes = written(met.mapInPandas(_suffixes, f"{fields}, prefix binary"), "suffix-windows")
    n = suffixes.count()
    parts = min(MAX_PARTS, 1 + n // PART)
    splits = pd.DataFrame(columns=["kind", "x0", "x1", "r0", "r1", "r2"], dtype=np.int64)
    if parts > 1:
        share = int(1_000_000 * min(1.0, SAMPLE_PER_PART * parts / n)) + 1
        some = suffixes.filter(F.pmod(F.xxhash64("id", "t"), F.lit(1_000_000)) < share).select(*splits.columns).toPandas()  # about SAMPLE_PER_PART a part
        some = some.iloc[np.argsort(_before(some, some), kind="stable")]
        splits = some.iloc[np.unique(np.linspace(0, len(some) - 1, parts + 1).astype(int)[1:-1])] if len(some) else splits
    dealt = suffixes.mapInPandas(_dealt(splits), f"{fields}, prefix binary, part int")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part")
    merged = written(dealt.mapInPandas(_merge, "id long, t int, part int, edge int, prefix binary"), "suffix-merged")
    edges = sorted((r.part, r.edge, r.prefix, r.id, r.t) for r in merged.filter("edge > 0").collect())  # two a part
    border = [(x.pop(), x.pop()) for a, b in zip(edges, edges[1:], strict=False) if a[0] != b[0] and a[2] == b[2] for x in ([a[4], a[3]], [b[4], b[3]])]
    return merged.filter("edge = 0").select("id", "t").union(spark.createDataFrame(border, "id long, t int"))


# ------------------------------------------------------------------------------------------------ removal


def _covered(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes that the windows [first, last] cover."""
    if spans is None or not len(spans):
        return []
    first = np.array([s["first"] for s in spans], np.int64)
    last = np.array([s["last"] for s in spans], np.int64) + length
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
    return list(zip(first[new].tolist(), end[np.r_[new[1:] - 1, len(end) - 1]].tolist(), strict=True))


def _remove(length: int):
    """Texts with the windows [first, last] that repeat -> the result columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, repeats in zip(pdf["id"], pdf["text"], pdf["repeats"], strict=True):
                b, gone = (text or "").encode("utf-8", "surrogatepass"), _covered(repeats, length)
                starts = [0, *(z for _, z in gone)]
                kept = b"".join(b[a:z] for a, z in zip(starts, [*(a for a, _ in gone), len(b)], strict=True))
                out.append((key, len(b), len(b) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return run


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, repeats) of rows (key, text) that hold a repeated string: repeats is a set of windows [first, last]."""
    grams = docs.mapInPandas(_all_runs(length, gram, True), "gram long")
    twice = written(grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-grams")
    every = docs.mapInPandas(_all_runs(length, gram, False), "gram long, ctx long, key long, start int, windows int")
    again = written(hot_join(every, twice, ["gram"], ["key", "start"], "left_semi"), "suffix-runs")
    # Any occurrence will do; plain columns, unlike a struct, are aggregated by hash.
    contexts = written(again.groupBy("gram", "ctx").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("key", "start", "windows")]), "suffix-contexts")
    whole = contexts.filter("times > 1").select("gram", "ctx", F.col("times").alias("n"))
    spans = hot_join(again, whole, ["gram", "ctx"], ["key", "start"], "left_semi").select("key", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last"))

    several = written(contexts.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-several")
    unlike = hot_join(contexts, several, ["gram"], ["ctx"], "left_semi")
    wanted = unlike.groupBy("key").agg(F.collect_list(F.struct("gram", "start", "windows", "times")).alias("wanted"))
    # Merge joins at every size: what is joined grows with the corpus, so it isn't broadcast where it happens to be small.
    cut = docs.join(wanted.hint("merge"), "key").select("key", "text", "wanted")
    pieces = written(cut.mapInArrow(_cut(length, gram), BINS), "suffix-bins")
    same = ["core", "left", "right", "windows"]
    alike = pieces.groupBy(*same).agg(F.sum("times").alias("times"), F.count("*").alias("n"), F.first("key").alias("key"), F.first("first").alias("first"))
    alike = written(alike, "suffix-alike")
    repeated = hot_join(pieces.filter("times = 1"), alike.filter("times > 1").select(*same, "n"), same, ["key", "first"], "left_semi")
    spans = spans.union(repeated.select("key", "first", F.col("first") + F.col("windows") - 1))

    cores = alike.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").withColumn("core_id", F.monotonically_increasing_id())
    strings = hot_join(alike, written(cores, "suffix-cores"), ["core"], ["left", "right"])
    strings = written(strings.select(F.monotonically_increasing_id().alias("id"), "core_id", "left", "right", "windows", "times", "key", "first"), "suffix-strings")
    found = repeated_windows(strings.drop("times", "key", "first"))
    single = strings.filter("times = 1").select("id", "key", "first")
    at = single.join(found.hint("merge"), "id").select("key", (F.col("first") + F.col("t")).alias("first"))
    spans = spans.union(at.select("key", "first", F.col("first").alias("last")))
    return spans.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("repeats"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (long), kept_sha256, kept_bytes (binary): one row a row of ``docs``.

    Every byte that a string of ``length`` bytes covers which also starts anywhere else, in the same text or another, is
    removed; texts are judged whole, as UTF-8, on the input. Null and empty texts have no bytes. Rows with a null id are
    texts like others. Repeated rows are different documents, so their strings repeat. Long texts are hashed in slices.
    Other columns are not read. An empty table gives an empty result. ``length`` must be at least ``WIDTH`` and ``gram``.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    spans = repeated_spans(source.select("key", "text"), length=length, gram=gram)
    met = source.join(spans.hint("merge"), "key", "left").select("id", "text", "repeats")
    out = met.mapInPandas(_remove(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return out.withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).drop("kept_bytes")
