"""Best-fit packing of documents into fixed-length sequences by fitted length patterns.

Only the histogram of piece lengths reaches the driver, at most ``capacity`` rows whatever the corpus. There, patterns
of one to three lengths that fill a sequence exactly are enumerated, non-negative least squares finds how often each
should repeat to use up the histogram, the counts are rounded down to what is left, and the residual pieces are packed
best-fit decreasing, still as counts a length. Pieces are then ranked within their length on the executors and look
up their place by rank.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import written

CAPACITY = 1024
END_ID = 2
RANK_ROWS = 100_000  #: pieces ranked together in one group
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------------------------------------- tokens


class Tokenizer:
    """Token ids of a vocabulary file for the `tokenizers` library.

    A byte-level BPE whose merges are in id order is run as ranks in tiktoken, which yields the same ids several times
    faster; any other file, and any text that holds an added token's string, goes through `tokenizers` itself.
    """

    #: Fixed value: the byte-level pre-tokenizer's public split pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Slow

        self.slow = Slow.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._ranks(spec)

    def _ranks(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        odd = spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
        if not plain or odd:
            return None
        vocab, merges = model["vocab"], model["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        first = len(vocab) - len(merges) - sum(c in vocab for c in self.added)
        if any(vocab.get(w) != first + i for i, w in enumerate(joined)):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        try:
            ranks = {bytes(byte_of[c] for c in w): i for w, i in vocab.items() if w not in self.added}
        except KeyError:
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def _cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The token pieces of every document: doc_id, piece, start, length, ids_crc32, and ids when ``with_ids``.

    A document's ids are its text's tokens and then ``end_id``; null and empty texts are ``end_id`` alone. Documents of
    more than ``capacity`` ids are cut, the first piece being the shorter one. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(tokenizer_path)
        for pdf in batches:
            out = []
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = array("I", tok.ids(text or ""))
                ids.append(end_id)
                raw = ids.tobytes()
                for i, (s, n) in enumerate(_cuts(len(ids), capacity)):
                    own = raw[4 * s : 4 * (s + n)]
                    out.append((key, i, s, n, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else ())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInPandas(run, PIECES + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------------------------------------- the plan, on counts


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill a sequence exactly with one to three of these lengths: rows of three, 0 for none, descending."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    rows = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    have[0] = True
    for a in range(1, capacity):
        if not have[a]:
            continue
        b = np.arange((capacity - a + 1) // 2, min(a, capacity - a) + 1)
        c = capacity - a - b
        ok = have[b] & have[c] & (c <= b)
        rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(rows) if rows else np.empty((0, 3), np.int64)


def fit(found: np.ndarray, histogram: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 with the patterns' use of each length nearest to the histogram.

    Accelerated projected gradient steps on the sparse pattern matrix, with restarts; rows are weighted by the inverse
    root of their count, so that rare lengths are fitted as well as common ones.
    """
    h = histogram.astype(float)
    w = 1 / np.sqrt(np.maximum(h, 1))
    w[0] = 0
    flat = found.ravel()

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), len(h))

    def step(r: np.ndarray) -> np.ndarray:
        return (w * w * r)[found].sum(axis=1)

    v = np.ones(len(found))
    for _ in range(30):  # the largest eigenvalue
        u = step(use(v))
        top = float(np.linalg.norm(u))
        v = u / max(top, 1e-30)
    x = np.zeros(len(found))
    y, t, last = x, 1.0, np.inf
    for _ in range(rounds):
        new = np.maximum(0, y - step(use(y) - h) / (1.02 * top))
        miss = float(((w * (use(new) - h)) ** 2).sum())
        if miss > last:
            y, t, last = x, 1.0, np.inf
            continue
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
        if last - miss < 1e-9 * max(1.0, miss) and miss < 1e-6:
            break
        last = miss
    return x


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts a length: [(lengths in a sequence, how many such sequences)]."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    frees: list[int] = []

    def put(free: int, content: tuple[int, ...], n: int) -> None:
        if n:
            if not open_[free]:
                bisect.insort(frees, free)
            open_[free].append((content, n))

    for length in range(len(left) - 1, 0, -1):
        todo = int(left[length])
        while todo:
            at = bisect.bisect_left(frees, length)
            if at == len(frees):
                each = capacity // length
                full, rest = divmod(todo, each)
                put(capacity - each * length, (length,) * each, full)
                put(capacity - rest * length, (length,) * rest, int(rest > 0))
                break
            free = frees[at]
            content, n = open_[free].pop()
            if not open_[free]:
                frees.pop(at)
            each = free // length
            full = min(n, todo // each)
            put(free - each * length, content + (length,) * each, full)
            todo -= full * each
            if full < n:
                some = min(todo, each)
                put(free - some * length, content + (length,) * some, int(some > 0))
                todo -= some
                put(free, content, n - full - int(some > 0))
    return [x for each in open_.values() for x in each]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, how many such sequences)] that use up the histogram (index = length) exactly."""
    counts = histogram.astype(np.int64)
    found = patterns(np.flatnonzero(counts[1:]) + 1, capacity)
    x = fit(found, counts) if len(found) else np.empty(0)
    rounded = [_use_up(found, repeats, counts, capacity) for repeats in (np.rint(x), np.floor(x))]
    return min(rounded, key=lambda out: sum(n for _, n in out))


def _use_up(found: np.ndarray, repeats: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Each pattern as often as fitted and as its lengths last, the residual best-fit decreasing."""
    left = counts.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    for i in np.argsort(-repeats, kind="stable")[: int((repeats > 0).sum())]:
        need = Counter(int(n) for n in found[i] if n)
        n = min(int(repeats[i]), *(int(left[k]) // c for k, c in need.items()))
        if n > 0:
            out.append((tuple(sorted(need.elements(), reverse=True)), n))
            for k, c in need.items():
                left[k] -= c * n
    return out + _best_fit(left, capacity)


def _places(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Intervals of rank within a length, flattened: a piece's sequence is first_sequence + rank - first_rank."""
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    next_rank: Counter = Counter()
    sequence = 0
    for content, n in planned:
        at = 0
        for length in content:
            by[length].append((next_rank[length], sequence, at))
            next_rank[length] += n
            at += length
        sequence += n
    first = np.zeros(capacity + 2, np.int64)
    rows = []
    for length in range(capacity + 1):
        rows += by[length]
        first[length + 1] = len(rows)
    table = np.array(rows, np.int64).reshape(-1, 3)
    return {"first": first, "rank": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


# ---------------------------------------------------------------------------------------------- on the executors


def ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``rank``, from 0 within each length. A common length is dealt into many groups, so none is ranked in one task."""
    groups = max(64, max(histogram.values(), default=0) // RANK_ROWS + 1)
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = before.selectExpr("length AS _l", "_group AS _g", "sum(_n) OVER (PARTITION BY length ORDER BY _group) - _n AS _before")
    own = dealt.selectExpr("*", "row_number() OVER (PARTITION BY length, _group ORDER BY doc_id, piece, ids_crc32) - 1 AS _own")
    met = own.join(before, (F.col("length") == F.col("_l")) & (F.col("_group") == F.col("_g")))
    return met.withColumn("rank", F.col("_before") + F.col("_own")).drop("_group", "_own", "_l", "_g", "_before")


def packed(rows: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with columns doc_id, piece, length (1 to capacity) and ids_crc32.

    ``rows`` is read three times: pass a written table. Sequences are gapless from offset 0 and hold whole pieces.
    Equal rows are different pieces. An empty table gives an empty result. The driver gets one count a length.
    """
    histogram = {int(r[0]): int(r[1]) for r in rows.groupBy("length").agg(F.count("*")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} ids does not fit a sequence of {capacity}")
        counts[length] = n
    # At most three intervals a pattern and one a residual piece type: bounded by the capacity, not by the corpus.
    places = rows.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity), capacity))
    withrank = ranked(rows, histogram)
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = places.value
        # One ascending key for all lengths: the length, then the rank.
        width = int(p["rank"].max(initial=0)) + 1
        keys = np.repeat(np.arange(len(p["first"]) - 1), np.diff(p["first"])) * width + p["rank"]
        for pdf in batches:
            rank = pdf["rank"].to_numpy()
            at = np.searchsorted(keys, pdf["length"].to_numpy() * width + np.minimum(rank, width - 1), "right") - 1
            yield pdf[names].assign(sequence_id=p["sequence"][at] + rank - p["rank"][at], offset=p["offset"][at])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", sequence_id long, offset long"
    return withrank.select(*names, "rank").mapInPandas(run, schema)


def sequences(packed_ids: DataFrame) -> DataFrame:
    """sequence_id and its ids (array of int), from packed pieces made ``with_ids``; a group is one sequence."""
    parts = packed_ids.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.flatten(F.transform("_p", lambda x: x["ids"])).alias("ids"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(written(pieces(docs, vocabulary()), "pieces"))
