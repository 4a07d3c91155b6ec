"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The machine has a weight and a short vector for each feature; each two features of a document interact by the product of
their vectors. The sum over all pairs is half of (square of the sum - sum of the squares), so a document is scored in
time linear in its features. Statistics enter as bins, so that a weight or an interaction can hold for a range of values.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import written

TRAINING_ROWS = 20_000  #: labelled documents that the machine is fitted on, about; chosen by a hash of the id
WORDS = 1 << 13  #: hashed words
FACTORS = 8
EPOCHS = 16
BATCH = 256
STEP = 0.1
RIDGE = 1e-6
THRESHOLD = 0.7
WINDOW = 8

#: Bins of a share: none, below 0.2 %, and so on in steps that grow evenly, up to all.
SHARES = np.concatenate([[1e-9], np.geomspace(0.002, 0.999, 20)])
#: Bins of a count or length: powers of the square root of two.
SIZES = 2 ** (np.arange(44) / 2)
STATISTICS = {
    "words": SIZES, "word_chars": SIZES, "lines": SIZES, "line_words": SIZES, "longest_line": SIZES, "symbols": SHARES, "capitals": SHARES, "capital_words": SHARES, "digits": SHARES,
    "punctuation": SHARES, "bars": SHARES, "exclamations": SHARES, "beyond_ascii": SHARES, "tags": SHARES, "repeated_lines": SHARES, "distinct_words": SHARES, "top_word": SHARES, "doubled_words": SHARES,
    "repeated_windows": SHARES, "stated_chars": SIZES, "stated_ratio": SIZES,
}
BINS = 48  #: places kept for each statistic
SIZE = WORDS + BINS * len(STATISTICS)

_CLASS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {"symbols": b"#*$%&|<>", "punctuation": b".,;:?!'\"()-", "bars": b"|", "exclamations": b"!", "digits": b"0123456789", "tags": b"<>", "capitals": bytes(range(65, 91)), "letters": bytes([*range(65, 91), *range(97, 123)])}.items()}


def _repeated(h: np.ndarray) -> float:
    """Share of the words that lie in a window of eight words found twice or more."""
    if len(h) < WINDOW + 1:
        return 0.0
    sums = np.zeros(len(h) - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(sums)]
    _, back, n = np.unique(sums, return_inverse=True, return_counts=True)
    marks = np.zeros(len(h) + 1, np.int64)
    twice = np.flatnonzero(n[back] > 1)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + WINDOW, -1)
    return float((np.cumsum(marks)[:-1] > 0).mean())


def statistics(text: str, words: list[str], counts: Counter, hashes: np.ndarray, stated: float) -> dict[str, float]:
    """The structure statistics of a whole text, and what its stated length says."""
    data = np.bincount(np.frombuffer(text.encode(errors="replace"), np.uint8), minlength=256)
    total, n = max(1, int(data.sum())), max(1, len(words))
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    of = lambda name: float(data[_CLASS[name]].sum())
    return {
        "words": len(words), "word_chars": len(text) / n, "lines": len(lines), "line_words": n / max(1, len(lines)), "longest_line": max(map(len, lines), default=0),
        "symbols": of("symbols") / total, "capitals": of("capitals") / max(1.0, of("letters")), "capital_words": sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n, "digits": of("digits") / total,
        "punctuation": of("punctuation") / total, "bars": of("bars") / total, "exclamations": of("exclamations") / total, "beyond_ascii": float(data[128:].sum()) / total, "tags": of("tags") / total,
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "distinct_words": len(counts) / n, "top_word": max(counts.values(), default=0) / n, "doubled_words": float((hashes[1:] == hashes[:-1]).sum()) / n,
        "repeated_windows": _repeated(hashes), "stated_chars": stated if stated == stated else 0, "stated_ratio": 16 * stated / max(1, len(text)) if stated == stated else 0,
    }


def features(text: str | None, stated: float, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a document's features: words with damped counts, of length one together, and a bin a statistic."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    own = {w: cache[w] if w in cache else cache.setdefault(w, zlib.crc32(w.lower().encode(errors="replace"))) for w in counts}
    hashes = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
    sums = np.bincount(np.fromiter((h % WORDS for h in own.values()), np.int64, len(own)), weights=np.fromiter(counts.values(), float, len(own)), minlength=WORDS)
    at = np.flatnonzero(sums)
    values = 1 + np.log(sums[at])
    values /= max(1e-9, np.sqrt((values**2).sum()))
    stats = statistics(text, words, counts, hashes, stated)
    bins = [WORDS + k * BINS + int(np.searchsorted(edges, stats[name], side="right")) for k, (name, edges) in enumerate(STATISTICS.items())]
    return np.concatenate([at, bins]).astype(np.int32), np.concatenate([values, np.ones(len(bins))])


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: id, text, stated, label -> id, places and values as bytes, label."""
    cache: dict[str, int] = {}
    for pdf in batches:
        found = [features(t, s, cache) for t, s in zip(pdf["text"], pdf["stated"], strict=True)]
        yield pd.DataFrame({"id": pdf["id"], "places": [p.astype(np.uint16).tobytes() for p, _ in found], "values": [v.astype(np.float32).tobytes() for _, v in found], "label": pdf["label"]})


def _descend(places: np.ndarray, values: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int) -> Machine:
    """The machine of documents whose features lie one after another, from ``starts`` on: AdaGrad over small batches.

    Each pass sees the documents in an order drawn with a fixed seed, so a fit repeats.
    """
    draw = np.random.default_rng(1)
    table = np.concatenate([np.zeros((SIZE, 1)), draw.normal(0, 0.05, (SIZE, FACTORS))], axis=1)
    seen, share = np.full(table.shape, 1e-3), float(np.clip(y.mean(), 0.01, 0.99))
    bias, bias_seen = float(np.log(share / (1 - share))), 1e-3
    ends = np.append(starts[1:], len(places))
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for first in range(0, len(y), BATCH):
            docs = order[first : first + BATCH]
            sizes = ends[docs] - starts[docs]
            cuts = np.cumsum(sizes) - sizes
            own = np.repeat(starts[docs] - cuts, sizes) + np.arange(sizes.sum())
            at, x = places[own].astype(np.int64), values[own].astype(np.float64)[:, None]
            rows = table[at]
            vx = rows[:, 1:] * x
            sums = np.add.reduceat(vx, cuts)
            z = bias + np.add.reduceat(rows[:, 0] * x[:, 0], cuts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, cuts)).sum(axis=1)
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) / len(docs)
            each = np.repeat(off, sizes)[:, None]
            slope = np.concatenate([each * x, each * x * (np.repeat(sums, sizes, axis=0) - vx)], axis=1)
            sort = np.argsort(at, kind="stable")
            named, heads = np.unique(at[sort], return_index=True)
            slope = np.add.reduceat(slope[sort], heads) + RIDGE * table[named]
            seen[named] += slope**2
            table[named] -= STEP * slope / np.sqrt(seen[named])
            g = float(off.sum())
            bias_seen += g * g
            bias -= STEP * g / bias_seen**0.5
    return Machine(bias, table[:, 0].copy(), table[:, 1:].copy())


@dataclass
class Machine:
    """A fitted machine; by default one that knows nothing."""

    intercept: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, FACTORS)))

    def raw(self, places: np.ndarray, values: np.ndarray) -> float:
        """Log odds of one document."""
        v = self.factors[places] * values[:, None]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return self.intercept + float(self.linear[places] @ values) + pairs


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stated: Column, label_col: str, most: int) -> DataFrame:
    """id, text, stated, label of about ``most`` labelled documents, by a hash of the id; only their ids are broadcast.

    An id with several labels has the largest; null ids and other labels than 0 and 1 are ignored.
    """
    usable = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("label")).filter("label IN (0, 1) AND _id IS NOT NULL")
    usable = written(usable.groupBy("_id").agg(F.max("label").alias("label")), "quality-labels")
    n = usable.count()
    if n > most:
        usable = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"), stated.alias("stated")).join(F.broadcast(usable), "_id").withColumnRenamed("_id", "id")


def _stated(docs: DataFrame, stated_col: str | None) -> Column:
    return F.lit(None).cast("double") if stated_col is None or stated_col not in docs.columns else F.col(f"`{stated_col}`").cast("double")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", stated_col: str | None = "n_chars", most: int = TRAINING_ROWS, epochs: int = EPOCHS) -> Machine:
    """The machine of labelled documents. Features are made on the executors; the fit is one of the driver's.

    The driver holds six bytes a feature of the sample, and a document has ``SIZE`` features at most, mostly some
    hundreds: ``most`` is the bound. With examples of one label alone, or of none, the machine is constant: the log odds
    of the labels, each counted once more.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = _sample(docs, labels, id_col, text_col, _stated(docs, stated_col), label_col, most)
    rows = written(rows.mapInPandas(_featured, f"id {kind}, places binary, values binary, label double"), "quality-training")
    found = rows.toPandas().sort_values(["id", "label", "places"], kind="stable")
    y = found["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Machine(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    sizes = found["places"].map(len).to_numpy() // 2
    return _descend(np.frombuffer(b"".join(found["places"]), np.uint16), np.frombuffer(b"".join(found["values"]), np.float32), np.cumsum(sizes) - sizes, y, epochs)


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", stated_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """id, score (0 to 1, to twelve places) and predicted (1 from ``threshold`` on): a row for each row of ``docs``.

    Whole texts are read. Null texts count as empty and have a score like any other; a null or absent stated length has a
    bin of its own; repeated rows score alike; other columns are not read; an empty table gives an empty result. There
    is no shuffle, and the machine that travels with the tasks has a fixed size.
    """
    kind = dict(docs.dtypes)[id_col]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for pdf in batches:
            z = np.array([machine.raw(*features(t, s, cache)) for t, s in zip(pdf["text"], pdf["stated"], strict=True)], float)
            if len(cache) > 500_000:
                cache.clear()
            s = np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 12)
            yield pd.DataFrame({"id": pdf["id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), _stated(docs, stated_col).alias("stated"))
    return source.mapInPandas(scored, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def op11_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
