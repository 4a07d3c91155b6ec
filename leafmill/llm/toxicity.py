"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, strips marks, maps look-alike letters and digit substitutions to one letter, drops invisible
characters and turns everything else into spaces. A term is a whole word or the beginning of a word. Terms and weights
(log odds of a document's having the term) are learned from labelled documents, and so is the logistic curve from a
document's matched weight, plain and by length, to a score. Inside an exception phrase nothing counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import written

TRAINING_ROWS = 20_000  #: labelled documents that the lexicon is learned from, about; chosen by a hash of the id
TERMS = 3_000
MIN_TOXIC_DOCS = 4
MIN_LOG_ODDS = 2.5
PREFIXES = range(3, 9)
THRESHOLD = 0.7

#: Harmless phrases that contain terms.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "sore loser")
#: Letters of other scripts that look like Latin ones, and digits and signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ꞓ": "c", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e",
}


def _folding() -> dict[int, str | None]:
    """Code point -> its folded string: by compatibility decomposition where that ends in a Latin letter."""
    table: dict[int, str | None] = {}
    for block in (range(0x20, 0x250), range(0x370, 0x530), range(0x1E00, 0x1F00), range(0x2100, 0x2190), range(0x2460, 0x2500), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800)):
        for c in block:
            base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x))
            base = "".join(LOOKALIKES.get(x, x) for x in base)
            table[c] = "".join(x if x.isalpha() else " " for x in base) or " "
    for c in (*range(0x00, 0x20), 0x7F):
        table[c] = " "
    for c in (0x00AD, 0x034F, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, *range(0x0300, 0x0370), *range(0xFE00, 0xFE10)):
        table[c] = None
    for a, b in LOOKALIKES.items():
        table[ord(a)] = table[ord(a.upper()) if len(a.upper()) == 1 else ord(a)] = b
    # l, i and 1 are written for one another.
    return {c: (s.replace("l", "i") if s else s) for c, s in table.items()}


_TABLE = _folding()


def fold(text: str | None) -> str:
    """Folded words with single or multiple spaces between them and one at either end at least."""
    return " " + (text or "").translate(_TABLE) + " "


def terms_of(folded: str) -> set[str]:
    """The terms that a text has: `` word `` for whole words and `` beg`` for beginnings."""
    out = set()
    for w in set(folded.split()):
        if len(w) < 40:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in PREFIXES if n < len(w))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, w in self.weights.items():
            found.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            folded = re.sub(" +", " ", fold(phrase))
            found.add_word(folded, (len(folded), None))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def score(self, sums: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        z = features(sums, n_words) @ np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(sums: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Constant, matched weight, and matched weight by length (a root, as long texts have more chance matches)."""
    return np.stack([np.ones(len(sums)), np.log1p(sums), np.log1p(sums / np.sqrt(1 + n_words))], axis=1)


def matched(automaton, folded: str) -> float:
    """Sum of the weights of matched words: of a word's terms the heaviest, nothing inside an exception phrase."""
    best: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w is None:
            free.append((start, end))
        elif w > best.get(start, 0.0):
            best[start] = w
    if free:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in free)}
    return sum(best.values())


def _matches(lexicon: Lexicon):
    """mapInPandas function: doc_id, text, ... -> the other columns, n_words, matched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for pdf in batches:
            words, sums = [], []
            for text in pdf["text"]:
                folded = fold(text)
                words.append(folded.count(" "))
                sums.append(matched(automaton, folded) if automaton else 0.0)
            yield pdf.drop(columns="text").assign(n_words=np.array(words, float), matched=np.array(sums, float))

    return run


def _counts(wanted: frozenset[str] | None):
    """mapInPandas function: text, toxic -> term, toxic, n; only the wanted terms, or all of toxic documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter = Counter()
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                terms = terms_of(fold(text))
                found.update((t, int(toxic)) for t in (terms if wanted is None else terms & wanted))
            yield pd.DataFrame([(t, x, n) for (t, x), n in found.items()], columns=["term", "toxic", "n"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + ridge * b
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """text and toxic of about ``most`` labelled documents at most, by a hash of the id; only their ids are broadcast."""
    usable = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND _id IS NOT NULL")
    usable = usable.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    if n > most:
        usable = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return docs.join(F.broadcast(usable), F.col(f"`{id_col}`") == F.col("_id")).select(F.col(f"`{text_col}`").alias("text"), "toxic")


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAINING_ROWS, terms: int = TERMS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon of labelled documents. Without toxic or without clean examples it is empty and every score near 0.

    The sample, the number of terms and so what reaches the driver are bounded by ``most`` and ``terms``.
    """
    rows = written(training_rows(docs, labels, id_col, text_col, label_col, most), "toxicity-training")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon(exceptions=exceptions)
    schema = "term string, toxic int, n long"
    common = rows.filter("toxic = 1").mapInPandas(_counts(None), schema).groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_TOXIC_DOCS)
    wanted = {r.term: r.n for r in common.orderBy(F.desc("n"), "term").limit(20 * terms).collect()}
    clean = rows.filter("toxic = 0").mapInPandas(_counts(frozenset(wanted)), schema).groupBy("term").agg(F.sum("n").alias("n"))
    against = {r.term: r.n for r in clean.collect()}
    odds = {t: math.log((n + 0.5) / (n_toxic + 1)) - math.log((against.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in wanted.items()}
    best = sorted((t for t, w in odds.items() if w >= MIN_LOG_ODDS), key=lambda t: (-wanted[t] * odds[t], t))[:terms]
    lexicon = Lexicon({t: round(odds[t], 6) for t in best}, exceptions=exceptions)
    seen = rows.select("text", F.col("toxic").cast("double").alias("toxic")).mapInPandas(_matches(lexicon), "toxic double, n_words double, matched double").toPandas()
    seen = seen.sort_values(["toxic", "n_words", "matched"])
    x = features(seen["matched"].to_numpy(), seen["n_words"].to_numpy())
    lexicon.coefficients = tuple(float(b) for b in _logistic(x, seen["toxic"].to_numpy()))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score (0 to 1) and predicted (1 from ``threshold`` on): one row a row of ``docs``, whole texts.

    Null and empty texts match nothing and get the score of a text without matches. Repeated rows score alike; other
    columns are not read; an empty table gives an empty result. There is no shuffle.
    """
    kind = dict(docs.dtypes)[id_col]
    run = _matches(lexicon)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in run(batches):
            s = lexicon.score(pdf["matched"].to_numpy(), pdf["n_words"].to_numpy())
            yield pd.DataFrame({"id": pdf["id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInPandas(scored, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
