"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the common form that each one leads to.

One word of a pair contributes two disjoint chunks that cover it, the other its positional grams. One edit leaves a chunk
whole, and the other word has it at the same place or, behind an inserted character, one place on. What is left of
both words beside that chunk is again one edit apart, so the rule holds once more for the rest: a key is a chunk and a
chunk of the rest, about three quarters of a word. Words that share a key are compared in full.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import written

SHORTEST = 6  #: code points of a word, at least; chunks of chunks need four
LEAST = 5  #: occurrences of a word, at least
RATIO = 5  #: a form is at least so many times as frequent
MISPRINT = 199  #: a run loses a code point where this divides its hash
FLUSH = 200_000  #: distinct words that a task counts before it hands them on; the sums are those of all


def _counted(shortest: int, misprint: int | None):
    """mapInPandas function: id (as text), text -> word, n; a word may come in several rows."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % shortest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in batches:
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                if not text:
                    continue
                # bytes.lower() changes A-Z alone.
                own = Counter(runs.findall(text.encode().lower().decode()))
                if misprint is None:
                    found.update(own)
                    continue
                seed = zlib.crc32(f"{doc or ''}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % misprint == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    found[word] += n
                if len(found) > FLUSH:
                    yield pd.DataFrame(found.items(), columns=["word", "n"])
                    found = Counter()
        if found:
            yield pd.DataFrame(found.items(), columns=["word", "n"])

    return run


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, misprint: int | None = None) -> DataFrame:
    """(word, n): the runs of Latin letters of whole texts, A-Z lower-cased, with ``shortest`` code points and ``least`` occurrences.

    With ``misprint`` a run whose ``crc32("<id>:<run>")`` it divides loses the code point at that hash modulo its length.
    Null texts have no words; a null id is written as an empty string; repeated rows count each time; other columns are
    not read; an empty table gives an empty result. Words are counted within tasks before the shuffle.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counts = source.mapInPandas(_counted(shortest, misprint), "word string, n long")
    return counts.filter(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _keys(word: Column, size: Column) -> Column:
    """The keys that a word shares with words of ``size`` code points, which is its own size or one less.

    For a word of that size they are its chunks, each with the chunks of the rest; for another one they are the grams that
    such chunks can be found at: at the same place, or one on where the chunk ends the word.
    """
    extra = F.length(word) - size
    half = F.floor(size / 2).cast("int")

    def of(side: int, chunk: Column, rest: Column, own: Column) -> list[Column]:
        quarter = F.floor(own / 2).cast("int")
        first, last = rest.substr(F.lit(1), quarter), rest.substr(quarter + 1 + extra, own)
        return [F.struct(size.alias("size"), F.lit(2 * side + n).alias("place"), chunk.alias("chunk"), x.alias("part")) for n, x in enumerate((first, last))]

    start, end = of(0, word.substr(F.lit(1), half), word.substr(half + 1, F.length(word)), size - half), of(1, word.substr(half + 1 + extra, size), word.substr(F.lit(1), half + extra), half)
    return F.array(*start, *end)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each two words that differ by exactly one inserted, deleted or replaced code point, once.

    ``words`` has distinct words of four code points or more and their n; ``a`` is the shorter one, or the smaller of two
    equally long ones. No pair is lost and none is emitted that a full comparison has not confirmed. Null words are
    ignored; an empty table gives an empty result. Hot keys are those of AQE's split of a merge join.
    """
    words = words.filter("word IS NOT NULL")
    size = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_keys(F.col("word"), size)).alias("k"))
    sizes = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).filter("size >= 4")
    grams = sizes.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(_keys(F.col("word"), F.col("size"))).alias("k"))
    flat = lambda df, *own: df.select("k.size", "k.place", "k.chunk", "k.part", *own)
    met = flat(chunks, "a", "a_n").join(flat(grams, "b", "b_n").hint("merge"), ["size", "place", "chunk", "part"])
    near = met.filter((F.length("b") > F.col("size")) | (F.col("a") < F.col("b"))).filter(F.levenshtein("a", "b", 1) == 1)
    return near.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame, name: str = "spelling-roots") -> DataFrame:
    """(word, root): the end of each word's chain of forms; ``forms`` (word, form) has one form a word and no cycle.

    Pointers are doubled, so the rounds grow with the logarithm of the longest chain; each is written to the shared
    folder. Words whose chain has ended take no part in later rounds. Rows with a null word or form are ignored.
    """
    now = written(forms.select("word", F.col("form").alias("root")).filter("word IS NOT NULL AND root IS NOT NULL"), name)
    ended = None
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ended is not None:
            step = step.union(ended.select(F.col("word").alias("root"), F.col("root").alias("next")))
        both = written(now.join(step.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), name)
        done = both.filter("NOT moved").select("word", "root")
        ended = done if ended is None else ended.union(done)
        now = both.filter("moved").select("word", "root")
        if now.isEmpty():
            return ended


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near (near words), form and form_n (the near word of largest n, ties to the smallest, where that is
    ``ratio`` times the word's n or more, else null), root (the last of the chain of forms, or the word itself).

    ``words`` (word, n) has distinct words; the result has a row for each. It is written to the shared folder first.
    """
    words = written(words, "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("near"))).alias("best"))
    fits = -F.col("best.minus_n") >= ratio * F.col("n")
    found = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus_n")).alias("form_n"))
    found = written(found, "spelling-forms")
    return found.join(roots(found).hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(word_counts(docs, misprint=MISPRINT)).select("word", "form", "root", "n", "n_near", "form_n")


#: DuckDB's levenshtein counts bytes, so each letter beyond ASCII is written as an ASCII character that no word has.
_LATIN = "".join(map(chr, range(0xC0, 0x100)))
_ASCII = "".join(c for c in map(chr, range(0x21, 0x7F)) if c not in "'" and not c.islower())[: len(_LATIN)]

OP13_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), lower_runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL
), coded AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS bytes FROM lower_runs WHERE length(run) >= 6
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h FROM coded, crc
), printed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM printed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), plain AS (
  SELECT word, n, translate(word, '{LATIN}', '{ASCII}') AS p FROM words
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM plain a JOIN plain b ON abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.p, b.p) = 1
), ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chain AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT c.word, c.root FROM chain c JOIN formed g ON g.word = c.root WHERE g.form IS NULL) c ON c.word = f.word
""".replace("{LATIN}", _LATIN).replace("{ASCII}", _ASCII)
