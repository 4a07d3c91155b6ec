"""Mixing sources to target weights along a time-varying curriculum.

A source's weight over training time is piecewise linear. Its integral is the source's overall weight, from which its
target share of the words follows; its running integral, scaled to that target, is its cumulative demand. A document's
occurrences lie one after another in its source's word sequence, and the inverse of the demand turns such an offset
into a training position in [0, 1). Sorting by position gives the training order.

Offsets are running sums in a pseudo-random but fixed document order. They are taken in two steps, over buckets of the
order key and within one bucket, so that a hot source is spread over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._shared import word_count

#: Weights at equally spaced times; the sources, in code point order, take these schedules in turn. Integrals: 1, 2, 3.
SCHEDULES = ((1.5, 1.0, 0.5), (2.0, 2.0, 2.0), (2.0, 3.0, 4.0))
MAX_REPEATS = 3
PREFIX = 3  #: hex digits of the order key that make a bucket: 4,096 buckets a source
SEED = "mix-1"


def integral(schedule: tuple[float, ...]) -> float:
    """The area under a piecewise linear schedule over [0, 1]."""
    return sum((a + b) / 2 for a, b in zip(schedule, schedule[1:], strict=False)) / (len(schedule) - 1)


def _pick(which: str, values: list[str]) -> str:
    return "CASE " + which + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def position_sql(which: str, share: str, schedules=SCHEDULES) -> str:
    """SQL for the time at which the schedule numbered ``which`` has used up ``share`` of its area."""

    def one(schedule: tuple[float, ...]) -> str:
        h, total, at, out = 1 / (len(schedule) - 1), integral(schedule), 0.0, []
        for j, (a, b) in enumerate(zip(schedule, schedule[1:], strict=False)):
            rest = f"greatest(CAST(0 AS DOUBLE), {share} * CAST({total!r} AS DOUBLE) - CAST({at!r} AS DOUBLE))"
            root = f"CAST({a!r} AS DOUBLE) + sqrt(greatest(CAST(0 AS DOUBLE), CAST({a * a!r} AS DOUBLE) + CAST({2 * (b - a) / h!r} AS DOUBLE) * {rest}))"
            x = f"CASE WHEN {root} > 0 THEN 2 * {rest} / ({root}) ELSE CAST(0 AS DOUBLE) END"
            value = f"CAST({j * h!r} AS DOUBLE) + least(CAST({h!r} AS DOUBLE), {x})"
            at += (a + b) / 2 * h
            last = j == len(schedule) - 2
            out.append(f"ELSE {value}" if last else f"WHEN {share} * CAST({total!r} AS DOUBLE) < CAST({at!r} AS DOUBLE) THEN {value}")
        return out[0].removeprefix("ELSE ") if len(out) == 1 else "CASE " + " ".join(out) + " END"

    return _pick(which, [one(s) for s in schedules])


def source_targets(sizes: DataFrame, *, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """source, source_size, schedule (its number), target: from one row a source (source, source_size).

    Targets are ``share`` of all sizes dealt by weight, but at most ``max_repeats`` times the source's size; the excess
    is dealt again by weight until none is above. The water level is the largest of those that follow from capping the
    0, 1, 2, ... sources whose cap is the smallest for their weight.
    """
    weight = _pick(f"schedule_no % {len(schedules)}", [f"CAST({integral(s)!r} AS DOUBLE)" for s in schedules])
    numbered = sizes.selectExpr("*", "row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS schedule_no")
    weighted = numbered.selectExpr("source", "source_size", f"CAST(schedule_no % {len(schedules)} AS int) AS schedule", f"{weight} AS w")
    ranked = weighted.selectExpr(
        "*",
        f"sum({max_repeats} * source_size) OVER (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {max_repeats} * source_size AS capped",
        "sum(w) OVER (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w AS capped_w",
        "sum(source_size) OVER () AS total",
        "sum(w) OVER () AS total_w",
    )
    level = ranked.selectExpr("*", f"max(({share!r}D * total - capped) / (total_w - capped_w)) OVER () AS level")
    return level.selectExpr("source", "source_size", "schedule", f"least(level * w, CAST({max_repeats} * source_size AS DOUBLE)) AS target")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    *,
    text_col: str = "text",
    schedules=SCHEDULES,
    max_repeats: int = MAX_REPEATS,
    share: float = 1.0,
    seed: str = SEED,
    prefix: int = PREFIX,
) -> DataFrame:
    """Every row of ``docs`` with one more column, the struct ``mix``.

    Fields: size, source_size (long), target (double, the source's), taken (long: words the mix takes of the document,
    repeats counted), positions (array of double: where its occurrences start in training time, in [0, 1]).

    ``size`` defaults to the number of words of ``text_col`` (null: 0). A null source is a source of its own, after all
    others. Documents of size 0 take nothing and have no positions. Within a source, documents are taken whole in the
    order of a keyed digest of their id, for as many rounds as the target asks; of the last document of the last round
    only the words that are still wanted. Repeated rows are different documents; with equal ids they are ordered by
    size and a hash of their text. Other columns pass through, a column named ``mix`` is replaced. Every total is exact
    and independent of partitioning, so reruns agree.
    """
    names = [c for c in docs.columns if c != "mix"]
    size = word_count(F.col(f"`{text_col}`")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    text = F.xxhash64(f"`{text_col}`") if text_col in docs.columns else F.lit(0)
    order = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        size.alias("size"),
        order.alias("_order"),
        F.col(f"`{id_col}`").alias("_id"),
        text.alias("_text"),
    )
    rows = rows.withColumn("_bucket", F.substring("_order", 1, prefix)).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    buckets = rows.groupBy("_key", "source", "_bucket").agg(F.sum("size").alias("_n"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("_n").alias("source_size")), schedules=schedules, max_repeats=max_repeats, share=share)
    targets = targets.withColumn("_k", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).drop("source")
    before = buckets.selectExpr("_key AS _bk", "_bucket AS _bb", "sum(_n) OVER (PARTITION BY _key ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _n AS _before")
    before = before.join(targets, F.col("_bk") == F.col("_k"))
    own = rows.selectExpr("*", "sum(size) OVER (PARTITION BY _key, _bucket ORDER BY _order, _id, size, _text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS _own")
    met = own.join(before, (F.col("_key") == F.col("_bk")) & (F.col("_bucket") == F.col("_bb")))
    met = met.withColumn("_at", F.col("_before") + F.col("_own"))
    met = met.withColumn("_rounds", F.expr("CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS long) ELSE 0L END"))
    met = met.withColumn("_part", F.expr("greatest(0L, least(size, CAST(round(target) AS long) - _rounds * source_size - _at))"))
    times = F.expr("CASE WHEN size > 0 THEN _rounds + IF(_part > 0, 1L, 0L) ELSE 0L END")
    share_of = "(CAST(x * source_size + _at AS DOUBLE) / target)"
    positions = F.expr(f"CASE WHEN _times > 0 THEN transform(sequence(0L, _times - 1), x -> {position_sql('schedule', share_of, schedules)}) ELSE CAST(array() AS array<double>) END")
    met = met.withColumn("_times", times).withColumn("_positions", positions)
    result = F.struct("size", "source_size", "target", F.expr("_rounds * size + _part").alias("taken"), F.col("_positions").alias("positions"))
    return met.select(*[F.col("_row")[c].alias(c) for c in names], result.alias("mix"))


def training_rows(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """One row an occurrence, range-sorted by training position: the columns other than ``mix``, then position (a column of that name is replaced).

    The last, partial occurrence of a document holds its first words, joined by spaces; others hold the text as it is.
    """
    names = [c for c in mixed.columns if c not in ("mix", "position")]
    rows = mixed.select(*[F.col(f"`{c}`") for c in names], "mix", F.posexplode("mix.positions").alias("_round", "position"))
    rows = rows.withColumn("_words", F.expr("least(mix.size, mix.taken - _round * mix.size)"))
    words = F.array_remove(F.split(F.col(f"`{text_col}`"), "[\\x20\\x09-\\x0D]+"), "")
    cut = F.when(F.expr("_words < mix.size"), F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), " ")).otherwise(F.col(f"`{text_col}`"))
    return rows.select(*[(cut if c == text_col else F.col(f"`{c}`")).alias(c) for c in names], "position").orderBy("position", names[0])


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), size=F.col("words"))
    out = mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", F.get("mix.positions", F.lit(0)).alias("first_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


_W = _pick(f"n % {len(SCHEDULES)}", [f"CAST({integral(s)!r} AS DOUBLE)" for s in SCHEDULES])
OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('{SEED}|' || CAST(doc_id AS VARCHAR)) AS o
  FROM documents
), s AS (
  SELECT source, source_size, CAST(n % {len(SCHEDULES)} AS INTEGER) AS schedule, {_W} AS w FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM d GROUP BY source)
), r AS (
  SELECT *, CAST(sum({MAX_REPEATS} * source_size) OVER q AS DOUBLE) - {MAX_REPEATS} * source_size AS capped, sum(w) OVER q - w AS capped_w,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS total_w
  FROM s WINDOW q AS (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), t AS (
  SELECT source, source_size, schedule, least(max((total - capped) / (total_w - capped_w)) OVER () * w, CAST({MAX_REPEATS} * source_size AS DOUBLE)) AS target FROM r
), p AS (
  SELECT doc_id, size, source_size, target, schedule, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS at0,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - rounds * source_size - at0)) AS part FROM p
)
SELECT doc_id, size, source_size, target, CAST(rounds * size + part AS BIGINT) AS taken,
  CASE WHEN size > 0 AND (rounds > 0 OR part > 0) THEN {position_sql('schedule', '(CAST(at0 AS DOUBLE) / target)')} END AS first_position
FROM q
"""
