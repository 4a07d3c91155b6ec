"""Line-first quality rules, entirely in built-in column functions.

Each line is judged alone (punctuation, navigation, boilerplate); failing lines are removed; a document is rejected
when its removed lines hold too much of its text, or by the document-level base rules. There is no shuffle: every
document is judged from its own row, so a hot source or a group of copies cannot make a slow task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import words

#: Fixed phrases of page furniture, matched case-insensitively anywhere in a line.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "forgot your password",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "we use cookies",
)
#: An end of a sentence, before a blank or the line's end; marks that end sentences in other scripts wherever
#: they stand; and the letters of Thai and Lao, which write no such mark.
ENDS = "[.!?\\x{2026}][\"')\\]\\x{BB}\\x{201D}\\x{2019}]*([\\x20\\x09-\\x0D]|$)"
OTHER_ENDS = (
    "[\\x{589}\\x{61D}-\\x{61F}\\x{6D4}\\x{700}-\\x{702}\\x{7F9}\\x{964}\\x{965}\\x{104A}\\x{104B}\\x{1362}\\x{1367}\\x{1368}\\x{166E}\\x{17D4}\\x{17D5}"
    "\\x{1803}\\x{1809}\\x{1944}\\x{1945}\\x{203C}\\x{203D}\\x{2047}-\\x{2049}\\x{3002}\\x{A4FF}\\x{A60E}\\x{A60F}\\x{A6F3}\\x{A6F7}\\x{A876}\\x{A877}\\x{A8CE}\\x{A8CF}"
    "\\x{A9C8}\\x{A9C9}\\x{AA5D}-\\x{AA5F}\\x{ABEB}\\x{FE52}\\x{FE56}\\x{FE57}\\x{FF01}\\x{FF0E}\\x{FF1F}\\x{FF61}\\x{E01}-\\x{E30}\\x{E81}-\\x{EB0}]"
)
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """True for a line that holds a word and breaks a line rule.

    punctuation: it has no sentence end of any script at all (so headings and list items without one go), every tenth character or more is a symbol, or doubled exclamation or
    question marks end three words or more and at least every fifth word;
    navigation: three separators (``|``, ``>``, ``»``, ``•``, ``·``) or more stand between spaces, at least one for
    every four words;
    boilerplate: it holds one of the given phrases.
    """
    n_words = _count(line, "[^\\x20\\x09-\\x0D]+")
    separators = _count(line, "[ \\t][|>\\x{BB}\\x{2022}\\x{B7}][ \\t]")
    marks = _count(line, "[!?][!?]")
    no_sentence = ~line.rlike(ENDS) & ~line.rlike(OTHER_ENDS)
    symbols = _count(line, SYMBOLS) * 10 >= F.char_length(line)
    shouting = (marks >= 3) & (marks * 5 >= n_words)
    navigation = (separators >= 3) & (separators * 4 >= n_words)
    furniture = line.rlike("(?i)(" + "|".join(boilerplate) + ")")
    return no_sentence | symbols | shouting | navigation | furniture


def judge(
    docs: DataFrame,
    text_col: str = "text",
    *,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_lost_percent: int = MAX_LOST_PERCENT,
    boilerplate: tuple[str, ...] = BOILERPLATE,
) -> DataFrame:
    """Every row of ``docs`` with one more column, the struct ``quality_verdict``.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed (boolean), n_lines,
    n_bad_lines, n_chars, lost_chars (long), kept (boolean), clean_text (the lines that passed, in order).

    Null and empty texts have no words: they fail the base rules and are not kept. Lines without a word neither pass
    nor fail and stay in the cleaned text. Repeated rows are judged one by one. Only ``text_col`` is read; any other
    column, of whatever name, passes through. A column that is already called ``quality_verdict`` is replaced.
    Texts of any length are judged whole: the work is n log n in the number of words. Two 8-word windows count as
    equal when their 64-bit hashes are equal.
    """
    keep = [c for c in docs.columns if c != "quality_verdict"]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    base = base.withColumn("_words", words(F.col("_text"))).withColumn("_lines", F.split("_text", "\n"))
    # Hashes of all windows; only texts in which a hash comes twice go on to the sort.
    base = base.withColumn(
        "_hashes",
        F.expr(f"CASE WHEN size(_words) >= {WINDOW} THEN transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) ELSE array() END"),
    )
    base = base.withColumn(
        "_sorted",
        F.expr("CASE WHEN size(array_distinct(_hashes)) < size(_hashes) THEN array_sort(transform(_hashes, (h, i) -> struct(h, i))) END"),
    )
    base = base.withColumn(
        "_starts",
        F.expr(
            "CASE WHEN _sorted IS NOT NULL THEN array_sort(transform(filter(sequence(0, size(_sorted) - 1), "
            "j -> coalesce(get(_sorted, j).h = get(_sorted, j - 1).h, false) OR coalesce(get(_sorted, j).h = get(_sorted, j + 1).h, false)), "
            "j -> get(_sorted, j).i)) END"
        ),
    )
    base = base.withColumn(
        "_judged",
        F.transform(
            "_lines",
            lambda x: F.struct(
                x.alias("line"),
                x.rlike("[^\\x20\\x09-\\x0D]").alias("worded"),
            ),
        ),
    )
    base = base.withColumn(
        "_judged",
        F.transform("_judged", lambda x: F.struct(x["line"].alias("line"), x["worded"].alias("worded"), (x["worded"] & line_fails(x["line"], boilerplate)).alias("bad"))),
    )
    worded = F.expr("transform(filter(_judged, x -> x.worded), x -> x.line)")
    base = base.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"CASE WHEN _starts IS NULL THEN 0L ELSE aggregate(_starts, struct(0L AS c, {-WINDOW} AS last), "
            f"(a, x) -> struct(a.c + least({WINDOW}, x - a.last) AS c, x AS last), a -> a.c) END"
        ).alias("n_repeat_words"),
        F.size(worded).cast("long").alias("n_lines"),
        F.expr("CAST(size(filter(_judged, x -> x.bad)) AS long)").alias("n_bad_lines"),
        F.expr("aggregate(_judged, 0L, (a, x) -> a + IF(x.worded, char_length(x.line), 0))").alias("n_chars"),
        F.expr("aggregate(_judged, 0L, (a, x) -> a + IF(x.bad, char_length(x.line), 0))").alias("lost_chars"),
        F.expr("array_join(transform(filter(_judged, x -> NOT x.bad), x -> x.line), '\n')").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    kept = ~failed & (100 * F.col("lost_chars") <= max_lost_percent * F.col("n_chars"))
    verdict = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        "n_lines", "n_bad_lines", "n_chars", "lost_chars", kept.alias("kept"), "clean_text",
    )
    return base.select(*[F.col("_row")[c].alias(c) for c in keep], verdict.alias("quality_verdict"))


def clean(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The documents that pass, with their failing lines removed; the columns of ``docs``.

    Null and empty texts go; repeated rows are judged one by one; an empty table gives an empty result. Failing lines
    include headings and list items without a sentence end. A script that writes no blanks has few words, as the base
    rules count them, whatever its sentences.
    """
    # A column that isn't deterministic keeps the filter above the judgement; pushed down, it would judge twice and inline
    # every step into the next.
    judged = judge(docs, text_col, **rules).withColumn("_row", F.monotonically_increasing_id()).filter("_row >= 0 AND quality_verdict.kept")
    return judged.select(*[(F.col("quality_verdict.clean_text") if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    v = "quality_verdict"
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(docs).select("doc_id", *[F.col(f"{v}.{f}").alias(f) for f in fields])


_PHRASES = "|".join(BOILERPLATE)
_ENDS_SQL = ENDS.replace("'", "''")
OP1_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM t
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS key
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})
), flagged AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(g) AS n_repeat_words FROM (
    SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS g FROM flagged
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, l, n, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS nw,
    len(regexp_extract_all(l, '[ \\t][|>\\x{{BB}}\\x{{2022}}\\x{{B7}}][ \\t]')) AS sep,
    len(regexp_extract_all(l, '[!?][!?]')) AS marks
  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS n FROM w)
), judged AS (
  SELECT doc_id, l, n, length(l) AS chars,
    NOT regexp_matches(l, '{_ENDS_SQL}') AND NOT regexp_matches(l, '{OTHER_ENDS}')
    OR len(regexp_extract_all(l, '{SYMBOLS}')) * 10 >= length(l)
    OR (marks >= 3 AND marks * 5 >= nw)
    OR (sep >= 3 AND sep * 4 >= nw)
    OR regexp_matches(l, '(?i)({_PHRASES})') AS bad
  FROM lines WHERE nw > 0
), perdoc AS (
  SELECT doc_id, count(*) AS n_lines, count(DISTINCT l) AS n_distinct, sum(chars) AS n_chars, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost
  FROM judged GROUP BY doc_id
), base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines - n_distinct, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_chars, 0) AS n_chars, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN perdoc USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost <= {MAX_LOST_PERCENT} * n_chars AS kept
FROM base
"""
