"""In-order pairing of the lines, and of the words, of two versions of a document.

What pairs one after another at both ends needs no table. Between, the longest pairing is found a row at a time, with one
bit for each column, so a table of n by m cells costs n m / 8 bytes and runs at the speed of long integers. A table beyond
``TABLE_BITS`` is halved by rows at a column where a longest pairing crosses, again and again, so memory stays bounded for
texts of any length. Spark spreads the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from itertools import accumulate, chain, pairwise
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.plans.registry import query

TABLE_BITS = 1 << 30  #: 128 MB: 32,000 by 32,000 lines at once
PLAIN_PAIRS = 1 << 16  #: up to so many pairs of lines are compared one by one
DOCS_A_BATCH = 256  #: documents whose lines are Python objects at once
PHRASE_GAP = 2  #: unchanged words between two changes that belong to one phrase, at most


def _grown(hits: Sequence[int], width: int) -> Iterator[int]:
    """After each row, the columns at which the longest pairing does not grow, as bits."""
    full = (1 << width) - 1
    row = full
    yield row
    for hit in hits:
        met = row & hit
        row = ((row + met) | (row - met)) & full
        yield row


def _lengths(hits: Sequence[int], width: int) -> list[int]:
    """Length of the longest pairing of all rows with the first k columns, for k from 0 to ``width``."""
    *_, last = _grown(hits, width)
    out = [0]
    for bit in reversed(format(last, f"0{width}b") if width else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def longest(hits: Sequence[int], mirrored: Sequence[int], width: int, most: int | None = None) -> list[tuple[int, int]]:
    """(row, column) pairs of a longest in-order pairing.

    ``hits`` has for each row the columns that it may pair with, as bits, ``mirrored`` the same with columns counted from
    the end. The walk goes from the end: a match is always taken; else a column is left out where that costs nothing,
    and else the row. Beyond ``most`` bits (``TABLE_BITS``) the pairing is as long, but ties may fall otherwise.
    """
    most = TABLE_BITS if most is None else most
    out, parts = [], [(0, len(hits), 0, width)]
    while parts:
        top, bottom, left, right = parts.pop()
        own = right - left
        if not own or top == bottom:
            continue
        cut = (1 << own) - 1
        rows = [h >> left & cut for h in hits[top:bottom]]
        if (bottom - top) * own > most and bottom - top > 1:
            half = (bottom - top) // 2
            back = [h >> (width - right) & cut for h in reversed(mirrored[top + half : bottom])]
            before, behind = _lengths(rows[:half], own), _lengths(back, own)
            k = max(range(own + 1), key=lambda c: (before[c] + behind[own - c], -c))
            parts += [(top, top + half, left, left + k), (top + half, bottom, left + k, right)]
            continue
        grown = list(_grown(rows, own))
        i, j = bottom - top, own
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                out.append((top + i - 1, left + j - 1))
                i, j = i - 1, j - 1
            elif grown[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return sorted(out)


def _bits(places: dict[Hashable, list[int]]) -> dict[Hashable, int]:
    """For each key its places as bits."""

    def of(at: list[int]) -> int:
        if len(at) == 1:
            return 1 << at[0]
        data = bytearray(max(at) // 8 + 1)
        for p in at:
            data[p // 8] |= 1 << p % 8
        return int.from_bytes(data, "little")

    return {k: of(at) for k, at in places.items()}


def _places_of(pairs: Iterable[tuple[Hashable, int]]) -> dict[Hashable, list[int]]:
    out: dict[Hashable, list[int]] = {}
    for k, i in pairs:
        out.setdefault(k, []).append(i)
    return out


def _places(keys: Sequence[Hashable]) -> dict[Hashable, list[int]]:
    return _places_of((k, i) for i, k in enumerate(keys))


def _in_order(rows: Sequence, columns: Sequence, like: Callable, table: Callable) -> list[tuple[int, int]]:
    """The pairing that a walk from the end over the full table gives, the table asked only for what lies between the ends.

    Rows and columns that pair one after another at the end are taken as they come. Those at the start add the same to all
    the table, so the walk is the table's own until one side has no more than its start. From there the longest pairing has
    all of that side: matches are taken, and else the longer side loses one.
    """
    n, m = len(rows), len(columns)
    end = []
    while n and m and like(rows[n - 1], columns[m - 1]):
        n, m = n - 1, m - 1
        end.append((n, m))
    head = 0
    while head < n and head < m and like(rows[head], columns[head]):
        head += 1
    inner = table(rows[head:n], columns[head:m]) if head < n and head < m else []
    # What precedes the first pair has no other, so columns go first, where there are rows.
    i, j = inner[0] if inner else (n - head, m - head)
    i, j = head + i, head + (0 if i else j)
    start = []
    while i and j:
        if like(rows[i - 1], columns[j - 1]):
            i, j = i - 1, j - 1
            start.append((i, j))
        elif i > j:
            i -= 1
        else:
            j -= 1
    return start[::-1] + [(head + i, head + j) for i, j in inner] + end[::-1]


def equal_pairs(a: Sequence[str], b: Sequence[str], most: int | None = None) -> list[tuple[int, int]]:
    """Indices of a longest in-order pairing of equal items."""

    def table(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
        forth = _bits(_places(b))
        back = _bits(_places(b[::-1])) if len(a) * len(b) > (TABLE_BITS if most is None else most) else forth
        return longest([forth.get(x, 0) for x in a], [back.get(x, 0) for x in a], len(b), most)

    return _in_order(a, b, eq, table)


def _at_least(planes: list[int], n: int, full: int) -> int:
    """Columns whose count, given as one integer a binary digit, is ``n`` or more."""
    if n >> len(planes):
        return 0
    equal, above = full, 0
    for k in range(len(planes) - 1, -1, -1):
        met = equal & planes[k]
        if n >> k & 1:
            equal = met
        else:
            above |= met
            equal ^= met
    return above | equal


def alike(a: frozenset[str], b: frozenset[str]) -> bool:
    """Whether two sets share half of all their words or more; empty sets are alike."""
    if a is b:
        return True
    n, m = len(a), len(b)
    return n <= 2 * m and m <= 2 * n and 3 * len(a & b) >= n + m


def _alike_bits(n: int, words: int, columns: list[tuple[int, int, int]]) -> int:
    """``alike`` for a set of ``n`` words, as bits, against (number of words, words, places) of many, or-ed together."""
    found = 0
    for m, other, places in columns:
        if n <= 2 * m and m <= 2 * n and 3 * (words & other).bit_count() >= n + m:
            found |= places
    return found


def like_columns(rows: set[frozenset[str]], columns: Sequence[frozenset[str]]) -> dict[frozenset[str], int]:
    """For each set of words the columns that share half of all their words or more, as bits; empty sets are alike.

    A few sets are compared one by one. Words in common of more are counted for all columns at once, a binary digit an
    integer, so a word that every line has costs no more than a rare one.
    """
    if len(rows) * len(columns) <= PLAIN_PAIRS:
        # Only words of two different sets or more are counted; a set is like itself.
        sets = {*rows, *columns}
        bit = {w: 1 << i for i, w in enumerate(w for w, n in Counter(chain.from_iterable(sets)).items() if n > 1)}
        words, places = {c: sum(map(bit.get, c & bit.keys())) for c in sets}, _bits(_places(columns))
        own = [(len(c), words[c], at) for c, at in places.items()]
        return {s: places.get(s, 0) | _alike_bits(len(s), words[s], own) for s in rows}
    full = (1 << len(columns)) - 1
    wanted = set().union(*rows) if rows else set()
    by_word = _bits(_places_of((w, i) for i, c in enumerate(columns) for w in c if w in wanted))
    by_size = _bits(_places([len(c) for c in columns]))
    out = {}
    for s in rows:
        planes: list[int] = []
        for w in s:
            carry = by_word.get(w, 0)
            for k, plane in enumerate(planes):
                planes[k], carry = plane ^ carry, plane & carry
                if not carry:
                    break
            if carry:
                planes.append(carry)
        found = 0
        for size, own in by_size.items():
            if not s or not size:
                found |= own if len(s) == size else 0
            elif size <= 2 * len(s) and len(s) <= 2 * size:
                found |= own & _at_least(planes, -(-(len(s) + size) // 3), full)
        out[s] = found
    return out


def line_pairs(olds: Sequence[str], news: Sequence[str], most: int | None = None) -> list[tuple[int, int]]:
    """Indices of the longest in-order pairing of like lines.

    Lines are alike that share half of all their words, upper case aside, or have none. From the start, lines that are
    alike pair; else the old line is left out where that costs nothing, and else the new one.
    """
    known: dict[str, frozenset[str]] = {}

    def words(x: str) -> frozenset[str]:
        if (found := known.get(x)) is None:
            found = known[x] = frozenset(x.lower().split())
        return found

    def table(news: Sequence[str], olds: Sequence[str]) -> list[tuple[int, int]]:
        a, b = [words(x) for x in olds], [words(x) for x in news]
        hits = like_columns(set(b), a)
        back = like_columns(set(b), a[::-1]) if len(a) * len(b) > (TABLE_BITS if most is None else most) else hits
        return longest([hits[t] for t in b], [back[t] for t in b], len(a), most)

    # The walk goes from the end, so both lists are turned round; old lines are the columns.
    n, m = len(olds), len(news)
    pairs = _in_order(news[::-1], olds[::-1], lambda x, y: x == y or alike(words(x), words(y)), table)
    return sorted((n - 1 - i, m - 1 - j) for j, i in pairs)


def in_order_pairs(olds: Sequence, news: Sequence, most: int | None = None) -> list[tuple[int, int]]:
    """``line_pairs`` of two lists of rows with a line."""
    return line_pairs([r["line"] for r in olds], [r["line"] for r in news], most)


def phrases(words: Sequence[str], changed: Sequence[bool], gap: int = PHRASE_GAP) -> list[tuple[str, bool]]:
    """Spans of text: changes with ``gap`` or fewer unchanged words between them become one, neighbours of a kind join."""
    flags, last = list(changed), -1
    for i, hit in enumerate(changed):
        if hit:
            if last >= 0 and 0 < i - last - 1 <= gap:
                flags[last + 1 : i] = [True] * (i - last - 1)
            last = i
    ends = [i for i in range(1, len(flags)) if flags[i] != flags[i - 1]]
    return [("".join(words[i:j]), flags[i]) for i, j in pairwise([0, *ends, len(flags)]) if i < j]


def word_changes(old: str, new: str) -> tuple[list[tuple[str, bool]], list[tuple[str, bool]]]:
    """The spans of both texts by word, the white space behind a word kept with it."""
    a, b = re.findall(r"\S+\s*", old), re.findall(r"\S+\s*", new)
    pairs = equal_pairs(old.split(), new.split())
    kept_a, kept_b = {i for i, _ in pairs}, {j for _, j in pairs}
    return phrases(a, [i not in kept_a for i in range(len(a))]), phrases(b, [j not in kept_b for j in range(len(b))])


def _by_document(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row for each document of both: the lines of the old and of the new version in order; null lines are empty."""
    lines = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("line", F.lit("")).alias("line")))).alias(name))
    return lines(old, "olds").join(lines(new, "news"), "doc_id", "full")


def _versions_of(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str], list[int], list[str]]]:
    """For each document positions and lines of the old and of the new version, empty where it has none."""

    def of(name: str) -> Iterator[tuple[list[int], list[str]]]:
        lines = batch.column(name)
        flat = lines.flatten()
        pos, text = flat.field("pos").to_pylist(), flat.field("line").to_pylist()
        for i, j in pairwise(accumulate(lines.value_lengths().fill_null(0).to_pylist(), initial=0)):
            yield pos[i:j], text[i:j]

    for (pos, olds), (new_pos, news) in zip(of("olds"), of("news"), strict=True):
        yield pos, olds, new_pos, news


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, DOCS_A_BATCH):
            yield batch.slice(i, DOCS_A_BATCH)


def _placed(part: pa.RecordBatch, rows: list[tuple]) -> dict[str, pa.Array]:
    """Ids and positions of rows that begin with the document's place in the part and both positions."""
    doc, old, new = (pa.array([r[k] for r in rows], pa.int32()) for k in range(3))
    return {"doc_id": part.column("doc_id").take(doc), "old": old, "new": new}


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        rows = [(k, pos[i], new_pos[j]) for k, (pos, olds, new_pos, news) in enumerate(_versions_of(part)) for i, j in line_pairs(olds, news)]
        yield pa.RecordBatch.from_arrays(list(_placed(part, rows).values()), ["doc_id", "old_pos", "new_pos"])


def block_align(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, old_pos, new_pos): the longest in-order pairing of like blocks (half of their words in common).

    Versions without a difference pair natively; only the others go to the alignment, a document at a time. Documents
    that one version alone has, and null ids, have no rows; lines of one position are ordered by their text.
    """
    both = _by_document(old, new).filter("olds IS NOT NULL AND news IS NOT NULL")
    text = lambda c: F.transform(c, lambda x: x["line"])
    same = text("olds") == text("news")
    plain = both.filter(same).select("doc_id", F.explode(F.arrays_zip(F.transform("olds", lambda x: x["pos"]).alias("o"), F.transform("news", lambda x: x["pos"]).alias("n"))).alias("p")).select("doc_id", F.col("p.o").alias("old_pos"), F.col("p.n").alias("new_pos"))
    kind = old.schema["doc_id"].dataType.simpleString()
    return plain.union(both.filter(~same).mapInArrow(_align, f"doc_id {kind}, old_pos int, new_pos int"))


_SPANS = "array<struct<text: string, changed: boolean>>"


def _changed_lines(olds: list[str], news: list[str]) -> Iterator[tuple[int | None, int | None, list[tuple[str, bool]], list[tuple[str, bool]]]]:
    """(old index, new index, spans of the old line, spans of the new one) of the lines that differ."""
    pairs = line_pairs(olds, news)
    for i, j in pairs:
        if olds[i] != news[j]:
            before, after = word_changes(olds[i], news[j])
            if any(c for _, c in (*before, *after)):
                yield i, j, before, after
    gone, come = set(range(len(olds))) - {i for i, _ in pairs}, set(range(len(news))) - {j for _, j in pairs}
    yield from ((i, None, [(olds[i].lstrip(), True)], []) for i in sorted(gone) if olds[i].strip())
    yield from ((None, j, [], [(news[j].lstrip(), True)]) for j in sorted(come) if news[j].strip())


def _spans(column: list[list[tuple[str, bool]]]) -> pa.ListArray:
    text, changed = ([x[k] for spans in column for x in spans] for k in range(2))
    inner = pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(changed, pa.bool_())], ["text", "changed"])
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, column), initial=0), pa.int32()), inner)


def _highlighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = lambda pos, i: None if i is None else pos[i]
    for part in _parts(batches):
        rows = [(k, at(pos, i), at(new_pos, j), *spans) for k, (pos, olds, new_pos, news) in enumerate(_versions_of(part)) for i, j, *spans in _changed_lines(olds, news)]
        yield pa.RecordBatch.from_arrays([*_placed(part, rows).values(), _spans([r[3] for r in rows]), _spans([r[4] for r in rows])], ["doc_id", "pos", "new_pos", "before", "after"])


def version_phrases(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, pos, new_pos, before, after): each changed line with its spans of changed and unchanged text by version.

    Lines pair as in ``block_align`` and words by their longest common sequence; changes with up to two unchanged words
    between them are one phrase. A line of one version alone is one changed span, its other position null; blank lines and
    changes of white space alone have no row. A document that one version lacks is wholly deleted or inserted.
    """
    kind = old.schema["doc_id"].dataType.simpleString()
    both = _by_document(old, new)
    differ = ~F.transform("olds", lambda x: x["line"]).eqNullSafe(F.transform("news", lambda x: x["line"]))
    return both.filter(differ).mapInArrow(_highlighted, f"doc_id {kind}, pos int, new_pos int, before {_SPANS}, after {_SPANS}")


def _versions(t) -> tuple[DataFrame, DataFrame]:
    return tuple(t.doc_versions.filter(F.col("version") == v).select("doc_id", "pos", "line") for v in (1, 2))


query("block_align")(lambda t: block_align(*_versions(t)))
query("version_phrases")(lambda t: version_phrases(*_versions(t)))
