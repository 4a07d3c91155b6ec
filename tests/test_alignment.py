"""Pairings of lines and words against the full table."""

import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest

from leafmill.operators import alignment


def table(a, b, like):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            dp[i][j] = dp[i + 1][j + 1] + 1 if like(a[i], b[j]) else max(dp[i + 1][j], dp[i][j + 1])
    return dp


def plain_pairs(a, b):
    """The full table, walked from the start."""
    like = lambda x, y: x == y or (bool(x | y) and len(x & y) >= 0.5 * len(x | y))
    a, b = ([set(x.lower().split()) for x in v] for v in (a, b))
    dp, i, j, out = table(a, b, like), 0, 0, []
    while i < len(a) and j < len(b):
        if like(a[i], b[j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif dp[i + 1][j] >= dp[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_words(a, b):
    """The full table of prefixes, walked from the end."""
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if x == y else max(dp[i - 1][j], dp[i][j - 1])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif dp[i][j - 1] >= dp[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def some_lines(draw, n):
    return [" ".join(draw.choice("abcde") for _ in range(draw.choice((0, 1, 2, 3, 4)))) for _ in range(n)]


def test_line_pairs_equal_the_full_table():
    draw = random.Random(1)
    for _ in range(400):
        a, b = some_lines(draw, draw.randint(0, 14)), some_lines(draw, draw.randint(0, 14))
        rows = lambda v: [{"line": x} for x in v]
        assert alignment.in_order_pairs(rows(a), rows(b)) == plain_pairs(a, b)


def test_word_pairs_equal_the_full_table():
    draw = random.Random(2)
    for _ in range(400):
        a, b = ([draw.choice("abc") for _ in range(draw.randint(0, 16))] for _ in range(2))
        assert alignment.equal_pairs(a, b) == plain_words(a, b)


@pytest.mark.parametrize("most", (1, 7, 40))
def test_halved_tables_give_pairings_as_long(most):
    draw = random.Random(most)
    for _ in range(200):
        a, b = some_lines(draw, draw.randint(0, 14)), some_lines(draw, draw.randint(0, 14))
        rows = lambda v: [{"line": x} for x in v]
        got = alignment.in_order_pairs(rows(a), rows(b), most)
        assert len(got) == len(plain_pairs(a, b))
        assert all(x < y for p, q in zip(got, got[1:], strict=False) for x, y in zip(p, q, strict=True))


def test_twenty_thousand_lines_stay_small():
    draw = random.Random(3)
    a = [f"line {i} of {draw.randint(0, 9)} things" for i in range(20_000)]
    b = [x if draw.random() < 0.8 else f"new {draw.random()}" for x in a if draw.random() < 0.9]
    tracemalloc.start()
    began = time.time()
    got = alignment.in_order_pairs([{"line": x} for x in a], [{"line": x} for x in b])
    assert tracemalloc.get_traced_memory()[1] < 1 << 30 and time.time() - began < 60
    tracemalloc.stop()
    assert len(got) > 14_000


def test_phrases_by_hand():
    a = alignment.word_changes("The cat sat on the  mat today.", "The dog sat on a mat today.")
    assert a == ([("The ", False), ("cat sat on the  ", True), ("mat today.", False)], [("The ", False), ("dog sat on a ", True), ("mat today.", False)])
    assert alignment.phrases(list("abcdef"), [True, False, False, False, True, False]) == [("a", True), ("bcd", False), ("e", True), ("f", False)]
    assert alignment.word_changes("", "") == ([], [])


def test_phrases_keep_the_text(spark):
    draw = random.Random(4)
    old, new = ([(d, i, x) for d in range(6) for i, x in enumerate(some_lines(draw, 12))] for _ in range(2))
    old += [(8, 0, "only old"), (9, 0, "kept"), (9, 1, None)]
    new += [(9, 0, "kept"), (9, 1, ""), (7, 0, "only new")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, pos int, line string")
    got = alignment.version_phrases(frame(old), frame(new)).collect()
    text = lambda spans: "".join(s.text for s in spans)
    lines = [{(d, i): x for d, i, x in rows} for rows in (old, new)]
    for r in got:
        for spans, pos, side in ((r.before, r.pos, 0), (r.after, r.new_pos, 1)):
            assert text(spans) == ("" if pos is None else lines[side][r.doc_id, pos].lstrip())
        assert any(s.changed for s in (*r.before, *r.after))
    shown = {(r.doc_id, r.pos, r.new_pos) for r in got}
    for d in range(6):
        a, b = [x for e, _, x in old if e == d], [x for e, _, x in new if e == d]
        pairs = plain_pairs(a, b)
        want = {(d, i, j) for i, j in pairs if re.findall(r"\S+", a[i]) != re.findall(r"\S+", b[j])}
        want |= {(d, i, None) for i in set(range(12)) - {i for i, _ in pairs} if a[i]} | {(d, None, j) for j in set(range(12)) - {j for _, j in pairs} if b[j]}
        assert {x for x in shown if x[0] == d} == want
    assert {x for x in shown if x[0] > 5} == {(8, 0, None), (7, None, 0)}
    assert alignment.version_phrases(frame(old).limit(0), frame(new).limit(0)).count() == 0


def test_equal_versions_pair_natively(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (2, 0, None)], "doc_id long, pos int, line string")
    assert sorted(map(tuple, alignment.block_align(rows, rows).collect())) == [(1, 0, 0), (1, 5, 5), (2, 0, 0)]


def test_equal_ends_need_no_table(monkeypatch):
    asked = []
    whole = alignment.longest
    monkeypatch.setattr(alignment, "longest", lambda hits, back, width, most=None: asked.append((len(hits), width)) or whole(hits, back, width, most))
    lines = [f"line{i} x{i}" for i in range(400)]
    assert alignment.line_pairs(lines, lines[:150] + lines[151:]) == [(i, i - (i > 150)) for i in range(400) if i != 150] and not asked
    assert alignment.equal_pairs(list("aabab"), list("aabbab")) == [(0, 0), (1, 1), (2, 3), (3, 4), (4, 5)] and not asked
    swapped = lines[:150] + [lines[151], lines[150]] + lines[152:]
    assert len(alignment.line_pairs(lines, swapped)) == 399 and asked == [(2, 2)]


def test_few_and_many_sets_are_compared_alike(monkeypatch):
    draw = random.Random(5)
    sets = [frozenset(draw.choices("abcdefgh", k=draw.randint(0, 6))) for _ in range(60)]
    few = alignment.like_columns(set(sets[:30]), sets[20:])
    monkeypatch.setattr(alignment, "PLAIN_PAIRS", 0)
    assert few == alignment.like_columns(set(sets[:30]), sets[20:])


def test_many_documents_share_a_batch():
    lines = pa.list_(pa.struct([("pos", pa.int32()), ("line", pa.string())]))
    olds = [[{"pos": 0, "line": f"text {i}"}, {"pos": 1, "line": "kept"}] for i in range(300)] + [None]
    news = [[{"pos": 0, "line": "kept"}]] * 300 + [[{"pos": 4, "line": " a b"}]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array(olds, lines), pa.array(news, lines)], ["doc_id", "olds", "news"])
    made = list(alignment._highlighted(iter([batch])))
    assert len(made) == 2
    rows = [r for b in made for r in b.to_pylist()]
    assert rows[:300] == [{"doc_id": i, "pos": 0, "new_pos": None, "before": [{"text": f"text {i}", "changed": True}], "after": []} for i in range(300)]
    assert rows[300:] == [{"doc_id": 300, "pos": None, "new_pos": 4, "before": [], "after": [{"text": "a b", "changed": True}]}]
    assert [r for b in alignment._align(iter([batch])) for r in b.to_pylist()] == [{"doc_id": i, "old_pos": 1, "new_pos": 0} for i in range(300)]
