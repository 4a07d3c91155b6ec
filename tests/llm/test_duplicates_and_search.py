"""Near duplicates, repeated strings and nearest neighbours against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import ann_search, minhash_dedup, suffix_dedup
from leafmill.llm.components import connected_components

DOCS = "doc_id long, text string, rep string, component_id long, node string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", -1, "clash") for r in rows], DOCS)


def near_texts(seed=3):
    rng = random.Random(seed)
    out = [None, "", "  ", "one two", "One TWO", "a b c d e"]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.randrange(1, 12)):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(99)}"
            out.append(" ".join(t))
    return out + [out[8], out[8]]


def brute(texts, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_components_match_brute_force(spark):
    texts = near_texts()
    frame = docs(spark, list(enumerate(texts)))
    for percent, options in ((85, {}), (80, {"leaf": 4, "block": 8})):
        got = minhash_dedup.near_duplicates(frame, percent=percent, **options).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = []
    for i in range(130):  # a chain that drifts away from its start, and copies of one text with few changes
        if i % 3 == 0:
            base = list(base)
            base[rng.randrange(120)] = f"d{i}"
        t = list(base)
        if i % 4 == 0:
            t[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(t))
    monkeypatch.setattr(minhash_dedup, "WIDE", 12)
    got = minhash_dedup.near_duplicates(docs(spark, list(enumerate(texts))), percent=90, leaf=4, block=16, trees=12).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, 90)


def test_dedup_keeps_one_of_each_group(spark):
    texts = near_texts(4)
    want = brute(texts, 80)
    rows = list(enumerate(texts)) + [(0, None), (7, texts[7])]
    out = minhash_dedup.deduplicated(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "rep", "component_id", "node"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_exact_links_in_narrow_blocks():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    got = minhash_dedup.exact_links(sets, 60)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            n = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and 100 * n >= 60 * (len(a) + len(b) - n))


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (5, 5), (200, 200), (300, None)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 200: 200}


def repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = {}
    for k, b in enumerate(raw):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings_match_brute_force(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(90), word(61), word(40)]
    texts = [None, "", "short", "xy" * 200, "z" * 500, word(800)]
    for _ in range(40):
        texts.append(word(rng.randrange(80)) + rng.choice(shared)[rng.randrange(5) :] + word(rng.randrange(80)) + rng.choice(shared))
    texts += [texts[5], texts[7]]
    frame = docs(spark, list(enumerate(texts)))
    for length, gram in ((50, 16), (60, 32)):
        got = suffix_dedup.without_repeats(frame, length=length, gram=gram).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == repeats(texts, length)


def removed(frame, **options):
    got = suffix_dedup.without_repeats(frame, **options).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}


def test_repeated_strings_at_the_registered_length(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [word(n) for n in (199, 200, 201, 260, 700)]
    texts = [None, "", word(5000), "ab" * 300]
    for i in range(60):
        texts.append(word(rng.randrange(150)) + shared[i % 5][rng.randrange(3) :] + word(rng.randrange(150)) + rng.choice(shared)[: rng.randrange(190, 700)])
    texts += [texts[2], texts[9] + texts[9]]
    assert removed(docs(spark, list(enumerate(texts)))) == repeats(texts, 200)


def test_the_order_may_be_split_anywhere(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shared = word(70)
    texts = [word(60) + shared + word(60) for _ in range(12)] + [word(3) + shared[rng.randrange(9) : 60 + rng.randrange(9)] + word(3) for _ in range(30)]
    frame = docs(spark, list(enumerate(texts)))
    monkeypatch.setattr(suffix_dedup, "PART", 7)
    assert removed(frame, length=50, gram=16) == repeats(texts, 50)
    assert suffix_dedup.without_repeats(docs(spark, [])).count() == 0


def test_long_texts_are_hashed_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    b = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.runs(b, 50, 16)
    monkeypatch.setattr(suffix_dedup, "SLICE", 600)
    parts = suffix_dedup.runs(b, 50, 16)
    window = lambda r: np.repeat(r[0], r[3])
    assert (window(whole) == window(parts)).all() and parts[3].sum() == 4951
    starts = np.concatenate([np.arange(s, s + n) for s, n in zip(parts[2], parts[3])])
    assert (starts == np.arange(4951)).all()


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    from leafmill.llm import _shared

    monkeypatch.setattr(_shared, "HOT_SHARE", 3)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(k, 0) for k in range(2, 9)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 10)
    got = _shared.hot_join(rows, table.filter("k <> 5"), ["k"], ["v"]).collect()
    assert sorted((r.k, r.v, r.w) for r in got) == sorted([(1, i, 10) for i in range(50)] + [(k, 0, 10 * k) for k in range(2, 9) if k != 5])


def test_neighbours_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    base = [[float(x) for x in v] for v in rng.standard_normal((300, 8)).astype(np.float32)]
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(1000 + i, base[50]) for i in range(9)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 7 + [None]), (2004, [1.0, 2.0]), (50, base[50]), (None, base[3])]
    frame = spark.createDataFrame([(a, b, "clash") for a, b in rows], "vec_id long, embedding array<float>, rep string")
    got = ann_search.nearest_neighbours(frame, F.col("vec_id") % 50 == 0, probe_percent=100).collect()
    every = {i: np.array(v) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    for q in (i for i in every if i % 50 == 0):
        best = sorted((-round(cos(every[q], v), 12), i) for i, v in every.items() if i != q)[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in best]
        assert all(abs(m[2] + s) < 1e-9 for m, (s, _) in zip(mine, best))
    assert {r.query_id for r in got} == {i for i in every if i % 50 == 0}
    few = ann_search.nearest_neighbours(frame.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann_search.nearest_neighbours(frame.limit(0), F.lit(True)).count() == 0


def test_recall_on_the_given_vectors(spark):
    from leafmill.llm.ann_search import op3_ann_search

    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in op3_ann_search(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    asked = [i for i, v in enumerate(ids) if v % 50 == 0]
    for i in asked:
        s = x @ x[i]
        s[i] = -2
        hits += len(got[ids[i]] & set(ids[np.argsort(-s, kind="stable")[:5]]))
    print("recall", hits / (5 * len(asked)))
    assert hits >= 0.9 * 5 * len(asked)


def test_small_shards_and_structured_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((30, 16))
    x = (centre[rng.integers(0, 30, 1500)] + 0.2 * rng.standard_normal((1500, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = ann_search._unit(list(x))
    centroids = ann_search.kmeans(unit, 38)
    assert ann_search.probes_needed(unit, centroids, 5) < 0.4  # clusters need few lists
    monkeypatch.setattr(ann_search, "CHUNK_ENTRIES", 40)
    monkeypatch.setattr(ann_search, "CHUNK_QUERIES", 7)
    got = {}
    for r in ann_search.nearest_neighbours(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    want = {}
    for i in range(0, 1500, 50):
        s = unit @ unit[i]
        s[i] = -2
        want[i] = list(np.argsort(-s, kind="stable")[:5])
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    assert sum(len(set(got[i].values()) & set(want[i])) for i in want) >= 0.9 * 5 * len(want)
