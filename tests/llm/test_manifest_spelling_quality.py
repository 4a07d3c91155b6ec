"""The Merkle manifest, spelling variants and the quality classifier against brute force, identities and held-out labels."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import manifest, quality_model, spelling

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# --- manifest -------------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in manifest.COLUMNS))


def plain_tree(leaves):
    """The root, and for each leaf its siblings with its place, upwards."""
    paths, at, row = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(row) > 1:
        for k, i in enumerate(at):
            run = row[i - i % 8 : i - i % 8 + 8]
            paths[k].append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        row = [H(*row[i : i + 8]) for i in range(0, len(row), 8)]
        at = [i // 8 for i in at]
    return row[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[g] = (own, *plain_tree([plain_leaf(r) for r in own]))
    root, above = plain_tree([trees[g][1] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        own, subroot, paths = trees[g]
        out += [(r["doc_id"], plain_leaf(r), subroot, root, H(*(s for _, run in path + up for s in run))) for r, path in zip(own, paths, strict=True)]
    return out


def as_dicts(rows):
    return [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows]


CASES = {
    "one": [(5, "s", "en", 1, "A")],
    "eight": [(i, "s", "en", i, "t") for i in range(8)],
    "nine": [(i, None, "en", i, "é" * i) for i in range(9)],
    "nulls": [(None, None, None, None, None), (1, "a", None, 3, "x"), (None, "b", "en", 1, ""), (2, "", "", 0, "y")],
    "repeats": [(1, "s", "en", 1, "A")] * 10 + [(1, "s", "en", 1, "b"), (0, "s", "fr", 1, "A")],
    "groups": [(i, "s", f"g{i % 70}é", i, "t") for i in range(300)],
    "blocks": [(i * 7 % 4999, "s", "en" if i < 4500 else "de", 1, str(i)) for i in range(4600)],
}


@pytest.mark.parametrize("name", CASES)
def test_manifest_equals_plain_recursion(spark, name):
    rows = CASES[name]
    got = manifest.manifest(spark.createDataFrame(rows, DOCS)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((key((None if r.id is None else int(r.id), r.leaf, r.subroot, r.root, r.proof_sha256)) for r in got)) == sorted(map(key, plain_manifest(as_dicts(rows))))
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_a_changed_leaf_does_not_verify(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "T") for i in range(100)], DOCS)
    wrong = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("other"), 256))
    got = {int(r.id): r.verified for r in manifest.manifest(docs, claimed=wrong).collect()}
    assert got == {i: i % 7 != 0 for i in range(100)}


def test_manifest_of_nothing_and_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "T", 9, b"x", 7, "y")], DOCS + ", pos long, digest binary, n long, tree string")
    assert manifest.manifest(docs).count() == 1
    assert manifest.manifest(docs.limit(0)).count() == 0


def test_addresses_are_a_permutation_that_keeps_subtrees_together():
    for levels in range(1, 6):
        places = np.concatenate([manifest.address(levels, d, np.arange(8**d)) for d in range(levels)])
        assert sorted(places) == list(range(manifest.nodes_of(levels)))
    # The lower half of five levels: each subtree of three levels fills one stretch.
    for j in range(64):
        own = np.concatenate([manifest.address(5, 2 + d, np.arange(j * 8**d, (j + 1) * 8**d)) for d in range(3)])
        assert own.max() - own.min() + 1 == len(own) == 73


# --- spelling variants ----------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_pairs_equal_brute_force(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(4, 9))) for _ in range(900)}
    got = {frozenset((r.a, r.b)) for r in spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()}
    words = sorted(words)
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    assert got == want and len(want) > 500


def test_pairs_come_once(spark):
    pairs = spelling.near_pairs(spark.createDataFrame([("abcdefgh", 5), ("abcdefgx", 5), ("abcdefghx", 9), (None, 3)], "word string, n long"))
    assert sorted((r.a, r.b) for r in pairs.collect()) == [("abcdefgh", "abcdefghx"), ("abcdefgh", "abcdefgx"), ("abcdefgx", "abcdefghx")]


def test_words_of_null_empty_long_and_repeated_texts(spark):
    rows = [(1, "Straße straße. naïveté×x"), (1, "Straße straße. naïveté×x"), (None, "STRAßE"), (2, None), (3, ""), (4, "lengthy " * 100_000), (5, "ab1cdefgh")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long")
    got = {r.word: r.n for r in spelling.word_counts(docs, least=1).collect()}
    assert got == {"straße": 5, "naïveté×x": 2, "lengthy": 100_000, "cdefgh": 1}
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_forms_break_ties_and_roots_follow_chains(spark):
    rows = [("abcdef", 1000), ("abcdeg", 1000), ("abcdex", 200), ("abcdxx", 30), ("abcxxx", 6), ("abcdeh", 201), ("nothing", 8)]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["abcdex"] == ("abcdef", "abcdef", 4, 1000)
    assert got["abcdxx"] == ("abcdex", "abcdef", 2, 200)
    assert got["abcxxx"] == ("abcdxx", "abcdef", 1, 30)
    assert got["abcdeh"] == (None, "abcdeh", 3, None)
    assert got["nothing"] == (None, "nothing", 0, None)


def test_long_chains_end(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(50)] + [("other", "w049"), (None, "w001")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w050"} and len(got) == 51


# --- quality classifier ---------------------------------------------------------------------------------------------


def test_linear_time_identity_equals_all_pairs():
    draw = np.random.default_rng(0)
    machine = quality_model.Machine(0.3, draw.normal(size=quality_model.SIZE), draw.normal(size=(quality_model.SIZE, quality_model.FACTORS)))
    places, values = quality_model.features("Some words and some more words | of 12 things.", 46.0, {})
    pairs = sum(float(machine.factors[places[i]] @ machine.factors[places[j]]) * values[i] * values[j] for i in range(len(places)) for j in range(i))
    assert machine.raw(places, values) == pytest.approx(0.3 + float(machine.linear[places] @ values) + pairs)


def test_repeated_windows_equal_a_plain_count():
    draw = np.random.default_rng(1)
    for n in (0, 3, 8, 9, 60, 400):
        h = draw.integers(0, 2, n).astype(np.uint64)
        windows = [tuple(h[i : i + 8]) for i in range(max(0, n - 7))]
        hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        assert quality_model._repeated(h) == pytest.approx(len(hit) / n if n else 0.0)


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality_model.op11_quality_classifier(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    clean, poor = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert len(clean) > 800 and len(poor) > 100
    assert sum(r.predicted for r in clean) >= 0.995 * len(clean)
    assert sum(r.predicted for r in poor) <= 0.05 * len(poor)


def test_scores_of_odd_rows(spark):
    rows = [(1, "A fair text.", 12), (1, "A fair text.", 12), (2, None, None), (3, "", 0), (None, "x " * 500_000, -5), (4, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), 1)]
    docs = spark.createDataFrame([(*r, 0.5, "s") for r in rows], "doc_id long, text string, n_chars long, score double, label string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    machine = quality_model.fit(docs, labels)
    got = quality_model.score(docs, machine).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert got[0] == got[1]
    assert quality_model.score(docs.limit(0), machine).count() == 0
    assert quality_model.score(docs.drop("n_chars"), machine).count() == 6


def test_labels_of_one_kind_give_a_constant(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality_model.score(docs, quality_model.fit(docs, labels)).collect()} == {0.75}
    assert {r.score for r in quality_model.score(docs, quality_model.fit(docs, labels.limit(0))).collect()} == {0.5}
