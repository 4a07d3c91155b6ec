"""Near-duplicate groups by a chosen-path set similarity join over minwise tokens.

1. One pass over the texts gives each document's number of shingles, a 128-bit fingerprint of its shingle set and a
   signature of minwise tokens. Documents with equal sets form a class; only one row a class goes on.
2. In several independent trees, classes branch by a few randomly chosen positions of the signature: a node's children
   hold the classes that agree on the minwise token there. A pair whose similarity is the threshold meets in one child
   on average. Nodes of at most ``LEAF`` classes stop and are compared exhaustively by signature; larger ones branch on,
   unless a branch took hardly any away: such a node is one large group of near copies and is compared in blocks.
3. What agrees well enough there forms coarse groups. Whole texts are fetched for these groups only, and every pair of
   a group is decided on its full shingle sets. Groups of any size are dealt in blocks, so that each task holds two
   blocks at most; a task returns a spanning forest of its links, never all pairs.
4. Connected components over these links, which never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from leafmill.llm._shared import written
from leafmill.llm.components import connected_components

SHINGLE = 5
THRESHOLD_PERCENT = 80
POSITIONS = 64  #: minwise tokens in a signature
TREES = 9
LEVELS = 6
LEAF = 48
DENSE = 0.6  #: a child that keeps more of its node than this is alike throughout: branching ends
BLOCK = 192  #: texts in a task of full sets
WIDE = 512  #: classes in a block of a node that stays large
#: Signatures that agree on fewer positions than this share of the threshold, less five standard deviations, are not fetched.
SIGMAS = 5.0

_U = np.uint64
_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(32))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z are lower-cased, words end at ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, _U)
    w = np.fromiter(map(xxh3_64_intdigest, found), _U, len(found))
    place = _PLACE if size == SHINGLE else np.random.default_rng(size).integers(1, 2**63, size, dtype=np.uint64) * _U(2) + _U(1)
    n = min(size, len(w))
    h = w[: len(w) - n + 1] * place[0]
    for j in range(1, n):
        h += w[j : len(w) - n + 1 + j] * place[j]  # the words' hashes are mixed already; the odd factors tell places apart
    return np.unique(_mix(h + _U(n)))


def signature(shingles: np.ndarray) -> bytes:
    """The smallest of each of ``POSITIONS`` hashes over a set, 32 bits each."""
    low = np.full(POSITIONS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        low = np.minimum(low, ((part[None, :] * _MULT[:, None] + _ADD[:, None]) >> _U(32)).min(axis=1))
    return low.astype("<u4").tobytes()


def _sketches(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingle_set(text, size)
                if len(s):
                    mixed = _mix(s + _U(0x5851F42D4C957F2D))
                    out.append((key, len(s), int(s.sum(dtype=_U).view(np.int64)), int(mixed.sum(dtype=_U).view(np.int64)), signature(s)))
                else:
                    out.append((key, 0, 0, 0, None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return run


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of a stream that is sorted by ``key``, each whole."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        k = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            part = pdf.iloc[at:to]
            if held and held[-1][key].iloc[0] != part[key].iloc[0]:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as (member, root) pairs, of the graph with this symmetric boolean matrix."""
    n, left, out = len(linked), np.ones(len(linked), bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            new = linked[front].any(axis=0) & left
            left &= ~new
            front = list(np.flatnonzero(new))
            out += [(i, root) for i in front]
    return out


def _compare_signatures(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for g in _groups(batches, "node"):
            if len(g) < 2:
                continue
            sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(len(g), POSITIONS)
            agree = np.zeros((len(g), len(g)), np.int16)
            for j in range(POSITIONS):
                agree += sig[:, j, None] == sig[None, :, j]
            keys = g["rep"].to_numpy()
            for i, root in forest(agree >= least):
                a.append(keys[i])
                b.append(keys[root])
            if len(a) > 20_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix: 100 * |A and B| >= percent * |A or B|, decided on the whole sets in integers."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if n else np.empty(0, _U)
    owner = np.repeat(np.arange(n), sizes)
    _, token, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[token]
    owner, token = owner[use], column[token[use]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    columns = int(token[-1]) + 1 if len(token) else 0
    width = min(columns, max(256, 4_000_000 // max(1, n)))
    for at in range(0, columns, max(1, width)):
        lo, hi = np.searchsorted(token, [at, at + width])
        x = np.zeros((n, width), np.float32)
        x[owner[lo:hi], token[lo:hi] - at] = 1
        both += x @ x.T
    inter = both.astype(np.int64)
    np.fill_diagonal(inter, 0)
    return (inter > 0) & (100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter))


def _verify(size: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, "task"):
            if len(g) < 2:
                continue
            keys = g["rep"].to_numpy()
            # Larger groups arrive as pairs of blocks, of which each text is a part once.
            found = forest(exact_links([shingle_set(t, size) for t in g["text"]], percent))
            yield pd.DataFrame({"a": np.array([keys[i] for i, _ in found], np.int64), "b": np.array([keys[r] for _, r in found], np.int64)})

    return run


def _branches(node: Column, sig: Column, level: int, percent: int) -> Column:
    """The children of a node that a class goes to: on average 100 / percent positions, the same for all its classes."""
    share = round(1000 * (100 / percent - 1))
    first = F.pmod(F.xxhash64(node, F.lit(f"first{level}")), F.lit(POSITIONS))
    second = F.pmod(F.xxhash64(node, F.lit(f"second{level}")), F.lit(POSITIONS))
    twice = F.pmod(F.xxhash64(node, F.lit(f"twice{level}")), F.lit(1000)) < share

    def child(at: Column) -> Column:
        return F.xxhash64(node, at, F.substring(sig, at * 4 + 1, F.lit(4)))

    return F.when(twice & (first != second), F.array(child(first), child(second))).otherwise(F.array(child(first)))


def coarse_links(classes: DataFrame, percent: int, trees: int = TREES, levels: int = LEVELS, leaf: int = LEAF) -> DataFrame:
    """Pairs (a, b) of class representatives that meet in a small node and whose signatures agree well enough."""
    rate = percent / 100
    least = max(1, int(np.floor(POSITIONS * (rate - SIGMAS * np.sqrt(rate * (1 - rate) / POSITIONS)))))
    nodes = classes.select("rep", "sig", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
    nodes = nodes.select("rep", F.explode(_branches(F.xxhash64("tree"), F.col("sig"), 0, percent)).alias("node"), F.lit(None).cast("long").alias("above"))
    leaves = None
    for level in range(1, levels + 1):
        nodes = written(nodes, f"dedup-level{level}")
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("node", "_node")
        sized = nodes.join(sizes, F.col("node") == F.col("_node")).select("rep", "node", "n", "above")
        ends = (F.col("n") <= leaf) | F.coalesce(F.col("n") > DENSE * F.col("above"), F.lit(False)) | F.lit(level == levels)
        small = sized.filter(ends).select("rep", "node", "n")
        leaves = small if leaves is None else leaves.union(small)
        large = written(sized.filter(~ends).select("rep", "node", "n"), f"dedup-large{level}")
        if level == levels or large.isEmpty():
            break
        nodes = large.join(classes, "rep").select("rep", F.explode(_branches(F.col("node"), F.col("sig"), level, percent)).alias("node"), F.col("n").alias("above"))
    # Nodes that stayed large are compared block against block.
    blocks = F.ceil(F.col("n") / WIDE).cast("int")
    blocked = leaves.select("rep", "node", F.when(F.col("n") <= WIDE, F.lit(1)).otherwise(blocks).alias("k"))
    blocked = _dealt(blocked, "node").select("rep", F.col("task").alias("node"))
    rows = blocked.join(classes, "rep").repartition("node").sortWithinPartitions("node")
    return rows.select("node", "rep", "sig").mapInPandas(_compare_signatures(least), "a long, b long")


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """Adds ``task``: one a group of k = 1 block, else one for each pair of its k blocks; a row goes to k tasks."""
    own = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
    one = F.array(F.xxhash64(F.col(group), F.lit(-1), F.lit(-1)))
    many = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.xxhash64(F.col(group), F.least(own, o), F.greatest(own, o)))
    return rows.withColumn("task", F.explode(F.when(F.col("k") == 1, one).otherwise(many)))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    percent: int = THRESHOLD_PERCENT,
    shingle: int = SHINGLE,
    trees: int = TREES,
    levels: int = LEVELS,
    leaf: int = LEAF,
    block: int = BLOCK,
) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id (smallest id that links reach), kept.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of word shingles; links are
    confirmed on the full sets (64-bit hashes of shingles). A text of fewer words than a shingle is one shingle. Null,
    empty and blank texts have n_shingles 0 and link with nothing. Repeated rows and repeated texts fall into one
    class and need no pairs. Rows with a null id keep a null component and are not kept. Other columns are not read.
    A pair at the threshold that no tree brings together would be missed: below 1 in 10,000 where nodes are small after
    the first or second branching, as usual; about 5, 18 and 96 in 10,000 at a depth of 3, 4 and 6, which only texts
    reach nearly all of whose minwise tokens are shared by more than ``leaf`` classes.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sketches = source.mapInPandas(_sketches(shingle), "doc_id long, n_shingles long, set_a long, set_b long, sig binary")
    sketches = written(sketches, "dedup-sketches")
    full = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "dedup-classes")
    coarse = connected_components(coarse_links(classes.select("rep", "sig"), percent, trees, levels, leaf), "dedup-coarse")
    sizes = coarse.groupBy("component").agg(F.count("*").alias("n")).withColumnRenamed("component", "_component")
    coarse = coarse.join(sizes, F.col("component") == F.col("_component"))
    blocks = F.when(F.col("n") <= block, F.lit(1)).otherwise(F.ceil(F.col("n") / F.lit(block // 2)).cast("int"))
    wanted = coarse.select(F.col("node").alias("rep"), "component", blocks.alias("k"))
    # Merge join at every size: the groups grow with the corpus, so they aren't broadcast where they happen to be few.
    texts = source.join(wanted.hint("merge"), F.col("doc_id") == F.col("rep")).select("doc_id", "rep", "component", "k", "text")
    texts = texts.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"])  # repeated rows
    tasks = _dealt(texts, "component").select("task", "rep", "text")
    links = tasks.repartition("task").sortWithinPartitions("task").mapInPandas(_verify(shingle, percent), "a long, b long")
    classes_of = connected_components(links, "dedup-links").withColumnRenamed("node", "_rep")
    named = classes.select("set_a", "set_b", "rep").join(classes_of, F.col("rep") == F.col("_rep"), "left")
    named = named.select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.coalesce("component", "rep").alias("_component"))
    met = (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")) & (F.col("n_shingles") > 0)
    joined = sketches.join(named, met, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each near-duplicate group: the row of ``docs`` whose id is its component's smallest.

    Documents without a shingle are groups of their own. Of rows that repeat a kept id one stays; rows with a null id go.
    Columns are those of ``docs``.
    """
    groups = written(near_duplicates(docs, id_col, text_col, **options), "dedup-groups")
    kept = groups.filter("kept").groupBy("doc_id").agg(F.count("*").alias("_n")).withColumnRenamed("doc_id", "_kept_id")
    met = docs.join(kept.select("_kept_id").hint("merge"), F.col(f"`{id_col}`").cast("long") == F.col("_kept_id"), "left_semi")
    # Texts are sorted to single out repeated ids only where there are any.
    return met if kept.filter("_n > 1").isEmpty() else met.dropDuplicates([id_col])


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
