"""Merkle manifest of a dataset: a tree of hashes a group, and one over the groups, in blocks laid out after van Emde Boas.

A node is the hash of up to eight consecutive nodes below it. Trees are cut into aligned blocks of four levels (4,096
leaves), each built by one task; the roots of a level's blocks are the leaves of the next level's blocks, up to one
block. Within a block the nodes lie in the order of a tree split at half its height: the top half first, then each lower
half, either split again. So construction and a leaf's siblings touch few stretches of memory, whatever the cache.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._shared import written

ARITY = 8  #: nodes that one hash covers
HEIGHT = 4  #: levels between a block's leaves and its root
BLOCK = ARITY**HEIGHT
DIGEST = 32  #: bytes of a node
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*values: Column) -> Column:
    """Hex sha256 of the values in order: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    coded = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*coded), 256)


def nodes_of(levels: int) -> int:
    """Nodes of a full tree with so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of ``depth`` (0: the root) in a full tree with so many levels of nodes.

    The top half of the levels comes first, then the subtrees below it from left to right, each laid out alike.
    """
    base = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = ARITY ** (depth - top)
        base += nodes_of(top) + (index // below) * nodes_of(levels - top)
        index, depth, levels = index % below, depth - top, levels - top
    return base


@lru_cache(maxsize=64)
def _places(levels: int) -> list[np.ndarray]:
    """For each depth the places of all its nodes; at most five levels of blocks are asked for."""
    return [address(levels, d, np.arange(ARITY**d)) for d in range(levels)]


def _hash(run: np.ndarray) -> bytes:
    return hashlib.sha256(run.tobytes().hex().encode()).digest()


def height_of(n: int) -> int:
    """Levels between the leaves and the root of a tree of ``n`` leaves."""
    h = 0
    while n > ARITY**h:
        h += 1
    return h


def build_block(digests: np.ndarray, height: int) -> np.ndarray:
    """Nodes (places x 32 bytes) of a block over its leaves (n x 32); places without a node hold zeros."""
    nodes = np.zeros((nodes_of(height + 1), DIGEST), np.uint8)
    row = digests
    for depth in range(height, -1, -1):
        nodes[_places(height + 1)[depth][: len(row)]] = row
        if depth:
            row = np.stack([np.frombuffer(_hash(row[i : i + ARITY]), np.uint8) for i in range(0, len(row), ARITY)])
    return nodes


def siblings(nodes: np.ndarray, height: int, n: int, at: int) -> list[tuple[int, bytes]]:
    """From the leaf ``at`` upwards: its place in its run, and the run's other nodes, read from the block's layout."""
    path = []
    for depth in range(height, 0, -1):
        first = at - at % ARITY
        run = nodes[_places(height + 1)[depth][first : min(first + ARITY, n)]].tobytes()
        cut = (at - first) * DIGEST
        path.append((at - first, run[:cut] + run[cut + DIGEST :]))
        at, n = at // ARITY, -(-n // ARITY)
    return path


def leaves_of(nodes: np.ndarray, height: int, n: int) -> bytes:
    return nodes[_places(height + 1)[height][:n]].tobytes()


def coded(path: list[tuple[int, bytes]]) -> bytes:
    """A path as bytes: for each level the place in the run, the number of siblings and the siblings."""
    return b"".join(bytes((place, len(others) // DIGEST)) + others for place, others in path)


def proof_hash(path: bytes) -> tuple[str, list[tuple[int, bytes]]]:
    """Hash of all siblings of a coded path, and its levels."""
    levels, at = [], 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        levels.append((place, path[at + 2 : at + 2 + n * DIGEST]))
        at += 2 + n * DIGEST
    return hashlib.sha256("".join(s.hex() for _, s in levels).encode()).hexdigest(), levels


def fold(digest: bytes, levels: list[tuple[int, bytes]]) -> str:
    """The root that a leaf and its siblings give."""
    for place, others in levels:
        cut = place * DIGEST
        digest = hashlib.sha256((others[:cut] + digest + others[cut:]).hex().encode()).digest()
    return digest.hex()


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their position (from 0) in their ``tree`` by ``order``, nulls first, and the tree's number of rows.

    Rows are sorted by ranges of (tree, order), so one tree spreads over many tasks; only counts a range and tree are
    summed over the ranges. ``rows`` should be a written table, as the ranges are sampled from it.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ranges = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)), name)
    counts = ranges.groupBy("tree", "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    starts = counts.select("tree", "_range", "_first", before.alias("_start"), F.sum("_n").over(tree).alias("n"))
    placed = ranges.join(starts.hint("merge"), ["tree", "_range"])
    return placed.withColumn("pos", F.col("_start") + F.col("_id") - F.col("_first")).drop("_id", "_range", "_first", "_start")


_BLOCKS = "tree string, block long, height int, n long, total long, ids array<string>, claims binary, nodes binary, root binary"


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas function: the rows of one block (4,096 at most) -> the block."""
    pdf = pdf.sort_values("pos")
    total = int(pdf["n"].iloc[0])
    height = min(HEIGHT, height_of(total))
    nodes = build_block(np.frombuffer(b"".join(pdf["digest"]), np.uint8).reshape(-1, DIGEST), height)
    claims = b"".join(d if c is None else c for c, d in zip(pdf["claim"], pdf["digest"], strict=True))
    one = {"tree": pdf["tree"].iloc[0], "block": pdf["block"].iloc[0], "height": height, "n": len(pdf), "total": total, "ids": list(pdf["id"])}
    return pd.DataFrame([one | {"claims": claims, "nodes": nodes.tobytes(), "root": nodes[0].tobytes()}])


def build(rows: DataFrame, name: str = "manifest") -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each level, and (tree, root) of each tree, over rows (tree, pos, n, id, digest, claim)."""
    levels = []
    while True:
        # A nullable integer would come to pandas as a double: ids travel as text.
        keyed = rows.select("tree", "pos", "n", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), F.col("id").cast("string").alias("id"), "digest", "claim")
        blocks = written(keyed.groupBy("tree", "block").applyInPandas(_built, _BLOCKS), f"{name}-level-{len(levels)}")
        levels.append(blocks)
        # One number a level comes to the driver: whether some tree still has several blocks.
        if (blocks.agg(F.max("block")).first()[0] or 0) == 0:
            return levels, _roots(levels)
        above = F.ceil(F.col("total") / BLOCK).cast("long")
        rows = blocks.filter(F.col("total") > BLOCK).select("tree", F.col("block").alias("pos"), above.alias("n"), F.lit(None).cast("string").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("claim"))


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, root): of each tree the root of the last level that has it."""
    tops = None
    for k, blocks in enumerate(levels):
        own = blocks.filter("block = 0").select("tree", F.lit(k).alias("level"), "root")
        tops = own if tops is None else tops.union(own)
    return tops.groupBy("tree").agg(F.max_by("root", "level").alias("root"))


_PATHS = "tree string, pos long, path binary, extra binary"
_PROOFS = "tree string, id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _opened(pdf: pd.DataFrame):
    """A block's row, its nodes and the path of each of its leaves."""
    r = pdf.iloc[0]
    nodes = np.frombuffer(r["nodes"], np.uint8).reshape(-1, DIGEST)
    height, n, above = int(r["height"]), int(r["n"]), r["path"] or b""
    return r, leaves_of(nodes, height, n), [coded(siblings(nodes, height, n, at)) + above for at in range(n)]


def _down(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas function: a block with the path above its root -> the path above each leaf."""
    r, _, paths = _opened(pdf)
    return pd.DataFrame({"tree": r["tree"], "pos": r["block"] * BLOCK + np.arange(len(paths)), "path": paths, "extra": [r["extra"]] * len(paths)})


def _group_paths(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas function: a block of the tree of groups -> for each group its path, and its root with the whole root."""
    r, leaves, paths = _opened(pdf)
    return pd.DataFrame({"tree": list(r["ids"]), "pos": 0, "path": paths, "extra": [leaves[i * DIGEST : (i + 1) * DIGEST] + r["extra"] for i in range(len(paths))]})


def _proved(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas function: a block with the path above its root -> for each leaf what its proof gives."""
    r, leaves, paths = _opened(pdf)
    subroot, root, out = r["extra"][:DIGEST].hex(), r["extra"][DIGEST:].hex(), []
    for at, (doc, path) in enumerate(zip(r["ids"], paths, strict=True)):
        proof, levels = proof_hash(path)
        part = slice(at * DIGEST, (at + 1) * DIGEST)
        folded = fold(r["claims"][part], levels)
        out.append((r["tree"], doc, leaves[part].hex(), subroot, root, proof, folded, folded == root))
    return pd.DataFrame(out, columns=["tree", "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _paths(levels: list[DataFrame], tops: DataFrame, name: str, last, schema: str) -> DataFrame:
    """What ``last`` makes of the lowest blocks and the path above their root; ``tops`` has the path above each tree's."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        # A tree's top block takes the tree's path, the others that of a leaf one level up.
        met = levels[k].filter(F.col("total") <= BLOCK).join(tops.hint("merge"), "tree").select(*levels[k].columns, "path", "extra")
        if above is not None:
            lower = levels[k].join(above.withColumnRenamed("pos", "block").hint("merge"), ["tree", "block"])
            met = met.unionByName(lower.select(*levels[k].columns, "path", "extra"))
        # One block a call, so that a task holds one at a time.
        blocks = met.groupBy("tree", "block")
        if k == 0:
            return blocks.applyInPandas(last, schema)
        above = written(blocks.applyInPandas(_down, _PATHS), f"{name}-paths-{k}")


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS, claimed: Column | None = None, name: str = "manifest") -> DataFrame:
    """A row for each row of ``docs``: tree (the group, with ``+`` before it, or empty for null), id (as text), leaf,
    subroot (the group's root), root, proof_sha256 (hash of all siblings up to the root), folded_root (what ``claimed``,
    by default the leaf, and the siblings give) and verified (whether that is the root).

    The leaf hashes ``columns``; ``claimed`` is a hex digest a row, for instance of a copy that may have been changed
    (null: the leaf). Leaves are ordered by the id, null first, then by their digest, so repeated rows are leaves of equal
    digest. A null group is a tree of its own, the first; without siblings the proof is the hash of nothing; an empty
    table gives an empty result. Other columns are not read. Texts are hashed where they are read; only ids and digests
    are moved.
    """
    tree = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    own = leaf(*[F.col(f"`{c}`") for c in columns])
    claim = F.lit(None).cast("binary") if claimed is None else F.unhex(claimed)
    leaves = written(docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), F.unhex(own).alias("digest"), claim.alias("claim")), f"{name}-leaves")
    levels, roots = build(ranked(leaves, ["id", "digest"], f"{name}-ranks"), name)
    # The groups' roots are the leaves of one more tree, whose ids are the groups.
    subroots = written(roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("claim")), f"{name}-subroots")
    upper, top = build(ranked(subroots, ["id"], f"{name}-group-ranks"), f"{name}-groups")
    head = top.select("tree", F.lit(None).cast("binary").alias("path"), F.col("root").alias("extra"))
    groups = written(_paths(upper, head, f"{name}-groups", _group_paths, _PATHS).drop("pos"), f"{name}-group-paths")
    return _paths(levels, groups, name, _proved, _PROOFS)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = leaf(*[folded if c == "text" else F.col(c) for c in COLUMNS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proofs = manifest(docs, claimed=F.when(chosen, other))
    return proofs.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP12_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), told AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 3 = 0 AS chosen
  FROM documents, crc
), hashed AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN chosen THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM told
), leaves AS (
  SELECT doc_id, tree, leaf, coalesce(changed, leaf) AS claim, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS d, n FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n
), subroots AS (
  SELECT tree, level AS height, d AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, subroot AS d, n FROM subroots
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, pos // 8, n
), steps AS (
  SELECT l.tree, l.pos, x.level, string_agg(x.d, '' ORDER BY x.pos) FILTER (x.pos < l.pos // (8 ** x.level)::BIGINT) AS before, string_agg(x.d, '' ORDER BY x.pos) FILTER (x.pos > l.pos // (8 ** x.level)::BIGINT) AS behind
  FROM leaves l JOIN nodes x ON x.tree = l.tree AND x.n > 1 AND x.pos // 8 = l.pos // (8 ** (x.level + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT l.tree, l.pos, s.height + x.level, string_agg(x.d, '' ORDER BY x.pos) FILTER (x.pos < s.pos // (8 ** x.level)::BIGINT), string_agg(x.d, '' ORDER BY x.pos) FILTER (x.pos > s.pos // (8 ** x.level)::BIGINT)
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN upper x ON x.n > 1 AND x.pos // 8 = s.pos // (8 ** (x.level + 1))::BIGINT GROUP BY l.tree, l.pos, s.height, x.level
), folds AS (
  SELECT tree, pos, 0 AS level, claim AS d FROM leaves
  UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(coalesce(s.before, '') || f.d || coalesce(s.behind, '')) FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level
), proofs AS (
  SELECT tree, pos, sha256(string_agg(coalesce(before, '') || coalesce(behind, ''), '' ORDER BY level)) AS proof FROM steps GROUP BY ALL
)
SELECT l.doc_id, l.leaf, s.subroot, r.d AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN (SELECT d FROM upper WHERE n = 1) r ON true
JOIN (SELECT tree, pos, max_by(d, level) AS d FROM folds GROUP BY ALL) f ON f.tree = l.tree AND f.pos = l.pos
LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
"""
