"""Merkle manifest of a data set, and versions of it by path copying.

Every row is a leaf; each tree (by default, each language) orders its leaves by id; every
eight consecutive nodes become their digest until one is left, the subroot; the subroots
are the leaves of one more tree, whose last node is the root.

The trees are persistent. A version replaces one leaf: it copies the ancestors of that leaf
and shares all other nodes with the tree it was made from, so a version costs one node a
level. Nodes lie in aligned blocks of 8^4 = 4096 leaves. A block builds its own levels; its
last node is a leaf of the blocks above, built in the same way. The way from a block to the
root (the siblings of its ancestors, a few thousand characters) is then handed down once
for each block, where the versions of its leaves copy their ancestors: first those inside
the block, then those above it. No task holds more than one block and one such way, however
many versions run through an upper node.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import stored

FANOUT = 8
#: Levels of a block: it holds at most 8^4 leaves.
DEPTH = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[str]) -> str:
    """Hex sha256 of the concatenated texts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as ``length:value``, ``-`` if null, so that different rows never read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**instead: Column) -> Column:
    """Digest of the row's fields, some of them replaced."""
    return F.sha2(F.concat(*(field(instead.get(name, F.col(name))) for name in FIELDS)).cast("binary"), 256)


# --- one block -----------------------------------------------------------------------------


class Step(NamedTuple):
    """Siblings of one ancestor: those left and those right of it, as one text each."""

    left: str
    right: str


def build(leaves: list[str], levels: int) -> list[list[str]]:
    """The node digests of a block, level by level from its leaves."""
    out = [leaves]
    for _ in range(levels):
        now = out[-1]
        out.append([digest(now[at : at + FANOUT]) for at in range(0, len(now), FANOUT)])
    return out


def way_up(tree: list[list[str]], index: int) -> list[Step]:
    """The siblings on the way from a leaf of the block to the block's last node."""
    out = []
    for level in tree[:-1]:
        first = index // FANOUT * FANOUT
        out.append(Step("".join(level[first:index]), "".join(level[index + 1 : first + FANOUT])))
        index //= FANOUT
    return out


def copy_path(leaf: str, way: list[Step]) -> list[str]:
    """A version with another leaf: the digests of its copied ancestors; all siblings are shared."""
    out = []
    for step in way:
        leaf = digest([step.left, leaf, step.right])
        out.append(leaf)
    return out


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves = -(-leaves // FANOUT)
        levels += 1
    return levels


# --- blocks in Spark -------------------------------------------------------------------------


def positions(nodes: DataFrame, tree: str, *order: str) -> DataFrame:
    """The rows with ``pos``, their place in their tree by ``order`` (null first), and ``leaves``, its size.

    Rows are sorted by ranges, so neither a tree nor an id is one task; equal rows are
    told apart by an id of their own. Places inside a range are added to the rows of the tree in
    earlier ranges, one row for each tree and range.
    """
    keys = [tree, *order]
    ranked = nodes.withColumn("__row", F.monotonically_increasing_id())
    ranked = ranked.repartitionByRange(*(F.col(k).asc_nulls_first() for k in (*keys, "__row"))).sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in (*keys, "__row")))
    ranked = stored(ranked.drop("__row").withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", 33)), "ordered")
    totals = ranked.groupBy(F.col(tree).alias("__tree"), F.col("__range").alias("__part")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy("__tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "__tree", "__part", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("__tree")).alias("leaves")
    )
    same = F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("__range") == F.col("__part"))
    out = ranked.join(totals, same).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before"))
    return out.drop("__at", "__range", "__tree", "__part", "__first", "__before")


def _sorted(block: pa.Table) -> pa.Table:
    return block.sort_by("pos")


def _levels(block: pa.Table, depth: int) -> list[list[str]]:
    """Node digests of a block, its leaves in order; a tree that ends below its ``depth`` ends there."""
    return build(block.column("digest").to_pylist(), min(depth, height(block.column("leaves")[0].as_py())))


def _rest(above: pa.Table) -> list[Step]:
    return [Step(*s) for s in json.loads(above.column("way")[0].as_py())] if above.num_rows else []


NODE = "tree string, pos long, digest string, leaves long"
WAY = "tree string, block long, way string"


def _blocked(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**depth))


def _tops(nodes: DataFrame, depth: int) -> DataFrame:
    """The last node of every block."""

    def top(block: pa.Table) -> pa.Table:
        block = _sorted(block)
        return pa.table({
            "tree": block.column("tree").slice(0, 1), "pos": block.column("block").slice(0, 1), "digest": pa.array(_levels(block, depth)[-1], pa.string()),
            "leaves": pa.array([-(-block.column("leaves")[0].as_py() // FANOUT**depth)], pa.int64()),
        })

    return _blocked(nodes, depth).groupBy("tree", "block").applyInArrow(top, NODE)


def _ways(nodes: DataFrame, ways: DataFrame, depth: int) -> DataFrame:
    """For every leaf of upper blocks the siblings on its way to the root, given those of the blocks."""

    def down(block: pa.Table, above: pa.Table) -> pa.Table:
        block = _sorted(block)
        tree = _levels(block, depth) if block.num_rows else [[]]
        rest = _rest(above)
        return pa.table({
            "tree": block.column("tree"), "block": block.column("pos"), "way": pa.array([json.dumps(way_up(tree, i) + rest) for i in range(block.num_rows)], pa.string())
        })

    return _blocked(nodes, depth).groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInArrow(down, WAY)


def build_levels(leaves: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """(nodes that are leaves of blocks, stage by stage upwards; last node of each tree) of ``leaves`` (tree, pos, digest, leaves)."""
    stages = []
    now = leaves
    while True:
        stages.append(now)
        # A tree that ended further down goes on as one node, which is its own last one.
        now = stored(_tops(now, depth), "tops")
        if now.filter("leaves > 1").limit(1).count() == 0:
            return stages, now


def hand_down(stages: list[DataFrame], ways: DataFrame, depth: int) -> DataFrame:
    """(tree, block, way): the siblings from each leaf of the last stage to the root.

    Stages are given from the top; ``ways`` holds those of the last node of each tree.
    """
    for nodes in stages:
        ways = stored(_ways(nodes, ways, depth), "ways")
    return ways


class Manifest(NamedTuple):
    """``leaves``: the given rows with pos and leaves; ``subroots``: tree, pos among the trees, digest;
    ``root``: one row; ``ways``: tree, block, siblings of the block's ancestors; blocks have 8^``depth`` leaves."""

    leaves: DataFrame
    subroots: DataFrame
    root: DataFrame
    ways: DataFrame
    depth: int


ONE_TREE = ""


def build_manifest(leaves: DataFrame, *order: str, depth: int = DEPTH) -> Manifest:
    """Trees over rows (tree, digest, ...), each ordered by ``order``, and the tree over their subroots."""
    placed = stored(positions(leaves, "tree", *order), "leaves")
    stages, tops = build_levels(placed.select("tree", "pos", "digest", "leaves"), depth)
    named = tops.select(F.lit(ONE_TREE).alias("__all"), F.col("tree").alias("name"), "digest")
    subroots = stored(positions(named, "__all", "name"), "subroots")
    upper, root = build_levels(subroots.select(F.col("__all").alias("tree"), "pos", "digest", "leaves"), depth)
    ways = hand_down(upper[::-1], leaves.sparkSession.createDataFrame([], WAY), depth)
    of_subroots = subroots.select(F.col("name").alias("tree"), "pos").join(ways.select(F.col("block").alias("pos"), "way"), "pos")
    of_subroots = of_subroots.select("tree", F.lit(0).cast("long").alias("block"), "way")
    return Manifest(placed, subroots.select(F.col("name").alias("tree"), "pos", "digest"), root.select("digest"), hand_down(stages[:0:-1], of_subroots, depth), depth)


COPIES = "id long, leaf string, subroot string, proof_sha256 string, ancestors array<string>, changed string"


def versions(manifest: Manifest) -> DataFrame:
    """One row per leaf: id, leaf, subroot, proof_sha256 (digest of its siblings up to the root), and the
    ancestors that the version with its ``changed`` digest copies, from the lowest to the root."""
    names = [f.split()[0] for f in COPIES.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    depth = manifest.depth

    def copy(block: pa.Table, above: pa.Table) -> pa.Table:
        if block.num_rows == 0:
            return pa.table([pa.array([], t) for t in types], names)
        block = _sorted(block)
        base, rest = _levels(block, depth), _rest(above)
        proofs, copies = [], []
        for i, leaf in enumerate(block.column("changed").to_pylist()):
            way = way_up(base, i) + rest
            proofs.append(digest([text for step in way for text in step]))
            copies.append(copy_path(leaf, way))
        untouched = [base[0][0], *copy_path(base[0][0], way_up(base, 0) + rest)]
        subroot = untouched[height(block.column("leaves")[0].as_py())]
        return pa.table([
            block.column("id"), block.column("digest"), pa.array([subroot] * block.num_rows, types[2]), pa.array(proofs, types[3]), pa.array(copies, types[4]), block.column("changed"),
        ], names)

    rows = _blocked(manifest.leaves.select("tree", "pos", "id", "digest", "leaves", "changed"), depth)
    return rows.groupBy("tree", "block").cogroup(manifest.ways.groupBy("tree", "block")).applyInArrow(copy, COPIES)


def verify_documents(docs: DataFrame, modulus: int = 3, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    Where ``modulus`` divides the crc32 of the decimal doc_id, the row is tampered with: the
    letters A-Z of its text become lower case; it verifies only if that changes nothing. Nulls
    in any column are marked as such in the leaf; a null lang is a tree of its own, the
    first; a row with a null doc_id comes first in its tree and is never tampered with. Rows of one doc_id are
    ordered by their leaf; repeated rows stand side by side. An empty table gives no rows. Other
    columns are not read.
    """
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus == 0
    lowered = F.translate("text", UPPER, LOWER)
    leaf = leaf_digest()
    rows = docs.select(
        F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf.alias("digest"),
        F.when(tampered, leaf_digest(text=lowered)).otherwise(leaf).alias("changed"),
    )
    manifest = build_manifest(stored(rows, "digests"), "id", "digest", depth=depth)
    built = manifest.root.first()
    root = F.lit(built.digest if built else None).cast("string")
    folded = F.coalesce(F.try_element_at("ancestors", F.lit(-1)), "changed")
    return versions(manifest).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", folded.alias("folded_root"), (folded == root).alias("verified")
    )


#: The same manifest in SQL, level by level.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM documents
), f AS (
  SELECT rid, doc_id, tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) AS crc
  FROM d
), leaf AS (
  SELECT rid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS changed
  FROM f
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaf
), node AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 7) // 8) FROM node WHERE n > 1 GROUP BY tree, level, idx // 8
), sub AS (
  SELECT tree, level AS h, digest AS subroot, count(*) OVER () AS n FROM node WHERE n = 1
), upper AS (
  SELECT 0 AS level, tree AS idx, subroot AS digest, n FROM sub
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 7) // 8) FROM upper WHERE n > 1 GROUP BY level, idx // 8
), step AS (
  SELECT p.rid, s.level AS k, string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < p.idx // (8 ** s.level)::BIGINT) AS before,
    string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > p.idx // (8 ** s.level)::BIGINT) AS after
  FROM placed p JOIN node s ON s.tree = p.tree AND s.n > 1 AND s.idx // 8 = p.idx // (8 ** (s.level + 1))::BIGINT
  GROUP BY p.rid, s.level
  UNION ALL
  SELECT p.rid, any_value(b.h) + s.level, string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < p.tree // (8 ** s.level)::BIGINT),
    string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > p.tree // (8 ** s.level)::BIGINT)
  FROM placed p JOIN sub b ON b.tree = p.tree JOIN upper s ON s.n > 1 AND s.idx // 8 = p.tree // (8 ** (s.level + 1))::BIGINT
  GROUP BY p.rid, s.level
), fold AS (
  SELECT rid, 0 AS k, changed AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(coalesce(before, '') || f.digest || coalesce(after, '')) FROM fold f JOIN step s ON s.rid = f.rid AND s.k = f.k
), proof AS (
  SELECT rid, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY k)) AS proof_sha256 FROM step GROUP BY rid
)
SELECT p.doc_id, p.leaf, b.subroot, u.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, x.digest AS folded_root, x.digest = u.digest AS verified
FROM placed p JOIN sub b ON b.tree = p.tree JOIN upper u ON u.n = 1 LEFT JOIN proof q ON q.rid = p.rid
JOIN (SELECT rid, max_by(digest, k) AS digest FROM fold GROUP BY rid) x ON x.rid = p.rid
"""
