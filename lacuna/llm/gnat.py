"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

Vectors become integers, ``floor(scale * x)``, so that scores, inner products, are exact.
An inner node of the tree holds split points; a row belongs to the nearest one. The tree is
fitted on a bounded sample, but every row is sent through it, and each split point keeps the
smallest and largest distance from it to the rows below every sibling, over all rows.

A search asks for the k best rows with scores in windows. With the squared lengths of the
rows below a node a window is an annulus of distances around the asking vector. By the
triangle inequality the ranges of every split point bound the distance from the asking vector to
the rows below each sibling; a sibling whose bounds miss the annuli of all windows is left
out with everything below. A first visit to the nearest leaves gives k-th scores that narrow
the windows for the second, which visits every leaf that is left. Leaves are compared
exactly, so the result is that of a full comparison whatever the sample was.

Leaves are groups that Spark forms: a large one is dealt out in blocks, its asking vectors
in chunks, and each pair of a block and a chunk is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import discard, stored

LEAST, MOST = -(2**63), 2**63 - 1
#: Inner products below this are exact in double precision.
EXACT = 2.0**53


# --- vectors ---------------------------------------------------------------------------------


def encode(x: np.ndarray) -> list[bytes]:
    """Integer-valued rows as bytes: two bytes a component where that is enough, eight elsewhere."""
    small = np.abs(x).max(axis=1, initial=0) < 2**15
    short = np.where(small[:, None], x, 0).astype(np.int16)
    return [s.tobytes() if ok else r.tobytes() for s, r, ok in zip(short, np.ascontiguousarray(x, float), small, strict=True)]


def decode(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), dim))
    for width, kind in ((2, np.int16), (8, np.float64)):
        at = [i for i, b in enumerate(raw) if len(b) == width * dim]
        if at and dim:
            out[at] = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), dim)
    return out


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as long integers; those beyond the range of a long are its ends."""
    top = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(1, a.shape[1])
    if top < EXACT:
        return (a @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in a], object).reshape(a.shape), np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    out = [[min(max(sum(map(int.__mul__, r, s), 0), LEAST), MOST) for s in whole[1]] for r in whole[0]]
    return np.array(out, np.int64).reshape(len(a), len(x))


def lengths(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(lengths(x)[:, None] + lengths(pivots) - 2 * (x @ pivots.T), 0))


# --- the tree --------------------------------------------------------------------------------


class Node:
    """Split points, where their rows go (an inner node, or -1 - leaf), and the ranges from each point to each sibling."""

    def __init__(self, pivots: np.ndarray) -> None:
        m = len(pivots)
        self.pivots, self.children = pivots, [0] * m
        self.lo, self.hi = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        self.short, self.long = np.full(m, np.inf), np.full(m, -np.inf)


class Tree(NamedTuple):
    nodes: list[Node]
    leaves: int


def split_points(x: np.ndarray, fanout: int, rng: np.random.Generator) -> np.ndarray:
    """Distinct rows far from each other: of three times as many, each the one farthest from those taken."""
    some = np.unique(x[rng.choice(len(x), min(len(x), 3 * fanout), replace=False)], axis=0)
    taken = [0]
    near = distances(some, some[:1])[:, 0]
    while len(taken) < min(fanout, len(some)):
        taken.append(int(near.argmax()))
        near = np.minimum(near, distances(some, some[taken[-1:]])[:, 0])
    return some[taken]


def fit(sample: np.ndarray, most: float, fanout: int = 16, seed: int = 12) -> Tree:
    """A tree whose leaves hold at most ``most`` rows of the sample, as far as the rows differ."""
    rng = np.random.default_rng(seed)
    nodes: list[Node] = []
    leaves = 0

    def grow(x: np.ndarray) -> int:
        nonlocal leaves
        if len(x) > max(most, 1):
            pivots = split_points(x, fanout, rng)
            # A sample of candidates that are all equal does not part the rows.
            if len(pivots) > 1:
                at = len(nodes)
                nodes.append(Node(pivots))
                child = distances(x, pivots).argmin(1)
                nodes[at].children = [grow(x[child == j]) for j in range(len(pivots))]
                return at
        leaves += 1
        return -leaves

    grow(sample)
    return Tree(nodes, leaves)


def descend(tree: Tree, x: np.ndarray, seen: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
    """The leaf of each row; ``seen`` is told of the rows, distances and choices at every node."""
    leaf = np.zeros(len(x), int)
    todo = [(0, np.arange(len(x)))] if tree.nodes else []
    while todo:
        at, rows = todo.pop()
        d = distances(x[rows], tree.nodes[at].pivots)
        child = d.argmin(1)
        if seen:
            seen(at, rows, d, child)
        for j in np.unique(child):
            to, below = tree.nodes[at].children[j], rows[child == j]
            if to < 0:
                leaf[below] = -1 - to
            else:
                todo.append((to, below))
    return leaf


def widen(tree: Tree, x: np.ndarray) -> None:
    """Let the ranges of the tree cover the rows."""
    size = lengths(x)

    def seen(at: int, rows: np.ndarray, d: np.ndarray, child: np.ndarray) -> None:
        node = tree.nodes[at]
        for j in np.unique(child):
            mine = child == j
            node.lo[:, j] = np.minimum(node.lo[:, j], d[mine].min(0))
            node.hi[:, j] = np.maximum(node.hi[:, j], d[mine].max(0))
            node.short[j] = min(node.short[j], size[rows[mine]].min())
            node.long[j] = max(node.long[j], size[rows[mine]].max())

    descend(tree, x, seen)


def reachable(tree: Tree, a: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which leaves may hold a row with a score in one of an asking vector's windows, and how far their split point is.

    ``lows`` and ``highs`` have one column per window; a window with low > high is empty.
    """
    alive = np.zeros((len(a), tree.leaves), bool)
    far = np.full((len(a), tree.leaves), np.inf)
    if not tree.nodes:
        alive[:, 0] = (lows <= highs).any(1)
        return alive, np.where(alive, 0.0, np.inf)
    size = lengths(a)
    todo = [(0, np.arange(len(a)))]
    while todo:
        at, asks = todo.pop()
        node = tree.nodes[at]
        d = distances(a[asks], node.pivots)
        for j, to in enumerate(node.children):
            if node.short[j] > node.long[j]:
                continue
            # Distances are exact up to rounding; the slack covers it.
            slack = 1e-6 * (1 + np.sqrt(size[asks]) + np.sqrt(node.long[j]))
            nearest = np.maximum(node.lo[:, j] - d, d - node.hi[:, j]).max(1) - slack
            farthest = (node.hi[:, j] + d).min(1) + slack
            inner = size[asks, None] + node.short[j] - 2 * highs[asks]
            outer = size[asks, None] + node.long[j] - 2 * lows[asks]
            meets = (nearest[:, None] <= np.sqrt(np.maximum(outer, 0)) + slack[:, None]) & (farthest[:, None] >= np.sqrt(np.maximum(inner, 0)) - slack[:, None])
            ok = (meets & (outer >= -(slack**2)[:, None]) & (lows[asks] <= highs[asks])).any(1)
            if to < 0:
                alive[asks[ok], -1 - to] = True
                far[asks[ok], -1 - to] = d[ok, j]
            elif ok.any():
                todo.append((to, asks[ok]))
    return alive, far


# --- rows in Spark ---------------------------------------------------------------------------

ROW = "dim int, leaf int, vec_id long, label long, vec binary"


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, embedding, dim) of the rows that take part."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == F.lit(float("inf"))))
    some = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), e).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~bad)
    return some.withColumn("dim", F.size("embedding"))


def _integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim) * scale)


def _sent_through(rows: DataFrame, forest: dict[int, Tree], scale: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                x = _integers(part.column("embedding"), dim, scale)
                leaf = descend(forest[dim], x) if dim in forest else np.zeros(len(x), int)
                yield pa.RecordBatch.from_arrays([
                    part.column("dim").cast(pa.int32()), pa.array(leaf, pa.int32()), part.column("vec_id"), part.column("label"), pa.array(encode(x), pa.binary())
                ], ["dim", "leaf", "vec_id", "label", "vec"])

    return rows.mapInArrow(run, ROW)


def _ranges(rows: DataFrame, forest: dict[int, Tree]) -> dict[int, Tree]:
    """The forest with the ranges of all rows: each task widens its own copy, Spark combines them node by node."""
    names = ["dim", "node", "lo", "hi", "short", "long"]
    schema = "dim int, node int, lo binary, hi binary, short binary, long binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                if dim in forest:
                    widen(forest[dim], decode(part.column("vec"), dim))
        out = [
            (dim, at, *(v.tobytes() for v in (n.lo, n.hi, n.short, n.long)))
            for dim, tree in forest.items() for at, n in enumerate(tree.nodes) if (n.short <= n.long).any()
        ]
        if out:
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def merge(group: pa.Table) -> pa.Table:
        ends = {"lo": np.minimum, "hi": np.maximum, "short": np.minimum, "long": np.maximum}
        one = {k: f.reduce([np.frombuffer(b) for b in group.column(k).to_pylist()]).tobytes() for k, f in ends.items()}
        return group.slice(0, 1).select(["dim", "node"]).append_column("lo", pa.array([one["lo"]])).append_column("hi", pa.array([one["hi"]])).append_column(
            "short", pa.array([one["short"]])).append_column("long", pa.array([one["long"]]))

    # One row per node comes back: the size of the tree, which the sample bounds.
    for r in rows.mapInArrow(run, schema).groupBy("dim", "node").applyInArrow(merge, schema).collect():
        node = forest[r.dim].nodes[r.node]
        m = len(node.pivots)
        node.lo, node.hi = (np.frombuffer(b).reshape(m, m) for b in (r.lo, r.hi))
        node.short, node.long = np.frombuffer(r.short), np.frombuffer(r.long)
    return forest


class Index(NamedTuple):
    """``rows``: dim, leaf, block, vec_id, label, vec of every row; ``sizes``: blocks by dim and leaf; the trees with their ranges."""

    rows: DataFrame
    sizes: DataFrame
    forest: dict[int, Tree]


def build_index(vectors: DataFrame, scale: int = 256, leaf: int = 256, leaves: int = 4096, sample: int = 16_384, fanout: int = 16, block: int = 16_384) -> Index:
    """Index of all usable rows; the tree is fitted on about ``sample`` of them, picked at random.

    Leaves hold about ``leaf`` rows, more where the table has over ``leaf * leaves`` rows.
    """
    rows = usable(vectors, scale)
    total = rows.count()
    rate = min(1.0, sample / max(total, 1))
    # Chance may give some more than asked for, a stated bound keeps the driver's share fixed.
    got = rows.filter(F.rand(12) < rate).limit(2 * sample).select("dim", "embedding").toArrow() if rate < 1 else rows.select("dim", "embedding").toArrow()
    share = got.num_rows / max(total, 1)
    forest = {}
    for batch in [got.combine_chunks().to_batches(max_chunksize=None)[0]] if got.num_rows else []:
        for dim, part in _by_dim(batch):
            if dim:
                forest[dim] = fit(_integers(part.column("embedding"), dim, scale), max(leaf, total / leaves) * share, fanout)
    sent = stored(_sent_through(rows, forest, scale), "sent")
    sizes = stored(sent.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "sizes")
    dealt = stored(sent.join(sizes, ["dim", "leaf"]).withColumn("block", F.floor(F.rand(3) * F.col("blocks")).cast("int")).drop("blocks"), "leaves")
    discard(sent)
    return Index(dealt, sizes, _ranges(dealt, forest))


# --- searches --------------------------------------------------------------------------------

#: An asking vector: its windows of scores, and the lows that an earlier visit has raised.
ASK = "dim int, qid long, vec_id long, label long, vec binary, lows array<long>, highs array<long>, raised array<long>"
VISIT = ASK.replace("raised array<long>", "leaf int")


def _window_matrix(column: pa.Array, empty: int) -> np.ndarray:
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0) or 1), float(empty))
    for i, w in enumerate(lists):
        out[i, : len(w)] = w
    return out


def _visits(asks: DataFrame, forest: dict[int, Tree], probes: int, first: bool) -> DataFrame:
    """The leaves each asking vector visits: on the first visit the ``probes`` nearest that it may, then all others that it still may."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, whole in _by_dim(batch):
                for at in range(0, whole.num_rows, 512):
                    part = whole.slice(at, 512)
                    a, tree = decode(part.column("vec"), dim), forest.get(dim, Tree([], 1))
                    lows, highs, raised = (_window_matrix(part.column(c), e) for c, e in (("lows", MOST), ("highs", LEAST), ("raised", MOST)))
                    alive, far = reachable(tree, a, lows, highs)
                    nearest = np.argsort(far, axis=1, kind="stable")[:, :probes]
                    probed = np.zeros_like(alive)
                    np.put_along_axis(probed, nearest, True, 1)
                    go = alive & probed if first else reachable(tree, a, raised, highs)[0] & ~(alive & probed)
                    ask, leaf = np.nonzero(go)
                    names = ["dim", "qid", "vec_id", "label", "vec", "lows", "highs"]
                    out = part.select(names).set_column(5, "lows", part.column("lows" if first else "raised")).take(pa.array(ask))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leaf, pa.int32())], [*names, "leaf"])

    return asks.mapInArrow(run, VISIT)


FOUND = "qid long, w int, score long, vec_id long"


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by smaller id; rows that agree in both count once."""
    some = np.arange(len(score))
    width = 2 * k
    while True:
        if len(score) > width:
            some = np.flatnonzero(score >= np.partition(score, len(score) - width)[len(score) - width])
        else:
            some = np.arange(len(score))
        order = some[np.lexsort((ids[some], -score[some]))]
        new = np.ones(len(order), bool)
        new[1:] = (score[order][1:] != score[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        if new.sum() >= k or len(some) == len(score):
            return order[new][:k]
        width *= 4


def _visited(index: Index, visits: DataFrame, k: int, same: bool, chunk: int) -> DataFrame:
    """The k best rows of each visited block for every window: of the same label, or of others."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def compare(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, int)] for _ in names]
        if rows.num_rows and asks.num_rows:
            dim = asks.column("dim")[0].as_py()
            x, ids, labels = decode(rows.column("vec"), dim), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            for at in range(0, asks.num_rows, 128):
                part = asks.slice(at, 128)
                score = scores(decode(part.column("vec"), dim), x)
                fits = (part.column("label").to_numpy()[:, None] == labels) == same
                fits &= part.column("vec_id").to_numpy()[:, None] != ids
                windows = zip(part.column("qid").to_pylist(), part.column("lows").to_pylist(), part.column("highs").to_pylist(), strict=True)
                for i, (qid, lows, highs) in enumerate(windows):
                    mine = np.flatnonzero(fits[i])
                    s = score[i, mine]
                    for w, (low, high) in enumerate(zip(lows, highs, strict=True)):
                        here = np.flatnonzero((s >= low) & (s <= high))
                        top = here[best(s[here], ids[mine[here]], k)]
                        for column, v in zip(out, (np.full(len(top), qid), np.full(len(top), w), s[top], ids[mine[top]]), strict=True):
                            column.append(v)
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(out, types, strict=True)], names)

    visits = stored(visits, "visits")
    keys = ["dim", "leaf"]
    deal = visits.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).join(index.sizes, keys)
    deal = stored(deal, "deal")
    asks = visits.join(deal, keys).withColumn("chunk", F.floor(F.rand(5) * F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = index.rows.join(deal.drop("blocks"), keys).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    by = ["dim", "leaf", "block", "chunk"]
    return rows.drop("chunks").groupBy(*by).cogroup(asks.drop("chunks", "blocks").groupBy(*by)).applyInArrow(compare, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of every window over all visits, with their rank from 1."""
    each = found.repartition("qid", "w").dropDuplicates(["qid", "w", "score", "vec_id"])
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "w").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def search(index: Index, asks: DataFrame, k: int, same: bool, probes: int = 4, chunk: int = 4096) -> DataFrame:
    """qid, w, rank, score, vec_id: for every window of every asking vector the k best rows of the
    same label (``same``) or of other labels, exactly; rows with the asking vec_id are left out.

    ``asks`` has the columns dim, qid, vec_id, label, vec, lows and highs.
    """
    first = asks.withColumn("raised", F.col("lows"))
    found = stored(_ranked(_visited(index, _visits(first, index.forest, probes, True), k, same, chunk), k), "found")
    # The k-th score of a window, where there is one, is the least that can still matter.
    kth = found.filter(F.col("rank") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    second = asks.join(kth, "qid", "left").withColumn(
        "raised", F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("kth", w), low)))
    ).select(*(f.split()[0] for f in ASK.split(", ")))
    more = _visited(index, _visits(second, index.forest, probes, False), k, same, chunk)
    return stored(_ranked(found.drop("rank").unionByName(more), k), "best")


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label, embedding; other columns are not read. Rows for which
    ``anchor`` holds are searched for, against all rows of their length. An anchor's positives are the best
    rows of its label with another vec_id; for each, the negatives are the best rows of other
    labels whose score is ``low`` to ``high`` percent of the positive's, ties by smaller vec_id.

    Rows with a null vec_id, label or vector, or a null or non-finite component (after scaling
    as well) take no part. An anchor without positives, or a positive without negatives, gives no rows.
    Repeated rows count once, and so do rows of one vec_id with the same score. Vectors of length 0 are
    compared like others. An empty table gives no rows.
    """
    index = build_index(vectors.select("vec_id", "label", "embedding"), scale, **options)
    asking = index.rows.filter(anchor).select("dim", "vec_id", "label", "vec").distinct()
    asking = stored(asking.withColumn("qid", F.monotonically_increasing_id()), "anchors")
    whole = asking.select("dim", "qid", "vec_id", "label", "vec", F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs"))
    near = search(index, whole, positives, same=True)
    percent = F.col("score").cast("decimal(20,0)")
    bounds = near.select(
        "qid", F.struct(
            "rank", "vec_id", "score", F.ceil(percent * low / 100).cast("long").alias("low"), F.floor(percent * high / 100).cast("long").alias("high")
        ).alias("p"),
    ).groupBy("qid").agg(F.sort_array(F.collect_list("p")).alias("p"))
    windows = stored(asking.join(bounds, "qid").select(
        "dim", "qid", "vec_id", "label", "vec", F.col("p.low").alias("lows"), F.col("p.high").alias("highs"), F.col("p.vec_id").alias("positive_ids"), F.col("p.score").alias("scores"),
    ), "windows")
    hard = search(index, windows.drop("positive_ids", "scores"), negatives, same=False)
    named = windows.select("qid", F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("positive_ids", "scores")).alias("w", "p"))
    return hard.withColumnRenamed("vec_id", "negative_id").join(named, ["qid", "w"]).select(
        "anchor_id", F.col("p.positive_ids").alias("positive_id"), F.col("rank").cast("int"), "negative_id", F.col("p.scores").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def moved_label(vectors: DataFrame) -> DataFrame:
    """Every seventh vec_id with the label after its own, of ten."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (SELECT * FROM v WHERE vec_id % 100 = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM a JOIN v ON a.vec_id <> v.vec_id AND len(a.q) = len(v.q)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
