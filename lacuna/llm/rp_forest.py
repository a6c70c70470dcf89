"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits the vectors along random directions, where few of them lie near the cut
and neither side is small: a dense group then falls on one side. Splits overlap by a
width in the projection, ``spill`` times the chord of the threshold, whatever the ranks: a
close pair is parted only if its projections lie further apart than that. Where on several
directions every cut has more than a quarter of the vectors in its overlap, as inside a dense group, the tree
stops: no split parts such vectors cheaply without parting links. A tree that cannot split
all vectors is left out and another one drawn. Vectors are compared in
double precision within the leaves of every tree, and a leaf of more than ``block``
vectors is dealt out as pairs of blocks.

A pair counts in the first leaf that holds both: every vector carries the list of its
leaves, so degrees are sums over blocks and no table of all links is made. For the
components a block hands over a star for each group it links.

The trees are fitted on a bounded sample; every vector is sent through them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import components, stored
from lacuna.llm.vectors import matrix, usable

#: Node -> (bounds of the overlap, number of the direction).
Thresholds = dict[int, tuple[float, float, int]]
#: A node whose overlap holds a larger share is a leaf; nodes lie at most this deep.
OVERLAP, DEPTH = 0.25, 50
#: Directions tried at a node, and the ranks at which it may be cut.
TRIES, RANKS = 4, np.linspace(0.1, 0.9, 33)


def direction(tree: int, node: int, dim: int, k: int = 0) -> np.ndarray:
    return np.random.default_rng([tree, node & 0xFFFFFFFF, node >> 32, dim, k]).standard_normal(dim)


def cut(p: np.ndarray, width: float) -> tuple[float, float]:
    """(share of the projections in the overlap, cut): the cut with the least overlap, of like ones the most even."""
    n = len(p)
    p = np.sort(p)
    at = p[(RANKS * (n - 1)).astype(int)]
    left, right = np.searchsorted(p, at + width / 2, "right"), n - np.searchsorted(p, at - width / 2, "left")
    shared = (left + right - n) / n
    whole = np.maximum(left, right) >= n
    best = int((shared + 0.1 * np.abs(left - right) / n + whole).argmin())
    return float(shared[best] + whole[best]), float(at[best])


def fit(sample: np.ndarray, tree: int, leaf: int, width: float) -> Thresholds:
    """Overlaps at every inner node; node 1 is the root, 2k and 2k + 1 its sides."""
    out: Thresholds = {}
    todo = [(1, sample)]
    while todo:
        node, x = todo.pop()
        if len(x) <= leaf or node >> DEPTH:
            continue
        tried = []
        for k in range(TRIES):
            p = x @ direction(tree, node, x.shape[1], k)
            shared, middle = cut(p, width)
            tried.append((shared, k, middle, p))
            if shared <= OVERLAP / 2:
                break
        shared, k, middle, p = min(tried, key=lambda t: t[:2])
        if shared > OVERLAP:
            continue
        lo, hi = middle - width / 2, middle + width / 2
        out[node] = (lo, hi, k)
        todo += [(2 * node, x[p <= hi]), (2 * node + 1, x[p >= lo])]
    return out


def forest_of(sample: np.ndarray, trees: int, leaf: int, width: float) -> list[Thresholds]:
    """``trees`` trees that split the sample, out of four times as many tries; one leaf for all where fewer than half can be had.

    A number of a try stays that of its tree: where it cannot split, its place holds None.
    """
    if len(sample) <= leaf:
        return [{}]
    out: list[Thresholds | None] = []
    while sum(t is not None for t in out) < trees and len(out) < 4 * trees:
        out.append(fit(sample, len(out), leaf, width) or None)
    return out if 2 * sum(t is not None for t in out) >= trees else [{}]


def route(x: np.ndarray, tree: int, bounds: Thresholds) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, row numbers) for every leaf that gets rows."""
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node not in bounds:
            yield node, rows
            continue
        lo, hi, k = bounds[node]
        p = x[rows] @ direction(tree, node, x.shape[1], k)
        todo += [(2 * node, rows[p <= hi]), (2 * node + 1, rows[p >= lo])]


def groups(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a table of links between its rows and its columns, each named by a row; -1 has no link."""
    left, right = np.full(link.shape[0], -1), np.full(link.shape[1], -1)
    for start in np.flatnonzero(link.any(1)):
        if left[start] >= 0:
            continue
        left[start] = start
        new = np.array([start])
        while len(new):
            reached = np.flatnonzero(link[new].any(0) & (right < 0))
            right[reached] = start
            new = np.flatnonzero(link[:, reached].any(1) & (left < 0))
            left[new] = start
    return left, right


def _padded(lists: list[np.ndarray], missing: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), missing, np.int64)
    for row, own in zip(out, lists, strict=True):
        row[: len(own)] = own
    return out


def first_met(link: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], leaf: int) -> np.ndarray | None:
    """The links of vectors that share no leaf before ``leaf``; None if all pairs share one."""
    a, b = [x[x < leaf] for x in a], [x[x < leaf] for x in b]
    (ca, na), (cb, nb) = (np.unique(np.concatenate(x), return_counts=True) for x in (a, b))
    shared, ia, ib = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    if not len(shared):
        return link
    if ((na[ia] == len(a)) & (nb[ib] == len(b))).any():
        return None
    wide_a, wide_b = _padded(a, -1), _padded(b, -2)
    if np.count_nonzero(link) * wide_a.shape[1] * wide_b.shape[1] < link.size * len(shared):
        out = link.copy()
        i, j = np.nonzero(link)
        for at in range(0, len(i), 4096):
            x, y = wide_a[i[at : at + 4096]], wide_b[j[at : at + 4096]]
            out[i[at : at + 4096], j[at : at + 4096]] = ~(x[:, :, None] == y[:, None, :]).any((1, 2))
        return out
    in_a, in_b = ((np.searchsorted(shared, w), np.isin(w, shared)) for w in (wide_a, wide_b))
    marks = []
    for place, hit in (in_a, in_b):
        m = np.zeros((len(place), len(shared)), np.float32)
        r, c = np.nonzero(hit)
        m[r, place[r, c]] = 1
        marks.append(m)
    return link & (marks[0] @ marks[1].T < 0.5)


def compared(a: list[np.ndarray], b: list[np.ndarray], leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the vectors that lie in the one earlier leaf in which most of these pairs have met.

    A dense group stays together in every tree; so only the first of its leaves compares it whole.
    """
    (ca, na), (cb, nb) = (np.unique(np.concatenate([v[v < leaf] for v in x]), return_counts=True) for x in (a, b))
    shared, ia, ib = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    if not len(shared):
        return np.zeros(len(a), bool), np.zeros(len(b), bool)
    best = shared[(na[ia] * nb[ib]).argmax()]
    return tuple(np.fromiter(((v == best).any() for v in x), bool, len(x)) for x in (a, b))


def linked(
    vectors: DataFrame, cosine: float = 0.95, trees: int = 8, leaf: int = 1024, spill: float = 1.0, sample: int = 65_536, block: int = 4096,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal vectors are compared once and count with their number. Vectors that are null or
    zero, hold a null or non-finite part, or have a null vec_id link with nothing: 0
    links, their own component, kept. Vectors of different lengths do not link. An empty
    table gives no rows; other columns, labels among them, are not read.
    """
    spark = vectors.sparkSession
    good = usable(vectors, vec_id, embedding)
    reps = stored(good.groupBy("embedding", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    reps = reps.withColumn("node", F.xxhash64("rep", "embedding"))
    sizes = {r.dim: r.rows for r in reps.groupBy("dim").agg(F.count("*").alias("rows")).collect()}
    met = None
    width = spill * float(np.sqrt(2 - 2 * cosine))
    for dim, rows in sizes.items():
        own = reps.filter(F.col("dim") == dim)
        fitted = own.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow()
        x = _unit(matrix(fitted.column(0)))
        small = max(16, min(leaf, leaf * len(x) // rows))
        forest = forest_of(x, trees, small, width)
        found = _dealt(stored(_leaves(own, forest), "leaves"), block).groupBy("leaf", "one", "two").applyInPandas(_comparer(cosine), MET)
        met = found if met is None else met.union(found)
    if met is None:
        met = spark.createDataFrame([], MET)
    met = stored(met, "met")
    comps = components(met.filter("b IS NOT NULL").select("a", "b"))
    key = reps.select("node", "rep", "copies")
    counts = met.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    least = comps.join(key, "node").groupBy("component").agg(F.min("rep").alias("least"))
    labels = reps.join(counts, "node", "left").join(comps, "node", "left").join(least, "component", "left")
    labels = labels.select(
        F.col("embedding").alias("__e"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("least", "rep").alias("label")
    )
    marked = usable(vectors, vec_id, embedding).join(labels, F.col("embedding") == F.col("__e")).select("vec_id", "links", "label")
    # Rows that take no part are those the filter above leaves out.
    rest = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    e = F.col("embedding")
    out_of = F.col("vec_id").isNull() | e.isNull() | F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) | ~F.exists(e, lambda v: v != 0)
    alone = rest.filter(F.coalesce(out_of, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("label"))
    every = marked.union(alone)
    return every.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("label").alias("component_id"), F.col("label").eqNullSafe(F.col("vec_id")).alias("kept"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _leaves(reps: DataFrame, forest: list[Thresholds | None]) -> DataFrame:
    """(node, copies, unit, leaves): every vector with its leaves in all trees, in order."""

    def sent(batches):
        for batch in batches:
            x = _unit(matrix(batch.column("embedding")))
            leaves: list[list[int]] = [[] for _ in x]
            for tree, bounds in enumerate(forest):
                for leaf, rows in route(x, tree, bounds) if bounds is not None else ():
                    for r in rows.tolist():
                        leaves[r].append((tree << DEPTH + 2) + leaf)
            yield pa.RecordBatch.from_pydict({
                "node": batch.column("node"), "copies": batch.column("copies"), "unit": pa.array([r.tobytes() for r in x], pa.binary()),
                "leaves": pa.array([sorted(v) for v in leaves], pa.list_(pa.int64())),
            })

    return reps.select("node", "embedding", "copies").mapInArrow(sent, "node long, copies long, unit binary, leaves array<long>")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows of every leaf by the pair of blocks (one <= two) they meet in, with their own block."""
    sizes = rows.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
    large = stored(sizes.filter(F.col("n") > block).select("leaf", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("parts")), "large")
    out = rows.withColumn("leaf", F.explode("leaves")).join(F.broadcast(large), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    out = out.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.select("leaf", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "copies", "unit", "leaves")


#: Either a vector with the copies it links to, or two vectors of one component.
MET = "a long, b long, others long"


def _comparer(cosine: float, chunk: int = 1024):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, one, two = (int(pdf[c].iloc[0]) for c in ("leaf", "one", "two"))
        none = pd.DataFrame({"a": [], "b": [], "others": []}).astype("Int64")
        a = pdf[pdf["own"] == one]
        b = a if one == two else pdf[pdf["own"] == two]
        if not len(a) or not len(b):
            return none
        x, y = (np.frombuffer(b"".join(d["unit"]), float).reshape(len(d), -1) for d in (a, b))
        met_a, met_b = compared(a["leaves"].tolist(), b["leaves"].tolist(), leaf)
        link = np.zeros((len(x), len(y)), bool)
        for rows, columns in ((np.flatnonzero(~met_a), slice(None)), (np.flatnonzero(met_a), np.flatnonzero(~met_b))):
            own = y[columns]
            for at in range(0, len(rows) if len(own) else 0, chunk):
                link[np.ix_(rows[at : at + chunk], np.arange(len(y))[columns])] = x[rows[at : at + chunk]] @ own.T >= cosine
        if one == two:
            np.fill_diagonal(link, False)
            link |= link.T  # rounding may differ by side
        counted = first_met(link, a["leaves"].tolist(), b["leaves"].tolist(), leaf)
        if counted is None or not counted.any():
            return none  # an earlier leaf has met all links
        ids, others = (a["node"].to_numpy(), b["node"].to_numpy()), (a["copies"].to_numpy(float), b["copies"].to_numpy(float))
        out = [(ids[0], _sums(counted, others[1]))]
        if one != two:
            out.append((ids[1], _sums(counted.T, others[0])))
        degrees = pd.concat([pd.DataFrame({"a": n, "others": d})[d > 0] for n, d in out])
        if one == two:
            np.fill_diagonal(link, link.any(1))
        of_a, of_b = groups(link)
        stars = pd.concat([pd.DataFrame({"a": ids[0][g[g >= 0]], "b": n[g >= 0]}) for g, n in ((of_a, ids[0]), (of_b, ids[1]))])
        stars = stars[stars["a"] != stars["b"]].drop_duplicates()
        # Nullable before they meet: ids are hashes, which floats would round.
        return pd.concat([degrees.assign(b=None).astype("Int64"), stars.assign(others=None).astype("Int64")])[["a", "b", "others"]]

    return compare


def _sums(link: np.ndarray, copies: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """For each row, the copies of the columns it links to; exact below 2^53."""
    return np.concatenate([link[at : at + chunk].astype(float) @ copies for at in range(0, len(link), chunk)]).astype(np.int64)
