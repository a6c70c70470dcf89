"""Nearest neighbours by cross-polytope hashing.

A table pseudo-rotates the vectors by three rounds of random signs and a fast Hadamard
transform, keeps the first ``axes`` coordinates, and hashes a vector to the nearest signed
axis, i.e. the largest coordinate by size and its sign. A query looks into the buckets of its
``probes`` nearest signed axes in every table. Candidates are ranked by the exact measure.

The measure is the inner product. Vectors are put into bands of similar length; those of a
band are scaled by its largest length and get one more coordinate that fills them up to
length 1, queries get a 0 there, so that a larger inner product is a smaller angle. The rows
of bands with few rows, such as a single long one, are compared with every query. A query
leaves out a band whose longest vector could not reach the k-th of these.

Buckets are groups that Spark forms; one with more than ``block`` rows is dealt out in
several, each of which meets the bucket's queries on its own, so a bucket that holds a
third of all rows is no single task. Of each block every query keeps its best rows only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import stored
from lacuna.llm.vectors import matrix, usable


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([seed, table, d]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(x: np.ndarray, table: int, seed: int, axes: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row: 2 * axis, + 1 for the negative side."""
    r = rotate(x, table, seed)[:, :axes]
    both = np.stack([r, -r], axis=2).reshape(len(x), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, tables: int = 8, axes: int = 16, probes: int = 6, block: int = 8192, seed: int = 7,
    vec_id: str = "vec_id", embedding: str = "embedding", ratio: float = 1.1, whole: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows but
    those with the query's own vec_id. Vectors that are null or zero, hold a null or
    non-finite part, or have a null vec_id take no part, and vectors meet only those of
    their own length. Repeated rows count once. Lengths within a band differ by ``ratio``
    at most; bands of at most ``whole`` rows are not hashed. A query whose buckets give
    fewer than ``k`` rows (small tables) is compared with all rows in blocks. An empty
    table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    good = usable(vectors, vec_id, embedding).dropDuplicates(["vec_id", "embedding"])
    good = stored(good.withColumn("length", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v))), "vectors")
    measured = (F.col("length") > 0) & (F.col("length") < float("inf"))  # squares can leave the range of numbers
    longest = good.filter(measured).select(F.max("length")).first()[0] or 1.0
    step = (F.lit(float(np.log(longest))) - F.log("length")) / F.lit(float(np.log(ratio)))
    good = good.withColumn("band", F.when(measured, F.greatest(F.floor(step), F.lit(0)).cast("int")).otherwise(F.lit(-1)))
    bands = good.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect()
    total = sum(r.n for r in bands)
    tops = {(r.dim, r.band): r.top for r in bands if r.band >= 0 and r.n > whole}
    hashed = spark.createDataFrame(list(tops) or [(-1, -1)], "dim int, band int")
    asked = good.filter(F.col("vec_id") % every == 0)

    few = total - sum(r.n for r in bands if (r.dim, r.band) in tops)
    found = stored(_in_blocks(asked, good.join(F.broadcast(hashed), ["dim", "band"], "left_anti"), max(1, -(-few // block)), k), "few")
    if tops:
        # A query's k-th best so far is a lower bound of its final one.
        least = _ranked(found, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        rows = good.mapInArrow(_hashed(tables, axes, seed, tops), ROW)
        rows = stored(rows, "rows")
        group = ["tab", "bucket", "dim", "band"]
        sizes = rows.groupBy(*group).agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.lit(1)).cast("int").alias("parts"))
        sizes = stored(sizes, "sizes")  # at most tables * 2 * axes rows for each band
        dealt = rows.join(F.broadcast(sizes), group).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        asks = asked.join(least, "vec_id", "left").select("vec_id", "embedding", "dim", "length", "least").mapInArrow(_asking(tables, axes, probes, seed, tops), ROW)
        doors = sizes.select(*group, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        asks = asks.join(F.broadcast(doors), group)
        group = [*group, "part"]
        near = asks.groupBy(*group).cogroup(dealt.groupBy(*group)).applyInPandas(_best(k), FOUND)
        found = stored(found.unionByName(near).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    best = _ranked(found, k)

    # Queries with too few candidates: all rows, in blocks.
    short = asked.select("vec_id", "embedding", "dim").join(
        found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")), "vec_id", "left"
    ).filter(F.coalesce("n", F.lit(0)) < k).drop("n")
    short = stored(short, "short")
    if tops and short.limit(1).count():
        rest = _in_blocks(short, good, max(1, -(-total // block)), k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
        best = _ranked(found, k)
    return best


ROW = "tab int, bucket int, dim int, band int, vec_id long, embedding array<double>"
FOUND = "query_id long, vec_id long, score double"


def _in_blocks(asked: DataFrame, base: DataFrame, parts: int, k: int) -> DataFrame:
    """The best rows of ``base`` for each query, by blocks of it."""
    base = base.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).select("dim", "part", "vec_id", "embedding")
    wide = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*(F.col(c).alias(c) for c in ("dim", "part", "vec_id", "embedding")))
    return wide.groupBy("dim", "part").cogroup(base.groupBy("dim", "part")).applyInPandas(_best(k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query. Blocks hand over what a query needs, so a query has few rows."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _batches(ids: np.ndarray, x: np.ndarray, dim: int, band: np.ndarray, tab: int, near: np.ndarray):
    values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
    for p in range(near.shape[1]):
        n = len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, tab, np.int32)), pa.array(near[:, p].astype(np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(band.astype(np.int32)), pa.array(ids), values],
            names=["tab", "bucket", "dim", "band", "vec_id", "embedding"],
        )


def _hashed(tables: int, axes: int, seed: int, tops: dict[tuple[int, int], float]):
    """Rows of the bands in ``tops``, scaled by the band's longest, in their bucket of every table."""

    def hashed(batches):
        for batch in batches:
            dims, bands = batch.column("dim").to_numpy(), batch.column("band").to_numpy()
            for dim in np.unique(dims):
                longest = np.array([tops.get((int(d), int(b)), np.nan) if d == dim else np.nan for d, b in zip(dims, bands, strict=True)])
                some = ~np.isnan(longest)
                if not some.any():
                    continue
                own = batch.filter(pa.array(some))
                x, ids, band = matrix(own.column("embedding")), own.column("vec_id").to_numpy(), bands[some]
                unit = x / longest[some][:, None]
                unit = np.column_stack([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))])
                for t in range(tables):
                    yield from _batches(ids, x, dim, band, t, nearest_axes(unit, t, seed, axes, 1))

    return hashed


def _asking(tables: int, axes: int, probes: int, seed: int, tops: dict[tuple[int, int], float]):
    """Queries in their nearest buckets of every band that can hold one of their best rows."""

    def asking(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x, ids, length = matrix(own.column("embedding")), own.column("vec_id").to_numpy(), own.column("length").to_numpy()
                least = own.column("least").to_numpy(zero_copy_only=False).astype(float)  # NaN: fewer than k rows so far
                size = np.abs(x).max(1, keepdims=True)
                unit = x / size
                unit = np.column_stack([unit / np.linalg.norm(unit, axis=1, keepdims=True), np.zeros(len(x))])
                nears = [nearest_axes(unit, t, seed, axes, probes) for t in range(tables)]
                for (d, band), top in tops.items():
                    # A margin for rounding.
                    ask = np.flatnonzero(~(length * top * (1 + 1e-9) < least)) if d == dim else []
                    if len(ask):
                        for t, near in enumerate(nears):
                            yield from _batches(ids[ask], x[ask], dim, np.full(len(ask), band), t, near[ask])

    return asking


def _best(k: int, queries: int = 1024):
    def best(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(rows):
            ids = rows["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], np.array(rows["embedding"].tolist(), float)[order]
            for at in range(0, len(asks), queries):
                part = asks.iloc[at : at + queries]
                q = np.array(part["embedding"].tolist(), float)
                s = q @ x.T
                for own, row, v in zip(part["vec_id"].to_numpy(), s, q, strict=True):
                    row[ids == own] = -np.inf
                    if len(row) > k:
                        # A margin for rounding: equal products stay together, in order of their ids.
                        floor = np.partition(row, len(row) - k)[len(row) - k]
                        near = np.flatnonzero(row >= floor - 1e-9 * max(1.0, abs(floor)))
                    else:
                        near = np.flatnonzero(row > -np.inf)
                    near = near[row[near] > -np.inf]
                    exact = (x[near] * v).sum(1)
                    keep = near[np.lexsort((ids[near], -exact))[:k]]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[keep], "score": (x[keep] * v).sum(1)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return best
