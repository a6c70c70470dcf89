"""Filling cells from the leading modes of all series together, with a series as a row.

Nothing has a column per site: the matrix of days and series stays a table of cells, the
modes are a table with one short array per series. They are found by subspace iteration on the days
on which every series has a value: a block of vectors is multiplied by the cells (a sum per
day) and by their transpose (a sum per series), and only matrices of the block's size reach the
driver. The block doubles until it holds the asked share of the variance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.gaps import KEYS
from lacuna.sources.files import stored


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _times(v: Column | str, matrix: np.ndarray) -> Column:
    """The row vector ``v`` times a small matrix."""
    return F.array(*[_dot(v, F.lit([float(x) for x in matrix[:, j]])) for j in range(matrix.shape[1])])


def _summed(scalar: Column, vector: str, size: int) -> Column:
    """Sum of scalar * vector over a group."""
    return F.array(*[F.sum(scalar * F.get(vector, F.lit(j))) for j in range(size)])


def _gram(rows: DataFrame, vector: str, size: int) -> np.ndarray:
    """Sum over all rows of the products of the vector's components: ``size`` squared numbers."""
    every = F.sequence(F.lit(0), F.lit(size - 1))
    pairs = F.flatten(F.transform(every, lambda i: F.transform(F.slice(every, i + 1, F.lit(size)), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get(vector, i) * F.get(vector, j)).alias("p")))))
    out = np.zeros((size, size))
    for r in rows.select(F.inline(pairs)).groupBy("i", "j").agg(F.sum("p").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def _orthonormal(rows: DataFrame, size: int) -> np.ndarray:
    """The matrix that turns the vectors ``v`` into an orthonormal block."""
    values, vectors = np.linalg.eigh(_gram(rows, "v", size))
    keep = values > values.max() * 1e-12
    return vectors[:, keep] / np.sqrt(values[keep])


def leading(z: DataFrame, days: int, series: int, keys: Sequence[str] = KEYS, share: float = 0.95, block: int = 16, rounds: int = 30, tolerance: float = 1e-9) -> tuple[DataFrame, np.ndarray]:
    """(keys, v: components of each mode; variances of the modes) of standardised cells (keys, obs_date, z).

    Every series has a cell on each of the ``days``. As many modes are kept as reach ``share`` of
    the total variance, which is the number of series.
    """
    spark = z.sparkSession
    names = z.select(*keys).distinct()
    size = min(block, series)
    while True:
        # Any start will do; a hash makes it the same whenever it is computed.
        start = F.array(*[F.sin(F.pmod(F.xxhash64(*keys, F.lit(j)), F.lit(1_000_003)).cast("double")) for j in range(size)])
        v = stored(spark, names.withColumn("v", start), "block")
        basis = _orthonormal(v, size)
        v = stored(spark, v.withColumn("v", _times("v", basis)), "block")
        width, before = basis.shape[1], None
        for _ in range(rounds):
            p = z.join(v, list(keys)).groupBy("obs_date").agg(_summed(F.col("z"), "v", width).alias("p"))
            p = stored(spark, p, "scores")
            variance, turn = np.linalg.eigh(_gram(p, "p", width) / max(days - 1, 1))
            variance, turn = variance[::-1], turn[:, ::-1]
            settled = before is not None and np.abs(variance - before).max() <= tolerance * variance.max()
            if size >= series or settled:
                break
            before = variance
            w = z.join(p, "obs_date").groupBy(*keys).agg(_summed(F.col("z"), "p", width).alias("v"))
            w = stored(spark, w, "block")
            basis = _orthonormal(w, width)
            v = stored(spark, w.withColumn("v", _times("v", basis)), "block")
            if basis.shape[1] != width:
                width, before = basis.shape[1], None
        reached = np.cumsum(variance) / series
        if reached[-1] >= share or size >= min(series, days):
            count = min(int(np.searchsorted(reached, share)) + 1, width)
            return stored(spark, v.withColumn("v", _times("v", turn[:, :count])), "modes"), variance[:count]
        size = min(2 * size, series)


def eof_fill(cells: DataFrame, keys: Sequence[str] = KEYS, share: float = 0.95, rounds: int = 5, min_days: int = 10, block: int = 16) -> DataFrame:
    """The cells with ``filled``: the value, or its reconstruction from the leading modes.

    Modes come from the days on which every series has a value, standardised; with fewer than
    ``min_days`` of them nothing is filled. Of a day at least half of the series must have a value; missing ones start at the
    mean, and ``rounds`` times the day is projected on the modes and what was observed restored.
    One row per series and day. Rows without a key or a day stay as they are.
    """
    spark = cells.sparkSession
    placed = F.col("obs_date").isNotNull()
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    known = stored(spark, cells.filter(placed).select(*keys, "obs_date", F.col("value").cast("double").alias("value")), "cells")
    series = known.select(*keys).distinct().count()
    seen = known.filter("value IS NOT NULL")
    whole = stored(spark, seen.groupBy("obs_date").agg(F.count(F.lit(1)).alias("n")), "days")
    days = whole.filter(F.col("n") == series).count() if series else 0
    if days < min_days:
        return cells.withColumn("filled", F.col("value"))
    full = seen.join(whole.filter(F.col("n") == series).select("obs_date"), "obs_date", "left_semi")
    stats = stored(spark, full.groupBy(*keys).agg(F.avg("value").alias("mean"), (F.stddev_samp("value") + F.lit(1e-10)).alias("std")), "stats")
    standard = (F.col("value") - F.col("mean")) / F.col("std")
    z = stored(spark, full.join(stats, list(keys)).select(*keys, "obs_date", standard.alias("z")), "standard")
    modes, variance = leading(z, days, series, keys, share, block)
    size = len(variance)
    # c is the day's place in the modes: what the observed cells give, plus what the estimates of the others give.
    usable = whole.filter(F.col("n") * 2 >= series).filter(F.col("n") < series)
    facts = stats.join(modes, list(keys))
    parts = stored(spark, seen.join(usable.select("obs_date"), "obs_date", "left_semi").join(facts, list(keys)).select("obs_date", standard.alias("z"), "v"), "parts")
    base = stored(spark, parts.groupBy("obs_date").agg(_summed(F.col("z"), "v", size).alias("k")), "base")
    place = base.withColumn("c", F.col("k"))
    for _ in range(rounds - 1):
        given = parts.join(place, "obs_date").groupBy("obs_date").agg(_summed(_dot("v", "c"), "v", size).alias("g"))
        moved = place.join(given, "obs_date").withColumn("c", F.zip_with("k", F.zip_with("c", "g", lambda a, b: a - b), lambda a, b: a + b))
        place = stored(spark, moved.select("obs_date", "k", "c"), "place")
    joined = cells.join(facts, list(keys), "left").join(place.select("obs_date", "c"), "obs_date", "left")
    guess = _dot("v", "c") * F.col("std") + F.col("mean")
    return joined.withColumn("filled", F.coalesce(F.col("value"), guess)).select(*cells.columns, "filled")
