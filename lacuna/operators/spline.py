"""Quadratic spline through all observed points of a series.

The curve is smooth (its slope has no jump) and meets every observation; its pieces change half way
between observations, except before the second and after the last but one. In the basis of
quadratic B-splines it is the solution of one tridiagonal system per series.

A series is cut into chunks of consecutive observations. A chunk solves its own equations
for three right sides: its observations, and the coefficient on either side of it, which it does not
know. What is left per chunk is two equations; those of a series, one row per chunk, are
solved by elimination, and every chunk then knows its neighbours. So no series sits in one task,
and no step grows with its length but the row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.scan import chunked, positions
from lacuna.operators.gaps import KEYS, neighbours

CHUNK_POINTS = 512


def _knots(x: np.ndarray, p: np.ndarray, n: int, at: np.ndarray, shift: int) -> np.ndarray:
    """Where the piece of point ``at + shift`` ends: half way to the next point, the ends of the series at its ends.

    ``x`` are the places of consecutive points ``p``; ``at`` lies at least two points inside
    them, or as far as the series goes.
    """
    i = at + shift
    here = np.clip(i - p[0], 0, len(x) - 1)
    after = np.clip(i + 1 - p[0], 0, len(x) - 1)
    middle = (x[here] + x[after]) / 2
    first, last = x[np.clip(0 - p[0], 0, len(x) - 1)], x[np.clip(n - 1 - p[0], 0, len(x) - 1)]
    return np.where(i <= 0, first, np.where(i >= n - 2, last, middle))


class _Chunk:
    """The equations of one chunk: ``low`` c[-1] + ``mid`` c[0] + ``high`` c[1] = y for each of its points."""

    def __init__(self, block: pa.Table, chunk_points: int) -> None:
        block = block.sort_by("p")
        p, x = block.column("p").to_numpy(), block.column("x").to_numpy().astype(float)
        self.n = int(block.column("p_last")[0].as_py()) + 1
        home = p // chunk_points == block.column("part")[0].as_py()
        self.rows, self.p, self.x, self.y = block.filter(pa.array(home)), p[home], x[home], block.column("y").to_numpy()[home]
        far, left, right, beyond = (_knots(x, p, self.n, self.p, s) for s in (-2, -1, 0, 1))
        self.far, self.left, self.right, self.beyond = far, left, right, beyond
        inner = (self.p > 0) & (self.p < self.n - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.low = np.where(inner, (right - self.x) ** 2 / ((right - left) * (right - far)), 0.0)
            self.high = np.where(inner, (self.x - left) ** 2 / ((right - left) * (beyond - left)), 0.0)
        self.mid = 1 - self.low - self.high
        self.inner = inner

    def solve(self) -> np.ndarray:
        """Coefficients for the observations, for one unit before, and for one unit after the chunk."""
        m = len(self.p)
        rhs = np.zeros((m, 3))
        rhs[:, 0] = self.y
        rhs[0, 1], rhs[-1, 2] = -self.low[0], -self.high[-1]
        ratio = np.zeros(m)
        for i in range(m):
            low = self.low[i] if i else 0.0
            pivot = self.mid[i] - (low * ratio[i - 1] if i else 0.0)
            ratio[i] = self.high[i] / pivot if i < m - 1 else 0.0
            rhs[i] = (rhs[i] - (low * rhs[i - 1] if i else 0.0)) / pivot
        for i in range(m - 2, -1, -1):
            rhs[i] -= ratio[i] * rhs[i + 1]
        return rhs


def _ends(block: pa.Table, keys: Sequence[str], chunk_points: int) -> pa.Table:
    chunk = _Chunk(block, chunk_points)
    s = chunk.solve() if chunk.n > 2 else np.zeros((1, 3))
    one = chunk.rows.slice(0, 1).select([*keys, "part"])
    for name, v in zip(("first0", "first1", "first2", "last0", "last1", "last2"), (*s[0], *s[-1]), strict=True):
        one = one.append_column(name, pa.array([v], pa.float64()))
    return one


def _meet(rows: pa.Table, keys: Sequence[str]) -> pa.Table:
    """Coefficients beside every chunk of a series, from the two end equations of each of its chunks."""
    rows = rows.sort_by("part")
    first, last = (np.stack([rows.column(f"{e}{k}").to_numpy() for k in range(3)], axis=1) for e in ("first", "last"))
    m = rows.num_rows
    # The last coefficient of a chunk as base + rate * (the first coefficient of the next one).
    base, rate = np.zeros(m), np.zeros(m)
    start, slope = np.zeros(m), np.zeros(m)
    for k in range(m):
        before, by = (base[k - 1], rate[k - 1]) if k else (0.0, 0.0)
        pivot = 1 - first[k, 1] * by
        start[k], slope[k] = (first[k, 0] + first[k, 1] * before) / pivot, first[k, 2] / pivot
        base[k] = last[k, 0] + last[k, 1] * (before + by * start[k])
        rate[k] = last[k, 2] + last[k, 1] * by * slope[k]
    left, right = np.zeros(m), np.zeros(m)
    following = 0.0
    for k in range(m - 1, -1, -1):
        right[k] = following
        following = start[k] + slope[k] * following
    left[1:] = base[:-1] + rate[:-1] * (start[1:] + slope[1:] * right[1:])
    return rows.select([*keys, "part"]).append_column("left", pa.array(left)).append_column("right", pa.array(right))


def _pieces(block: pa.Table, beside: pa.Table, keys: Sequence[str], chunk_points: int) -> pa.Table:
    """The curve around each point: y + slope * (x - point) + bend * (x - point)^2, up to ``until``."""
    chunk = _Chunk(block, chunk_points)
    out = chunk.rows.select([*keys, "pos", "x", "y"])
    if chunk.n > 2:
        left, right = beside.column("left")[0].as_py(), beside.column("right")[0].as_py()
        c = chunk.solve() @ np.array([1.0, left, right])
        before, after = np.r_[left, c[:-1]], np.r_[c[1:], right]
        with np.errstate(divide="ignore", invalid="ignore"):
            at_left = 2 * (c - before) / (chunk.right - chunk.far)
            at_right = 2 * (after - c) / (chunk.beyond - chunk.left)
            bend = (at_right - at_left) / (2 * (chunk.right - chunk.left))
            slope = at_left + 2 * bend * (chunk.x - chunk.left)
        usable = chunk.inner
    else:
        slope = bend = np.zeros(len(chunk.p))
        usable = np.zeros(len(chunk.p), bool)
    for name, v in (("slope", slope), ("bend", bend)):
        out = out.append_column(name, pa.array(v, pa.float64(), mask=~usable))
    return out.append_column("until", pa.array(chunk.right, pa.float64()))


def curves(cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", axis: str = "row", ts: str = "obs_date", chunk_points: int = CHUNK_POINTS) -> tuple[DataFrame, DataFrame]:
    """(the rows with ``pos``; keys, pos, x, y, slope, bend, until of every observed row).

    ``slope`` and ``bend`` are null at both ends of a series and where it has fewer than three observations.
    """
    rows = positions(chunked(cells, keys, ts), keys, ts)
    place = F.col("pos") if axis == "row" else F.unix_date(ts).cast("long")
    seen = rows.filter(F.col(value).isNotNull()).select(*keys, "_chunk", ts, "pos", place.alias("x"), F.col(value).cast("double").alias("y"))
    seen = positions(seen, keys, ts, out="p").drop("_chunk")
    home, inside = F.floor(F.col("p") / chunk_points), F.col("p") % chunk_points
    # Two points of the chunks on either side say where the outer pieces end.
    near = F.filter(F.array(home, F.when(inside < 2, home - 1), F.when(inside >= chunk_points - 2, home + 1)), lambda c: c >= 0)
    parts = seen.drop(ts).withColumn("part", F.explode(near)).filter(F.col("part") * chunk_points <= F.col("p_last"))
    named = [f for f in cells.schema.fields if f.name in keys]
    named.sort(key=lambda f: list(keys).index(f.name))
    schema = lambda extra: T.StructType([*named, *[T.StructField(c, t) for c, t in extra]])
    number, whole = T.DoubleType(), T.LongType()
    by = [*keys, "part"]
    names = list(keys)
    ends = parts.groupBy(*by).applyInArrow(
        lambda block: _ends(block, names, chunk_points), schema([("part", whole), *[(f"{e}{k}", number) for e in ("first", "last") for k in range(3)]])
    )
    beside = ends.groupBy(*keys).applyInArrow(lambda block: _meet(block, names), schema([("part", whole), ("left", number), ("right", number)]))
    found = parts.groupBy(*by).cogroup(beside.groupBy(*by)).applyInArrow(
        lambda block, b: _pieces(block, b, names, chunk_points),
        schema([("pos", whole), ("x", whole), ("y", number), ("slope", number), ("bend", number), ("until", number)]),
    )
    return rows, found


def _along(point: Column, x: Column) -> Column:
    t = x - point["x"]
    return point["y"] + point["slope"] * t + point["bend"] * t * t


def estimate(prev: Column, nxt: Column, x: Column) -> Column:
    """The curve between two neighbouring points; a straight line where it has none."""
    line = prev["y"] + F.try_divide((nxt["y"] - prev["y"]) * (x - prev["x"]), nxt["x"] - prev["x"])
    return F.coalesce(F.when(x <= prev["until"], _along(prev, x)).otherwise(_along(nxt, x)), line)


def quadratic_spline(
    cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", axis: str = "row", ts: str = "obs_date", chunk_points: int = CHUNK_POINTS
) -> DataFrame:
    """The panel with ``filled``: the observation, or the spline between observations.

    Places are rows of the series, or days with ``axis='day'`` (then one observation a day).
    With two observations the curve is the straight line; before the first and after the last
    one cells stay missing. Rows without a key or a day belong to no series and are left out.
    """
    rows, found = curves(cells, keys, value, axis, ts, chunk_points)
    curve = F.struct("x", "y", "slope", "bend", "until")
    known = found.select(*keys, F.col("pos").alias("pos"), curve.alias("_curve"))
    joined = rows.drop("_chunk", "pos_last").join(known, [*keys, "pos"], "left").drop("pos")
    near = neighbours(joined, keys, "_curve", ts)
    x = F.col("pos") if axis == "row" else F.unix_date(ts)
    between = F.col("prev_value").isNotNull() & F.col("next_value").isNotNull()
    filled = F.coalesce(F.col(value), F.when(between, estimate(F.col("prev_value"), F.col("next_value"), x)))
    return near.select(*cells.columns, filled.alias("filled"))
