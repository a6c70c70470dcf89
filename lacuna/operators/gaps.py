"""Finding gaps, and the nearest observations on either side of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scan import CHUNK_DAYS, UNBOUNDED, chunked

KEYS = ("location", "variable")


def _shift(point: Column, base: Column, inner: str | None = None) -> Column:
    """Chunk-local positions of an observation (and of the one beyond it) to series ones."""
    moved = point.withField("pos", point["pos"] + base)
    if inner:
        deep = point[inner]
        moved = moved.withField(inner, F.when(deep.isNotNull(), deep.withField("pos", deep["pos"] + base)))
    return F.when(point.isNotNull(), moved)


def neighbours(
    cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", ts: str = "obs_date", depth: int = 1,
    span_days: int = CHUNK_DAYS,
) -> DataFrame:
    """Add ``pos`` (0-based row of the series), ``pos_last``, and for the closest observed
    cell at or before (``prev``) and at or after (``next``) its ``_pos``, ``_date`` and
    ``_value``. With ``depth=2`` also those of the observations beyond: ``before``, ``after``.

    One exchange on (keys, chunk) and one sort per direction. A chunk sums up to one row
    (its size, first and last observation) from that same exchange; the summaries of a
    series, one per ``span_days``, carry positions and observations across chunk borders.
    """
    part = [*keys, "_chunk"]
    up = Window.partitionBy(*part).orderBy(ts)
    down = Window.partitionBy(*part).orderBy(F.desc(ts))
    upto, beyond = (UNBOUNDED, 0), (UNBOUNDED, -1)
    rows = chunked(cells, keys, ts, span_days).withColumn("_rn", F.row_number().over(up).cast("long"))
    point = F.when(
        F.col(value).isNotNull(), F.struct(F.col("_rn").alias("pos"), F.col(ts).alias("obs_date"), F.col(value).alias("value"))
    )
    rows = rows.withColumn("_obs", point)
    if depth == 2:
        near = lambda w: F.last("_obs", ignorenulls=True).over(w.rowsBetween(*beyond))
        deeper = lambda name, w: F.when(F.col("_obs").isNotNull(), F.struct("_obs.*", near(w).alias(name)))
        rows = rows.withColumn("_lo", deeper("before", up))
        rows = rows.withColumn("prev", F.last("_lo", ignorenulls=True).over(up.rowsBetween(*upto)))
        rows = rows.withColumn("_hi", deeper("after", down))
        rows = rows.withColumn("next", F.last("_hi", ignorenulls=True).over(down.rowsBetween(*upto)))
    else:
        rows = rows.withColumn("prev", F.last("_obs", ignorenulls=True).over(up.rowsBetween(*upto)))
        rows = rows.withColumn("next", F.last("_obs", ignorenulls=True).over(down.rowsBetween(*upto)))
        rows = rows.withColumn("_lo", F.col("_obs")).withColumn("_hi", F.col("_obs"))

    seen = F.when(F.col("_obs").isNotNull(), F.col(ts))
    ends = rows.groupBy(*part).agg(
        F.max("_rn").alias("_n"), F.max_by("_lo", seen).alias("_last"), F.min_by("_hi", seen).alias("_first")
    )
    series = Window.partitionBy(*keys)
    lower = series.orderBy("_chunk").rowsBetween(*beyond)
    upper = series.orderBy(F.desc("_chunk")).rowsBetween(*beyond)
    base = F.coalesce(F.sum("_n").over(lower), F.lit(0)) - 1
    ends = ends.withColumn("_base", base).withColumn("pos_last", F.sum("_n").over(series) - 1)
    inner_lo, inner_hi = ("before", "after") if depth == 2 else (None, None)
    ends = ends.withColumn("_last", _shift(F.col("_last"), F.col("_base"), inner_lo)).withColumn(
        "_first", _shift(F.col("_first"), F.col("_base"), inner_hi)
    )
    from_left = lambda: F.last("_last", ignorenulls=True).over(lower)
    from_right = lambda: F.last("_first", ignorenulls=True).over(upper)
    if depth == 2:
        ends = ends.withColumn("_c", from_left()).withColumn("_last", _beyond("_last", "before", "_c"))
        ends = ends.withColumn("_c", from_right()).withColumn("_first", _beyond("_first", "after", "_c"))
    ends = ends.withColumn("_left", from_left()).withColumn("_right", from_right())

    out = rows.drop("_obs", "_lo", "_hi").join(
        ends.select(*part, "_base", "pos_last", "_left", "_right").hint("merge"), part
    )
    flat = [(F.col("_rn") + F.col("_base")).alias("pos"), F.col("pos_last")]
    for side, carried, far, inner in (("prev", "_left", "before", inner_lo), ("next", "_right", "after", inner_hi)):
        flat += [x.alias(f"{side}_{name}") for name, x in _fields(F.col(side), F.col(carried), F.col("_base"))]
        if inner:
            local = F.col(side).isNotNull()
            near = _fields(F.col(side)[inner], F.col(carried), F.col("_base"))
            flat += [
                F.when(local, x).otherwise(F.col(carried)[inner][f]).alias(f"{far}_{name}")
                for (name, x), f in zip(near, ("pos", "obs_date", "value"))
            ]
    return out.select(*cells.columns, *flat)


def _beyond(point: str, inner: str, carried: str) -> Column:
    """Where the observation beyond lies in another chunk, take the carried one."""
    p, c = F.col(point), F.col(carried)
    flat = F.when(c.isNotNull(), F.struct(*[c[f].alias(f) for f in ("pos", "obs_date", "value")]))
    return F.when(p.isNotNull(), p.withField(inner, F.coalesce(p[inner], flat)))


def _fields(local: Column, carried: Column, base: Column) -> list[tuple[str, Column]]:
    """Position, date and value of an observation found in the chunk, else of the carried
    one. Plain columns: formulas built on them stay small after projections merge."""
    return [
        ("pos", F.coalesce(local["pos"] + base, carried["pos"])),
        ("date", F.coalesce(local["obs_date"], carried["obs_date"])),
        ("value", F.coalesce(local["value"], carried["value"])),
    ]


def gap_length(value: str = "value") -> Column:
    """Rows in the run of missing cells around a cell; NULL on observed cells."""
    upper = F.coalesce(F.col("next_pos"), F.col("pos_last") + 1)
    lower = F.coalesce(F.col("prev_pos"), F.lit(-1))
    return F.when(F.col(value).isNull(), (upper - lower - 1).cast("long"))


def with_gaps(
    cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", ts: str = "obs_date", depth: int = 1
) -> DataFrame:
    """:func:`neighbours` by row, plus ``gap_length``."""
    return neighbours(cells, keys, value, ts, depth).withColumn("gap_length", gap_length(value))


def gap_runs(cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", ts: str = "obs_date") -> DataFrame:
    """One row per contiguous run of missing cells: first day, last day, length.

    The position of the observation before a run identifies it, so runs are an
    aggregate with map-side combine, whatever their length.
    """
    rows = neighbours(cells, keys, value, ts).filter(F.col(value).isNull())
    return rows.groupBy(*keys, F.coalesce(F.col("prev_pos"), F.lit(-1)).alias("_run")).agg(
        F.min(ts).alias("gap_start"), F.max(ts).alias("gap_end"), F.count(F.lit(1)).alias("gap_length")
    ).drop("_run")
