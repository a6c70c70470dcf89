"""Filling a series from its own past and future.

Every function takes a cell panel and returns it with a ``filled`` column: the
observed value where there is one, the estimate where the method has one, NULL
elsewhere. Series never leak into each other; the keys are part of each scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scan import exact_quantiles
from lacuna.operators.gaps import KEYS, neighbours, with_gaps
from lacuna.sources.files import join_stats, stored

HELPERS = (
    "pos", "pos_last", "gap_length",
    *[f"{p}_{f}" for p in ("before", "prev", "next", "after") for f in ("pos", "date", "value")],
)


def _done(rows: DataFrame, estimate: Column, value: str = "value", out: str = "filled") -> DataFrame:
    return rows.withColumn(out, F.coalesce(F.col(value), estimate)).drop(*HELPERS)


def _steps(axis: str, newer: str, older: str, ts: str = "obs_date") -> Column:
    """Distance between two points, in rows or days; ``""`` is the cell itself."""
    if axis == "row":
        at = lambda p: F.col(f"{p}_pos" if p else "pos")
        return at(newer) - at(older)
    at = lambda p: F.col(f"{p}_date" if p else ts)
    return F.datediff(at(newer), at(older))


def straight_line(axis: str = "row", ts: str = "obs_date") -> Column:
    """Between ``prev`` and ``next``; NULL unless both exist."""
    slope = F.try_divide(F.col("next_value") - F.col("prev_value"), _steps(axis, "next", "prev", ts))
    return F.col("prev_value") + slope * _steps(axis, "", "prev", ts)


def linear(
    cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", axis: str = "row",
    edges: str = "both", limit: int | None = None, ts: str = "obs_date",
) -> DataFrame:
    """Linear interpolation by row position (or by day with ``axis='day'``).

    ``edges``: ``both`` repeats the nearest value, ``trailing`` only after the last
    observation, ``none`` leaves both ends. ``limit`` fills only cells at most that
    many steps from an observation on either side; their values still come from the
    full gap.
    """
    rows = neighbours(cells, keys, value, ts)
    estimate = straight_line(axis, ts)
    if edges == "both":
        estimate = F.coalesce(estimate, F.col("prev_value"), F.col("next_value"))
    elif edges == "trailing":
        estimate = F.coalesce(estimate, F.col("prev_value"))
    if limit is not None:
        estimate = F.when(F.least(_steps(axis, "", "prev", ts), _steps(axis, "next", "", ts)) <= limit, estimate)
    return _done(rows, estimate, value)


def _parabola(axis: str, ts: str = "obs_date") -> Column:
    """Quadratic through two observations before and one after, else one before and
    two after; NULL where neither exists."""
    def through(a: str, b: str, c: str) -> Column:
        xa, xb, xc = (_steps(axis, "", p, ts) for p in (a, b, c))
        ab, ac, bc = _steps(axis, a, b, ts), _steps(axis, a, c, ts), _steps(axis, b, c, ts)
        return (
            F.try_divide(F.col(f"{a}_value") * (xb * xc), ab * ac)
            - F.try_divide(F.col(f"{b}_value") * (xa * xc), ab * bc)
            + F.try_divide(F.col(f"{c}_value") * (xa * xb), ac * bc)
        )

    both = F.col("prev_value").isNotNull() & F.col("next_value").isNotNull()
    return F.when(both & F.col("before_value").isNotNull(), through("before", "prev", "next")).when(
        both & F.col("after_value").isNotNull(), through("prev", "next", "after")
    )


def quadratic(
    cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", axis: str = "row", ts: str = "obs_date"
) -> DataFrame:
    """Local order-2 polynomial; linear where a series has fewer than three points; ends
    stay missing. It uses the three closest known points, where a global spline would
    have to solve one system over the whole series."""
    rows = neighbours(cells, keys, value, ts, depth=2)
    return _done(rows, F.coalesce(_parabola(axis, ts), straight_line(axis, ts)), value)


def ffill_bfill(cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", ts: str = "obs_date") -> DataFrame:
    rows = neighbours(cells, keys, value, ts)
    return _done(rows, F.coalesce(F.col("prev_value"), F.col("next_value")), value)


def _join_mean(cells: DataFrame, source: DataFrame, by: dict[str, Column], value: str, out: str) -> DataFrame:
    """Attach the mean of ``source[value]`` over the named expressions.

    The mean table is pre-aggregated on the map side; whether it is broadcast is left
    to its measured size.
    """
    stats = source.groupBy(*[e.alias(f"_k_{k}") for k, e in by.items()]).agg(F.avg(value).alias(out))
    keyed = cells
    for k, e in by.items():
        keyed = keyed.withColumn(f"_k_{k}", e)
    keys = [f"_k_{k}" for k in by]
    return keyed.join(stats, keys, "left").drop(*keys)


def climatology_doy(
    cells: DataFrame, source: DataFrame | None = None, source_value: str = "value", pool_locations: bool = False
) -> DataFrame:
    """Mean of the same day of year in ``source`` (default: the panel itself).

    ``pool_locations`` averages over all sites. A day of year never observed stays NULL.
    """
    by = {"variable": F.col("variable"), "doy": F.dayofyear("obs_date")}
    if not pool_locations:
        by["location"] = F.col("location")
    src = (source if source is not None else cells).select(
        "location", "variable", "obs_date", F.col(source_value).alias("_src")
    )
    return _done(_join_mean(cells, src, by, "_src", "_mean"), F.col("_mean")).drop("_mean")


def climatology_month_day(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the same month and day in other years; 29 February only meets itself."""
    md = Window.partitionBy(*keys, F.month("obs_date"), F.dayofmonth("obs_date"))
    return _done(cells, F.avg("value").over(md))


def three_phase(cells: DataFrame, limit: int = 14) -> DataFrame:
    """Limited interpolation, then location-month mean, location mean, global mean.

    Each mean is over the output of the phase before it. All three follow from one
    table of counts and sums per (variable, location, month), so the panel is
    aggregated once.
    """
    first = linear(cells, limit=limit).withColumnRenamed("filled", "_p1").withColumn("_month", F.month("obs_date"))
    monthly = first.groupBy("variable", "location", "_month").agg(
        F.count(F.lit(1)).alias("n"), F.count("_p1").alias("c"), F.sum("_p1").alias("s")
    )
    by_loc = Window.partitionBy("variable", "location")
    n2 = F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0))
    s2 = F.when(F.col("c") > 0, F.col("s") / F.col("c") * F.col("n")).otherwise(F.lit(0.0))
    means = (
        monthly.withColumn("_m1", F.col("s") / F.col("c"))
        .withColumn("_c2", F.sum(n2).over(by_loc))
        .withColumn("_s2", F.sum(s2).over(by_loc))
        .withColumn("_m2", F.try_divide("_s2", "_c2"))
    )
    per_loc = means.groupBy("variable", "location").agg(
        F.sum("n").alias("n"), F.max("_c2").alias("c2"), F.max("_m2").alias("m2")
    )
    total = per_loc.groupBy("variable").agg(
        F.try_divide(
            F.sum(F.when(F.col("c2") > 0, F.col("m2") * F.col("n"))), F.sum(F.when(F.col("c2") > 0, F.col("n")))
        ).alias("_m3")
    )
    lookup = means.select("variable", "location", "_month", "_m1", "_m2").join(total, "variable")
    rows = first.join(lookup, ["variable", "location", "_month"])
    return rows.withColumn("filled", F.coalesce("_p1", "_m1", "_m2", "_m3")).drop("_p1", "_m1", "_m2", "_m3", "_month")


class MeanImputer:
    """Location-month, location and global means, fitted on one set of rows and applied
    to another, so that test rows never influence their own fill."""

    def __init__(self, stats: DataFrame):
        self.stats = stats

    @staticmethod
    def fit(train: DataFrame, value: str = "value") -> MeanImputer:
        stats = train.groupBy("variable", "location", F.month("obs_date").alias("month")).agg(
            F.count(value).alias("c"), F.sum(value).alias("s")
        )
        return MeanImputer(stats)

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """Per series its mean and a map month -> mean (12 entries at most); per variable
        the global mean."""
        entry = F.when(F.col("c") > 0, F.struct("month", (F.col("s") / F.col("c")).alias("mean")))
        series = self.stats.groupBy("variable", "location").agg(
            F.map_from_entries(F.collect_list(entry)).alias("_months"),
            F.sum("s").alias("_s"), F.sum("c").alias("_c"),
        )
        every = series.groupBy("variable").agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("_g"))
        return series.select("variable", "location", "_months", F.try_divide("_s", "_c").alias("_l")), every

    def transform(self, cells: DataFrame, value: str = "value", out: str = "filled") -> DataFrame:
        series, every = self.tables()
        return (
            join_stats(cells.join(series, ["variable", "location"], "left"), every, ["variable"])
            .withColumn(out, F.coalesce(F.col(value), F.try_element_at("_months", F.month("obs_date")), "_l", "_g"))
            .drop("_months", "_l", "_g")
        )


def gap_adaptive(
    cells: DataFrame, short: int = 7, long: int = 30, axis: str = "day", keys: Sequence[str] = KEYS
) -> DataFrame:
    """By gap length: under ``short`` linear, up to ``long`` quadratic, beyond it the
    month-day climatology; what remains takes the previous, then the next value.

    Each gap gets its own method, whatever other gaps the series has.
    """
    rows = with_gaps(cells, keys, depth=2)
    md = Window.partitionBy(*keys, F.month("obs_date"), F.dayofmonth("obs_date"))
    rows = rows.withColumn("_md", F.avg("value").over(md))
    line = straight_line(axis)
    estimate = (
        F.when(F.col("gap_length") < short, line)
        .when(F.col("gap_length") <= long, F.coalesce(_parabola(axis), line))
        .otherwise(F.col("_md"))
    )
    # What is still open takes the nearest repaired cell, which may be an estimate: a
    # second pass, over a written table so that the first one is not run for each branch.
    first = stored(cells.sparkSession, _done(rows, estimate).drop("_md"), "adaptive")
    again = ffill_bfill(first.withColumnRenamed("filled", "_once"), keys, value="_once")
    return again.drop("_once")


def median_fill(cells: DataFrame, value: str = "value", by: Sequence[str] = ("variable",)) -> DataFrame:
    """Exact median of each variable over all locations, as the last resort."""
    medians = exact_quantiles(cells, list(by), value, {"_median": 0.5})
    return _done(join_stats(cells, medians, by), F.col("_median"), value).drop("_median")


def nowcast(
    history: DataFrame, run_date: Column, max_gap: int = 14, persist_days: int = 2, points: int = 5,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Estimate each series at ``run_date`` from its last few observations.

    Up to ``persist_days`` old: the last value. Up to ``max_gap``: the straight line
    through the last ``points`` values, kept within their range widened by a quarter.
    Older: NULL. The top-``points`` rank is limited on the map side by Spark.
    """
    seen = history.filter(F.col("value").isNotNull() & (F.col("obs_date") <= run_date))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("obs_date")))
    recent = seen.withColumn("_r", rank).filter(F.col("_r") <= points)
    first = F.min("obs_date").over(Window.partitionBy(*keys))
    x = F.datediff("obs_date", "_x0").cast("double")
    fit = (
        recent.withColumn("_x0", first)
        .groupBy(*keys)
        .agg(
            F.max("obs_date").alias("last_date"),
            F.max_by("value", "obs_date").alias("last_value"),
            F.count(F.lit(1)).alias("n"),
            F.max("_x0").alias("x0"),
            F.regr_slope(F.col("value"), x).alias("slope"),
            F.regr_intercept(F.col("value"), x).alias("intercept"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
        )
    )
    gap = F.datediff(run_date, F.col("last_date"))
    pad = F.lit(0.25) * F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    trend = F.col("intercept") + F.col("slope") * F.datediff(run_date, F.col("x0"))
    clamped = F.least(F.greatest(trend, F.col("lo") - pad), F.col("hi") + pad)
    estimate = F.when(gap > max_gap, F.lit(None)).when(
        (gap <= persist_days) | (F.col("n") < 2), F.col("last_value")
    ).otherwise(clamped)
    return fit.select(*keys, "last_date", "last_value", gap.alias("gap_days"), estimate.alias("nowcast"))


# Provenance labels, in order of priority.
PROVENANCE = (
    "observed",
    "temporal_short_gap",
    "climatological_location_month",
    "climatological_location",
    "climatological_global",
)


def with_fallbacks(history: DataFrame, run_date: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per series at ``run_date``: the observed value, else the nowcast, else the
    location-month, location or global mean, and the label of the source used."""
    series, every = MeanImputer.fit(history).tables()
    now = nowcast(history, run_date).select(
        *keys, F.when(F.col("gap_days") == 0, F.col("last_value")).alias("_obs"), F.col("nowcast").alias("_now")
    )
    full = series.join(now, list(keys), "left").join(every, "variable").withColumn("obs_date", run_date)
    full = full.withColumn("_lm", F.try_element_at("_months", F.month("obs_date")))
    ladder = ["_obs", "_now", "_lm", "_l"]
    label = F.lit(PROVENANCE[-1])
    for col, name in reversed(list(zip(ladder, PROVENANCE))):
        label = F.when(F.col(col).isNotNull(), F.lit(name)).otherwise(label)
    return full.select(*keys, "obs_date", F.coalesce(*ladder, "_g").alias("value"), label.alias("source"))
