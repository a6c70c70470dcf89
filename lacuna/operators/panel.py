"""Assembling panels: joins, unions, the daily spine, reshaping, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_COLUMNS = ("location", "obs_date")


def full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Rows of either side; columns a side does not know are NULL."""
    return left.join(right, list(keys), "full_outer")


def union_sites(frames: Sequence[DataFrame], ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Stack sites whose schemas may differ, ids first and the rest in name order."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return ordered_columns(stacked, ids)


def ordered_columns(df: DataFrame, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    return df.select(*ids, *sorted(c for c in df.columns if c not in ids))


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key. ``order`` must be unique within a key; it decides first and last.

    An aggregate rather than a window: copies are dropped before the shuffle, so a
    key that holds a third of all rows costs one row per task.
    """
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in df.columns if c not in keys]
    best = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[f"_row.{c}" for c in rest]).select(*df.columns)


def daily_spine(
    df: DataFrame, locations: DataFrame, start: Column, end: Column, ts: str = "obs_date"
) -> DataFrame:
    """Every location on every day of [start, end]; days without data become NULL rows.

    The site dimension and the two dates drive the spine, so the panel itself is
    evaluated once.
    """
    days = F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias(ts)
    return locations.select("location", days).join(df, ["location", ts], "left")


def to_cells(df: DataFrame, variables: Sequence[str], ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Wide to one row per cell. ``inline`` instead of ``unpivot``: filters on the ids pass
    it the same way in every branch of a plan, so branches can share an exchange."""
    pairs = [F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables]
    return df.select(*ids, F.inline(F.array(*pairs)))


def to_wide(cells: DataFrame, variables: Sequence[str], ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Cells back to one column per variable; the list is explicit, so no extra pass."""
    cols = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    return cells.groupBy(*ids).agg(*cols)


def sites_wide(df: DataFrame, variables: Sequence[str], locations: Sequence[str]) -> DataFrame:
    """One row per date with columns ``<variable>_<location>`` for the named locations."""
    cols = [
        F.max(F.when(F.col("location") == loc, F.col(v))).alias(f"{v}_{loc}")
        for v in variables
        for loc in locations
    ]
    return df.filter(F.col("location").isin(*locations)).groupBy("obs_date").agg(*cols)


def latest_per_location(df: DataFrame, ts: str = "obs_date") -> DataFrame:
    return dedup(df, ["location"], [ts])


def with_donor(cells: DataFrame, donors: DataFrame, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Each target cell beside its donor's cell of the same variable and day.

    Pairs come from the donor table, never from all pairs of sites, so the output is
    at most donors-per-target times the panel. A site without donor keeps its rows.

    Both sides have the panel's size, so they are sorted and merged: the planner takes a
    panel that was written for as large as its files, which compress well, and would send it whole through the driver.
    """
    other = cells.select(
        F.col("location").alias("donor"), "variable", "obs_date", *[F.col(c).alias(f"donor_{c}") for c in columns]
    )
    mine = cells.join(donors.withColumnRenamed("target", "location"), "location", "left")
    return mine.join(other.hint("merge"), ["donor", "variable", "obs_date"], "left")


def precedence_merge(
    base: DataFrame, sources: Sequence[tuple[str, DataFrame]], variables: Sequence[str],
    keys: Sequence[str] = ID_COLUMNS, base_label: str = "historical_latest",
) -> DataFrame:
    """Per variable the first source that has a value, the base last; ``source`` names
    what contributed: all sources that had a row joined by ``+``, else the base."""
    out = base
    for name, src in sources:
        cols = [F.col(v).alias(f"_{name}_{v}") for v in variables if v in src.columns]
        out = out.join(src.select(*keys, F.lit(name).alias(f"_{name}"), *cols), list(keys), "left")
    merged = []
    for v in variables:
        ranked = [F.col(f"_{name}_{v}") for name, src in sources if v in src.columns]
        merged.append(F.coalesce(*ranked, F.col(v)).alias(v))
    label = F.concat_ws("+", *[F.col(f"_{name}") for name, _ in sources])
    return out.select(*keys, *merged, F.when(label == "", F.lit(base_label)).otherwise(label).alias("source"))


# Live reading -> model input.
LIVE_FIELDS = {
    "SST": "thetao",
    "Salinity": "so",
    "Rainfall_mm": "precip_mm_day",
    "Wind_speed_ms": "wind_speed_ms",
    "Wind_u_ms": "wind_u_ms",
    "Wind_v_ms": "wind_v_ms",
}


def live_field_map(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text readings to model inputs: unreadable numbers become NULL, the chlorophyll
    proxy is |x| * 10, and one vegetation reading feeds both vegetation columns."""
    number = lambda c: F.col(c).try_cast("double")
    return readings.select(
        *keys,
        *[number(src).alias(dst) for src, dst in LIVE_FIELDS.items()],
        (F.abs(number("Chlorophyll_a_proxy")) * F.lit(10.0)).alias("CHL"),
        number("NDVI").alias("NDVI_daily"),
        number("NDVI").alias("NDVI_raw"),
    )
