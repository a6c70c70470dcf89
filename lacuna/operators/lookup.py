"""As-of lookups: bounded look-back, nearest date, trailing windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scan import drop_halo, with_halo


def asof(
    targets: DataFrame, readings: DataFrame, values: Sequence[str], tolerance_days: int = 7,
    key: str = "location", ts: str = "obs_date",
) -> DataFrame:
    """Newest reading at or before each target day, at most ``tolerance_days`` old.

    ``readings`` holds one row per key and day. Each is offered to the
    ``tolerance_days + 1`` days it may serve; the join is then a plain equality on
    (key, day), spread over the days of a hot key, with no band join.
    """
    serve = F.explode(F.sequence(F.lit(0), F.lit(tolerance_days))).alias("age_days")
    offered = readings.filter(F.col(values[0]).isNotNull()).select(
        key, F.col(ts).alias("source_date"), serve, *values
    ).withColumn(ts, F.date_add("source_date", F.col("age_days")))
    newest = offered.groupBy(key, ts).agg(
        F.max_by(F.struct("source_date", "age_days", *values), F.col("source_date")).alias("hit")
    )
    return targets.join(newest, [key, ts], "left").select(
        *targets.columns, *[F.col(f"hit.{c}").alias(c) for c in ("source_date", "age_days", *values)]
    )


def nearest_date(
    targets: DataFrame, readings: DataFrame, values: Sequence[str], key: str = "location", ts: str = "obs_date"
) -> DataFrame:
    """Closest reading in time on either side, without limit; on a tie the earlier date.

    Targets and readings share one time line (union, then two ordered scans), so the
    work is linear in their number instead of their product.
    """
    from lacuna.functions.scan import chunked, nearest

    mark = F.struct(F.col(ts).alias("d"), *values)
    line = targets.select(key, ts, F.lit(None).cast("boolean").alias("_r")).withColumn("_t", F.lit(True))
    both = line.join(
        readings.filter(F.col(values[0]).isNotNull()).select(key, ts, mark.alias("_hit")), [key, ts], "full_outer"
    )
    rows = nearest(chunked(both, [key], ts), [key], "_hit", ts=ts)
    left, right = F.datediff(ts, "prev.d"), F.datediff("next.d", ts)
    best = F.when(right < left, F.col("next")).otherwise(F.coalesce("prev", "next"))
    picked = rows.filter("_t").select(key, ts, best.alias("best"))
    return picked.select(
        key, ts, F.col("best.d").alias("source_date"),
        F.abs(F.datediff(ts, "best.d")).alias("days_apart"), *[F.col(f"best.{v}").alias(v) for v in values],
    )


def by_alias(df: DataFrame, aliases: DataFrame, key: str = "location") -> DataFrame:
    """``df`` with the name that ``aliases`` (alias, name) gives its ``key`` as ``key``, and the given one as ``alias``.

    A name the table does not know has a null ``key``, so that lookups by it come back empty.
    """
    known = aliases.select(F.col("alias").alias("_alias"), F.col("name").alias("_name"))
    joined = df.withColumnRenamed(key, "alias").join(known, F.col("alias") == F.col("_alias"), "left")
    return joined.withColumn(key, F.col("_name")).drop("_alias", "_name")


def trailing(
    daily: DataFrame, reductions: dict[str, tuple[Column, int]], key: str = "location", ts: str = "obs_date"
) -> DataFrame:
    """Reductions over the ``k`` days before each row: the window is [t-k, t)."""
    longest = max(k for _, k in reductions.values())
    rows = with_halo(daily.withColumn("_x", F.unix_date(ts)), longest, ts)
    base = Window.partitionBy(key, "_chunk").orderBy("_x")
    cols = [agg.over(base.rangeBetween(-k, -1)).alias(name) for name, (agg, k) in reductions.items()]
    return drop_halo(rows.select(key, ts, "_chunk", "_halo", *cols))
