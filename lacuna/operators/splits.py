"""Rolling-origin, yearly and date-index train/test splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RollingOrigin:
    window_days: int = 90
    num_splits: int = 4


def date_bounds(df: DataFrame, ts: str = "obs_date") -> tuple[Column, Column]:
    """First and last day as scalar subqueries: no join, nothing on the driver."""
    return df.select(F.min(ts)).scalar(), df.select(F.max(ts)).scalar()


def rolling_splits(
    df: DataFrame, plan: RollingOrigin, bounds: tuple[Column, Column] | None = None, ts: str = "obs_date"
) -> Column:
    """Array of (split_num, cutoff, test_start, test_end), spaced evenly over the range.

    step = (days - window) // (splits + 1); cutoff_i = first day + i * step; the test
    window is the ``window_days`` days after the cutoff.
    """
    first, last = bounds or date_bounds(df, ts)
    step = F.floor((F.datediff(last, first) - plan.window_days) / (plan.num_splits + 1)).cast("int")

    items = []
    for i in range(1, plan.num_splits + 1):
        cutoff = F.date_add(first, step * i)
        items.append(
            F.struct(
                F.lit(i).alias("split_num"), cutoff.alias("cutoff"), F.date_add(cutoff, 1).alias("test_start"),
                F.date_add(cutoff, plan.window_days).alias("test_end"),
            )
        )
    return F.array(*items)


def yearly_splits(first_test_year: int, count: int, last_span_years: int = 1) -> Column:
    """Expanding windows: train to the end of a year, test on the next one."""
    items = []
    for i in range(count):
        year = first_test_year + i
        end = year + (last_span_years - 1 if i == count - 1 else 0)
        items.append(
            F.struct(
                F.lit(i + 1).alias("split_num"),
                F.lit(f"{year - 1}-12-31").cast("date").alias("cutoff"),
                F.lit(f"{year}-01-01").cast("date").alias("test_start"),
                F.lit(f"{end}-12-31").cast("date").alias("test_end"),
            )
        )
    return F.array(*items)


def date_index_splits(
    df: DataFrame, num_splits: int = 6, test_days: int = 365, min_train: int = 365, ts: str = "obs_date"
) -> DataFrame:
    """Splits over the distinct dates, stepping back one date each time, numbered from
    the last. A split needs more than ``min_train`` dates before its cutoff.

    Dates are bounded by the calendar; only they are ranked.
    """
    from pyspark.sql import Window

    dates = df.filter(F.col(ts).isNotNull()).select(ts).distinct()
    w = Window.orderBy(ts)
    ranked = dates.select(ts, (F.row_number().over(w) - 1).alias("i"))
    total = dates.select(F.count(F.lit(1)).cast("int")).scalar()
    role = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("split_num"), (total - k).alias("end_i"), (total - k - test_days + 1).alias("start_i")
                )
                for k in range(1, num_splits + 1)
            ]
        )
    )
    at = lambda idx: F.max(F.when(F.col("i") == idx, F.col(ts)))
    s = F.col("s")
    return (
        ranked.select(ts, "i", role.alias("s"))
        .filter((s.start_i - 1 >= min_train) & F.col("i").isin(s.end_i, s.start_i, s.start_i - 1))
        .groupBy(s.split_num.alias("split_num"))
        .agg(at(s.start_i - 1).alias("cutoff"), at(s.start_i).alias("test_start"), at(s.end_i).alias("test_end"))
    )


def window_membership(ts: str, split: str) -> Column:
    """True where ``ts`` falls in the test window of the split struct."""
    return F.col(ts).between(F.col(f"{split}.test_start"), F.col(f"{split}.test_end"))


def assign_roles(df: DataFrame, splits: Column, ts: str = "obs_date") -> DataFrame:
    """Each row once per split it takes part in, with ``role`` train or test.

    The handful of splits is an array in the plan; rows are expanded, not joined.
    """
    d = F.col(ts)
    used = F.filter(splits, lambda s: (d <= s.cutoff) | d.between(s.test_start, s.test_end))
    return df.withColumn("_s", F.explode(used)).select(
        *df.columns, F.col("_s.split_num").alias("split_num"),
        F.when(d <= F.col("_s.cutoff"), F.lit("train")).otherwise(F.lit("test")).alias("role"),
    )


def inner_validation(df: DataFrame, share: float, by: Sequence[str], ts: str = "obs_date") -> DataFrame:
    """Mark the last ``1 - share`` of each group's rows, in date order, as validation.

    One row per (group, date): a group has no more rows than the calendar has days.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    return (
        df.withColumn("_i", F.row_number().over(w.orderBy(ts)))
        .withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("is_validation", F.col("_i") > F.floor(F.col("_n") * F.lit(float(share))))
        .drop("_i", "_n")
    )
