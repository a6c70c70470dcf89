"""Features, scaling and sequences for a forecasting model.

Rolling and lag features look back a bounded number of rows, so they run on chunks with a
halo of as many rows; a long series is spread over tasks. A panel that is known to have a
row for every day (``regular``) takes a halo of days, which saves numbering its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scan import drop_halo, with_halo, with_row_halo
from lacuna.operators.masking import WET_MONTHS
from lacuna.sources.files import join_stats

# Rolling windows, lags and the stress threshold in degrees.
ROLLING_ROWS = (7, 14, 30)
LAG_ROWS = (1, 7, 14, 30)
STRESS_ABOVE = 29.5


def site_delta(wide: DataFrame, variables: Sequence[str], a: str, b: str) -> DataFrame:
    """``delta_<variable>`` = value at site a - value at site b."""
    return wide.select("*", *[(F.col(f"{v}_{a}") - F.col(f"{v}_{b}")).alias(f"delta_{v}") for v in variables])


def _look_back(df: DataFrame, rows: int, keys: Sequence[str], regular: bool) -> tuple[DataFrame, Window]:
    halo = with_halo(df, rows) if regular else with_row_halo(df, rows, keys)
    return halo, Window.partitionBy(*keys, "_chunk").orderBy("obs_date")


def rolling(
    df: DataFrame, columns: Sequence[str], rows: Sequence[int] = ROLLING_ROWS, keys: Sequence[str] = ("location",), regular: bool = False
) -> DataFrame:
    """Mean and sample deviation over the last n rows including the current one; the
    deviation of a single value is 0. All windows share one exchange and one sort."""
    halo, w = _look_back(df, max(rows), keys, regular)
    out = []
    for c in columns:
        for n in rows:
            frame = w.rowsBetween(-(n - 1), 0)
            out.append(F.avg(c).over(frame).alias(f"{c}_mean{n}"))
            out.append(F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)).alias(f"{c}_std{n}"))
    return drop_halo(halo.select("*", *out))


def lags(
    df: DataFrame, columns: Sequence[str], rows: Sequence[int] = LAG_ROWS, keys: Sequence[str] = ("location",), regular: bool = False
) -> DataFrame:
    """Earlier values; a missing one takes the mean of that lag column in its series."""
    halo, w = _look_back(df, max(rows), keys, regular)
    names = {f"{c}_lag{n}": F.lag(c, n).over(w) for c in columns for n in rows}
    lagged = drop_halo(halo.select("*", *[e.alias(n) for n, e in names.items()]))
    return lagged.select(*df.columns, *[_or_mean(n, keys).alias(n) for n in names])


def _or_mean(name: str, keys: Sequence[str]) -> Column:
    """The value, or the mean of its series: one row per day, so a bounded group. As a
    window it reads the rows at hand, where a joined aggregate would scan the panel again."""
    return F.coalesce(F.col(name), F.avg(name).over(Window.partitionBy(*keys)))


def calendar(df: DataFrame, ts: str = "obs_date") -> DataFrame:
    m = F.month(ts)
    return df.select(
        "*", F.dayofyear(ts).alias("day_of_year"), m.alias("month"), m.isin(*WET_MONTHS).cast("int").alias("is_wet_season")
    )


def derived(
    df: DataFrame, anomaly: str, stress: str, above: float = STRESS_ABOVE, rows: int = 30, keys: Sequence[str] = ("location",), regular: bool = False
) -> DataFrame:
    """Departure from the rolling mean, and the excess over a threshold."""
    halo, w = _look_back(df, rows, keys, regular)
    mean = F.avg(anomaly).over(w.rowsBetween(-(rows - 1), 0))
    excess = F.when(F.col(stress).isNotNull(), F.greatest(F.lit(0.0), F.col(stress) - F.lit(float(above))))
    return drop_halo(halo.select("*", (F.col(anomaly) - mean).alias(f"{anomaly}_anomaly"), excess.alias(f"{stress}_stress")))


def imputation_flags(df: DataFrame, mask: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``<variable>_was_imputed``: 1 where the cell mask says so, 0 otherwise."""
    flags = mask.filter("is_masked").groupBy("location", "obs_date").agg(
        *[F.max(F.when(F.col("variable") == v, 1)).alias(f"_f_{v}") for v in variables]
    )
    return df.join(flags, ["location", "obs_date"], "left").select(
        *df.columns, *[F.coalesce(F.col(f"_f_{v}"), F.lit(0)).alias(f"{v}_was_imputed") for v in variables]
    )


def feature_matrix(
    panel: DataFrame, columns: Sequence[str], mask: DataFrame | None = None, anomaly: str | None = None,
    stress: str | None = None, above: float = STRESS_ABOVE, regular: bool = False,
) -> DataFrame:
    """Rolling, lag, calendar, derived and flag columns in a fixed order, in one halo pass
    for everything that looks back."""
    keys = ("location",)
    halo, w = _look_back(panel, max(*ROLLING_ROWS, *LAG_ROWS), keys, regular)
    cols, lag_names = [], []
    for c in columns:
        for n in ROLLING_ROWS:
            frame = w.rowsBetween(-(n - 1), 0)
            cols.append(F.avg(c).over(frame).alias(f"{c}_mean{n}"))
            cols.append(F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)).alias(f"{c}_std{n}"))
    for c in columns:
        for n in LAG_ROWS:
            lag_names.append(f"{c}_lag{n}")
            cols.append(F.lag(c, n).over(w).alias(f"{c}_lag{n}"))
    if anomaly:
        cols.append((F.col(anomaly) - F.avg(anomaly).over(w.rowsBetween(-29, 0))).alias(f"{anomaly}_anomaly"))
    if stress:
        cols.append(
            F.when(F.col(stress).isNotNull(), F.greatest(F.lit(0.0), F.col(stress) - F.lit(float(above)))).alias(f"{stress}_stress")
        )
    full = drop_halo(halo.select("*", *cols))
    full = full.select(*[_or_mean(c, keys).alias(c) if c in lag_names else F.col(c) for c in full.columns])
    full = calendar(full)
    return imputation_flags(full, mask, columns) if mask is not None else full


def train_test(matrix: DataFrame, splits: Column, target: str, features: Sequence[str]) -> DataFrame:
    """Rows with their split and role; rows without target go, missing features become 0."""
    from lacuna.operators.splits import assign_roles

    known = matrix.filter(F.col(target).isNotNull())
    return assign_roles(known, splits).fillna(0.0, subset=list(features))


class MinMax:
    """Min-max scaling per split, fitted on training rows; a constant column keeps scale 1."""

    def __init__(self, stats: DataFrame, columns: Sequence[str], lo: float, hi: float):
        self.stats, self.columns, self.lo, self.hi = stats, list(columns), lo, hi

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str], by: Sequence[str] = ("split_num",), lo: float = 0.0, hi: float = 1.0) -> MinMax:
        aggs = [f(c).alias(f"_{t}_{c}") for c in columns for t, f in (("lo", F.min), ("hi", F.max))]
        return MinMax(train.groupBy(*by).agg(*aggs), columns, lo, hi)

    def transform(self, df: DataFrame, by: Sequence[str] = ("split_num",), missing_as_zero: bool = True) -> DataFrame:
        """Test values may leave the range. Missing values stay out of the fit and become 0
        after scaling, which is how a model without imputation reads them."""
        joined = join_stats(df, self.stats, by, "inner")
        out = []
        for c in df.columns:
            if c not in self.columns:
                out.append(F.col(c))
                continue
            span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
            span = F.when(span == 0, F.lit(1.0)).otherwise(span)
            z = (F.col(c) - F.col(f"_lo_{c}")) / span * F.lit(self.hi - self.lo) + F.lit(self.lo)
            out.append((F.coalesce(z, F.lit(0.0)) if missing_as_zero else z).alias(c))
        return joined.select(*out)


def sequences(df: DataFrame, columns: Sequence[str], label: str, length: int = 30, key: str = "location", ts: str = "obs_date") -> DataFrame:
    """Windows of ``length`` consecutive rows with the label and date of the next row.

    Rows are consecutive in the labelled data, so a window may span missing days. A
    site's rows number at most one per calendar day, and each frame holds ``length``.
    """
    w = Window.partitionBy(key).orderBy(ts)
    frame = w.rowsBetween(-(length - 1), 0)
    rows = df.select(
        key, F.col(ts).alias("window_end"), F.lead(ts).over(w).alias("target_date"), F.lead(label).over(w).alias("target"),
        F.collect_list(F.struct(*columns)).over(frame).alias("sequence"),
    )
    return rows.filter((F.size("sequence") == length) & F.col("target_date").isNotNull())


def padded_sequence(df: DataFrame, columns: Sequence[str], length: int = 30, key: str = "location", ts: str = "obs_date") -> DataFrame:
    """The newest ``length`` rows of each site as one array, repeating the first row on the
    left where there are fewer; missing values take the previous, next, mean, then 0.

    The rank is limited on the map side, so a site ships at most ``length`` rows a task.
    """
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))
    recent = df.withColumn("_r", r).filter(F.col("_r") <= length)
    w = Window.partitionBy(key).orderBy(ts)
    back = Window.partitionBy(key).orderBy(F.desc(ts))
    whole = Window.partitionBy(key)
    for c in columns:
        recent = recent.withColumn(
            c,
            F.coalesce(
                F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                F.last(c, True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
                F.avg(c).over(whole), F.lit(0.0),
            ),
        )
    rows = recent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(ts, *columns))).alias("_seq"))
    pad = F.array_repeat(F.element_at("_seq", 1), F.lit(length) - F.size("_seq"))
    return rows.select(key, F.concat(pad, F.col("_seq")).alias("sequence"))


def numeric_features(df: DataFrame, deny: Sequence[str]) -> list[str]:
    """Numeric columns that are not identifiers or labels."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in kinds and f.name not in deny]
