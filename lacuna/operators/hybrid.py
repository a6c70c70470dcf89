"""Methods that combine a temporal and a spatial estimate, and the method registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators import joint, modes, spatial, temporal
from lacuna.operators.gaps import with_gaps
from lacuna.operators.panel import to_wide, with_donor

# Method key -> display name and family.
METHODS = {
    "linear": ("Linear Interpolation", "Temporal"),
    "climatology": ("Climatological Substitution", "Temporal"),
    "kriging": ("Spatial Kriging", "Spatial"),
    "cross_regression": ("Cross-Location Linear Regression", "Spatial"),
    "cross_knn": ("Cross-Location KNN", "Spatial"),
    "distance_weighted": ("Distance-Weighted Average", "Spatial"),
    "advection": ("Advection-Based", "Spatial"),
    "eof_pca": ("EOF/PCA Spatial Modes", "Spatial"),
    "hybrid_sequential": ("Hybrid: Sequential Temporal->Spatial", "Hybrid"),
    "hybrid_adaptive": ("Hybrid: Gap-Type Adaptive", "Hybrid"),
    "hybrid_ensemble": ("Hybrid: Temporal-Spatial Ensemble", "Hybrid"),
}


def _rename(df: DataFrame, to: str) -> DataFrame:
    return df.withColumnRenamed("filled", to)


HELPER = ("donor", "distance_km", "donor_value")


def _kriged(rows: DataFrame, donors: DataFrame, single: bool) -> DataFrame:
    return spatial.kriging(with_donor(rows, donors)).drop(*HELPER) if single else joint.kriging(rows, donors)


def _regressed(rows: DataFrame, donors: DataFrame, single: bool) -> DataFrame:
    return spatial.regression3(spatial.with_donor_lags(rows, donors, (1, 7))).drop(*HELPER) if single else joint.regression(rows, donors)


def sequential(cells: DataFrame, donors: DataFrame, edges: str = "none", single: bool = False) -> DataFrame:
    """Interpolate inside, then regress on the donors for what is left.

    With ``edges='both'`` interpolation leaves nothing but fully missing series. ``single``
    says that every target has at most one donor, which saves gathering them.
    """
    first = _rename(temporal.linear(cells, edges=edges), "_t")
    second = _regressed(first, donors, single)
    return second.withColumn("filled", F.coalesce("value", "_t", "filled")).drop("_t")


def ensemble_weight() -> Column:
    """Weight of the temporal estimate: .8 under 3 days, .3 over 14, else .5."""
    g = F.col("gap_length")
    return F.when(g < 3, F.lit(0.8)).when(g > 14, F.lit(0.3)).otherwise(F.lit(0.5))


def gap_ensemble(cells: DataFrame, donors: DataFrame, zero_fill: bool = False, single: bool = False) -> DataFrame:
    """Blend interpolation and kriging by gap length; where one is missing the other
    counts alone. ``zero_fill`` reads a missing leg as 0 instead."""
    rows = with_gaps(cells)
    line = F.coalesce(temporal.straight_line(), F.col("prev_value"), F.col("next_value"))
    rows = rows.withColumn("_t", line).drop(*[c for c in temporal.HELPERS if c != "gap_length"])
    both = _rename(_kriged(rows, donors, single), "_s")
    t, s = F.col("_t"), F.col("_s")
    if zero_fill:
        t, s = F.coalesce(t, F.lit(0.0)), F.coalesce(s, F.lit(0.0))
    w = ensemble_weight()
    blend = F.coalesce(w * t + (F.lit(1.0) - w) * s, t, s)
    return both.withColumn("filled", F.coalesce("value", blend)).drop("_t", "_s", "gap_length")


def leading_modes(cells: DataFrame, locations: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """:func:`modes.eof_fill` over the cells of the named sites and variables; other cells keep their values."""
    named = F.col("location").isin(*locations) & F.col("variable").isin(*variables)
    keys = ["location", "variable", "obs_date"]
    filled = modes.eof_fill(cells.filter(named).select(*keys, "value")).select(*keys, F.col("filled").alias("_e"))
    return cells.join(filled, keys, "left").withColumn("filled", F.coalesce("value", "_e")).drop("_e")


def similar_days(cells: DataFrame, donors: DataFrame, variables: Sequence[str]) -> DataFrame:
    """:func:`spatial.knn` for every variable of a cell panel, all of them as features."""
    wide = to_wide(cells, variables)
    fills = None
    for v in variables:
        one = spatial.knn(wide, donors, v, variables).select("location", F.lit(v).alias("variable"), "obs_date", F.col("filled").alias("_e"))
        fills = one if fills is None else fills.unionByName(one)
    return cells.join(fills, ["location", "variable", "obs_date"], "left").withColumn(
        "filled", F.coalesce("value", "_e")
    ).drop("_e")


def dispatch(
    cells: DataFrame, donors: DataFrame, mask_type: str, matrix: tuple[Sequence[str], Sequence[str]] | None = None, single: bool = False
) -> DataFrame:
    """Choose by gap pattern: random linear, block regression, seasonal the mean of
    climatology and regression, cross-variable the leading modes of ``matrix`` (sites,
    variables), rolling origin climatology; otherwise per series linear if its longest gap is at most 7 days, else
    climatology."""
    if mask_type.startswith("random"):
        return temporal.linear(cells)
    if mask_type.startswith("rolling_origin"):
        return temporal.climatology_doy(cells)
    if mask_type.startswith("block"):
        return _regressed(cells, donors, single)
    if mask_type == "seasonal":
        clim = _rename(temporal.climatology_doy(cells), "_c")
        reg = _rename(_regressed(clim, donors, single), "_r")
        mean = F.coalesce((F.col("_c") + F.col("_r")) / 2, F.col("_c"), F.col("_r"))
        return reg.withColumn("filled", F.coalesce("value", mean)).drop("_c", "_r")
    if mask_type == "cross_variable" and matrix is not None:
        return leading_modes(cells, *matrix)
    rows = with_gaps(cells)
    line = F.coalesce(temporal.straight_line(), F.col("prev_value"), F.col("next_value"))
    rows = rows.withColumn("_t", line).drop(*[c for c in temporal.HELPERS if c != "gap_length"])
    longest = rows.groupBy("location", "variable").agg(F.coalesce(F.max("gap_length"), F.lit(0)).alias("_max"))
    both = _rename(temporal.climatology_doy(rows), "_c").join(longest, ["location", "variable"])
    pick = F.when(F.col("_max") <= 7, F.col("_t")).otherwise(F.col("_c"))
    return both.withColumn("filled", F.coalesce("value", pick)).drop("_t", "_c", "_max", "gap_length")


def registry(
    donors: DataFrame, matrix: tuple[Sequence[str], Sequence[str]] | None = None, single: bool = False
) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Method key -> function of a cell panel. The two methods that see all variables at
    once need ``matrix``, the names of the sites and variables."""
    view = lambda c: with_donor(c, donors)
    wide = {} if matrix is None else {
        "eof_pca": lambda c: leading_modes(c, *matrix),
        "cross_knn": lambda c: similar_days(c, donors, matrix[1]),
    }
    return {
        **wide,
        "linear": temporal.linear,
        "climatology": temporal.climatology_doy,
        "kriging": lambda c: _kriged(c, donors, single),
        "cross_regression": lambda c: _regressed(c, donors, single),
        "distance_weighted": lambda c: spatial.idw(view(c), [x for x in c.columns if x not in ("location", "variable", "obs_date", "value")]),
        "advection": lambda c: spatial.advection(c, donors),
        "hybrid_sequential": lambda c: sequential(c, donors, single=single),
        "hybrid_adaptive": temporal.gap_adaptive,
        "hybrid_ensemble": lambda c: gap_ensemble(c, donors, single=single),
    }


def impute(
    cells: DataFrame, method: str, donors: DataFrame, matrix: tuple[Sequence[str], Sequence[str]] | None = None, single: bool = False
) -> DataFrame:
    """Run a registered method, then previous/next fill, then the exact median."""
    first = registry(donors, matrix, single)[method](cells)
    rest = temporal.ffill_bfill(_rename(first, "_m"), value="_m").drop("_m")
    last = temporal.median_fill(_rename(rest, "_f"), value="_f")
    return last.drop("_f")
