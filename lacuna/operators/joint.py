"""Filling a site from all of its donors at once.

``donors`` may name any number of donors per target. The values of all of them, nearest
first, stand beside a target cell as one array, so a cell stays one row. A model per series is fitted from
one aggregate of second moments, a row for each pair of predictors, and solved on that
row by elimination in array expressions: nothing depends on how many donors there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scan import drop_halo, with_halo

SERIES = ("location", "variable")
CELL = ("location", "variable", "obs_date")
#: A pivot below this share of its variance says that a predictor follows from those before it.
COLLINEAR = 1e-9


def ranked(donors: DataFrame) -> DataFrame:
    """(location, donor, rank, of): the donors of a target by distance, then name, and their number."""
    w = Window.partitionBy("target")
    return donors.select(
        F.col("target").alias("location"), "donor", F.row_number().over(w.orderBy("distance_km", "donor")).alias("rank"),
        F.count(F.lit(1)).over(w).alias("of"),
    )


def with_predictors(cells: DataFrame, donors: DataFrame, lags: Sequence[int] = (0,), columns: Sequence[str] = ("value",)) -> DataFrame:
    """The cells with ``x_<column>``: the donors' values of the day at each of ``lags`` rows back.

    NULL unless every donor has all of them. Lags are rows of a panel with a row for every
    day. A target without donors has NULL as well.
    """
    offered, names = cells, []
    if any(lags):
        offered = with_halo(cells, max(lags))
        w = Window.partitionBy(*SERIES, "_chunk").orderBy("obs_date")
    for c in columns:
        row = F.array(*[F.lag(c, k).over(w) if k else F.col(c) for k in lags])
        offered = offered.withColumn(f"_x_{c}", row)
        names.append(f"_x_{c}")
    if any(lags):
        offered = drop_halo(offered)
    offered = offered.select(F.col("location").alias("donor"), "variable", "obs_date", *names)
    sets = offered.join(ranked(donors), "donor").groupBy(*CELL).agg(
        F.max("of").alias("_of"), F.sort_array(F.collect_list(F.struct("rank", *names))).alias("_sets")
    )
    out = cells.join(sets, list(CELL), "left")
    for c in columns:
        x = F.flatten(F.col(f"_sets._x_{c}"))
        whole = (F.size("_sets") == F.col("_of")) & F.forall(x, lambda v: v.isNotNull())
        out = out.withColumn(f"x_{c}", F.when(whole, x))
    return out.drop("_sets", "_of")


def moments(rows: DataFrame, y: str, x: str, by: Sequence[str] = SERIES) -> DataFrame:
    """One row per group: n, means of the predictors and of the target (last), covariances as a square matrix of all of them."""
    z = F.concat(F.col(x), F.array(F.col(y)))
    size = F.size(x) + 1
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(i, size - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get("_z", i).alias("a"), F.get("_z", j).alias("b")))))
    each = rows.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*by, z.alias("_z"), x).select(*by, F.inline(pairs))
    sums = each.groupBy(*by, "i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("m"), F.covar_pop("a", "b").alias("c"))
    whole = sums.groupBy(*by).agg(F.max("n").alias("n"), (F.max("i") + 1).alias("_size"), F.sort_array(F.collect_list(F.struct("i", "j", "m", "c"))).alias("_s"))
    place = lambda i, j: (i * F.col("_size") - (i * (i - 1) / 2).cast("int") + j - i).cast("int")
    every = F.sequence(F.lit(0), F.col("_size") - 1)
    means = F.transform(every, lambda i: F.get("_s", place(i, i))["m"])
    matrix = F.transform(every, lambda i: F.transform(every, lambda j: F.get("_s", place(F.least(i, j), F.greatest(i, j)))["c"]))
    return whole.select(*by, "n", means.alias("means"), matrix.alias("cov"))


def solve(cov: Column, scale: Column | None = None) -> Column:
    """Coefficients of the predictors from the covariances of predictors and target (last).

    Gauss-Jordan elimination on the rows of the predictors; the matrix is symmetric and positive, so pivots
    need no exchange. A predictor that follows from earlier ones, or does not vary, gets 0.
    """
    k = F.size(cov) - 1
    rows = F.slice(cov, 1, k)

    def step(m: Column, p: Column) -> Column:
        top = F.get(m, p)
        pivot = F.get(top, p)
        usable = pivot > F.get(F.get(cov, p), p) * COLLINEAR
        return F.transform(m, lambda row, i: F.when(~usable, F.when(i == p, F.transform(row, lambda _: F.lit(0.0))).otherwise(row)).when(
            i == p, F.transform(row, lambda v: v / pivot)
        ).otherwise(F.zip_with(row, top, lambda v, t: v - F.get(row, p) / pivot * t)))

    done = F.aggregate(F.sequence(F.lit(0), k - 1), rows, step)
    found = F.transform(done, lambda row: F.element_at(row, -1))
    return found if scale is None else F.transform(found, lambda b: b * scale)


def _guess(x: Column, means: Column, beta: Column) -> Column:
    k = F.size(means) - 1
    parts = F.zip_with(beta, F.zip_with(x, F.slice(means, 1, k), lambda v, m: v - m), lambda b, d: b * d)
    return F.when(x.isNotNull(), F.element_at(means, -1) + F.aggregate(parts, F.lit(0.0), lambda a, v: a + v))


def _fill(rows: DataFrame, model: DataFrame, x: str, drop: Sequence[str]) -> DataFrame:
    guess = _guess(F.col(x), F.col("means"), F.col("_beta"))
    joined = rows.join(model.select(*SERIES, "means", "_beta"), list(SERIES), "left")
    return joined.withColumn("filled", F.coalesce(F.col("value"), guess)).drop("means", "_beta", *drop)


def _columns(fit: str) -> tuple[str, ...]:
    return ("value",) if fit == "value" else ("value", fit)


def regression(cells: DataFrame, donors: DataFrame, lags: Sequence[int] = (0, 1, 7), fit: str = "value", min_rows: int = 10) -> DataFrame:
    """Least squares of a series on the values of all donors, today and ``lags`` rows back.

    One row per cell, with ``filled``. A cell is estimated where every donor has every value; a
    series needs ``min_rows`` such days and more days than predictors. ``fit`` names the column the model is fitted on.
    """
    rows = with_predictors(cells, donors, lags, _columns(fit))
    model = moments(rows, fit, f"x_{fit}").filter((F.col("n") >= min_rows) & (F.col("n") >= F.size("means")))
    return _fill(rows, model.withColumn("_beta", solve(F.col("cov"))), "x_value", [f"x_{c}" for c in _columns(fit)])


def kriging(cells: DataFrame, donors: DataFrame, fit: str = "value", min_pairs: int = 20) -> DataFrame:
    """Simple kriging from all donors: mean + weights * (donors - their means).

    The weights solve the donors' population covariances for their sample covariances with
    the target; a donor that does not vary, or repeats a nearer one, has weight 0. One row per cell.
    """
    rows = with_predictors(cells, donors, (0,), _columns(fit))
    model = moments(rows, fit, f"x_{fit}").filter(F.col("n") >= min_pairs)
    beta = solve(F.col("cov"), F.col("n") / (F.col("n") - 1))
    return _fill(rows, model.withColumn("_beta", beta), "x_value", [f"x_{c}" for c in _columns(fit)])


def context_regression(df: DataFrame, target: str, features: Sequence[str], min_rows: int = 20) -> DataFrame:
    """``filled``: ``target``, or its least-squares estimate from ``features`` where all of them exist.

    One model for all rows, fitted where the target and all features exist, if there are
    ``min_rows`` of them. A feature that does not vary, or follows from those before it, has no weight.
    The model is one row, which the plan looks up as a scalar.
    """
    x = F.array(*[F.col(c).cast("double") for c in features])
    whole = F.when(F.forall(x, lambda v: v.isNotNull()), x)
    fitted = moments(df.select(F.col(target).alias("_y"), whole.alias("_x")), "_y", "_x", ())
    model = fitted.filter(F.col("n") >= min_rows).select(F.struct("means", solve(F.col("cov")).alias("beta"))).scalar()
    rows = df.withColumn("_x", whole).withColumn("_model", model)
    return rows.withColumn("filled", F.coalesce(F.col(target), _guess(F.col("_x"), F.col("_model.means"), F.col("_model.beta")))).drop("_x", "_model")
