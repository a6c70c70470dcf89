"""Filling a site from its donors (reference sites).

Cells enter through :func:`lacuna.operators.panel.with_donor`: one row per target
cell and donor, with ``donor_value`` beside ``value``. ``fit`` names the column the
models are fitted on: ``value`` (what is left after masking) by default, the held-back
``truth`` to reproduce a study that fits on ground truth.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scan import drop_halo, with_halo
from lacuna.sources.files import join_stats

PAIR = ("location", "donor", "variable")


def correlation(a: str, b: str) -> Column:
    """Pearson r of rows where both exist, NULL where one of them does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def _apply(pairs: DataFrame, model: DataFrame, estimate: Column, extra: Sequence[str] = ()) -> DataFrame:
    """Join one coefficient row per pair and variable back, and coalesce."""
    cols = [c for c in model.columns if c not in PAIR]
    return (
        pairs.join(model, list(PAIR), "left")
        .withColumn("filled", F.coalesce(F.col("value"), estimate))
        .drop(*cols, *extra)
    )


def idw(pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Inverse-distance weighted mean over the donors that have a value that day."""
    w = F.lit(1.0) / F.col("distance_km")
    have = F.col("donor_value").isNotNull()
    return pairs.groupBy("location", "variable", "obs_date").agg(
        F.first("value").alias("value"),
        *[F.first(c).alias(c) for c in keep],
        F.try_divide(
            F.sum(F.when(have, F.col("donor_value") * w)), F.sum(F.when(have, w))
        ).alias("_est"),
    ).withColumn("filled", F.coalesce("value", "_est")).drop("_est")


def kriging(pairs: DataFrame, fit: str = "value", donor_fit: str = "donor_value", min_pairs: int = 20) -> DataFrame:
    """Two-point simple kriging: mean + weight * (donor - donor mean).

    The weight is sample covariance over population variance; with a constant donor it
    is 0, and with too few common days the cell stays missing.
    """
    both = pairs.filter(F.col(fit).isNotNull() & F.col(donor_fit).isNotNull())
    model = both.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(fit).alias("_mt"), F.avg(donor_fit).alias("_md"),
        F.covar_samp(fit, donor_fit).alias("_cov"), F.var_pop(donor_fit).alias("_var"),
    ).filter(F.col("_n") >= min_pairs)
    weight = F.coalesce(F.try_divide("_cov", "_var"), F.lit(0.0))
    return _apply(pairs, model, F.col("_mt") + weight * (F.col("donor_value") - F.col("_md")))


def regression1(pairs: DataFrame, fit: str = "value", donor_fit: str = "donor_value", min_rows: int = 10) -> DataFrame:
    """OLS of the target on its donor's value of the same day."""
    both = pairs.filter(F.col(fit).isNotNull() & F.col(donor_fit).isNotNull())
    model = both.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(fit, donor_fit).alias("_b"), F.regr_intercept(fit, donor_fit).alias("_a")
    ).filter(F.col("_n") >= min_rows)
    return _apply(pairs, model, F.col("_a") + F.col("_b") * F.col("donor_value"))


def _det3(m: Sequence[Sequence[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def with_donor_lags(cells: DataFrame, donors: DataFrame, lags: Sequence[int], columns: Sequence[str] = ("value",)) -> DataFrame:
    """:func:`with_donor` plus the donor's value ``k`` rows earlier, for a spined panel."""
    from lacuna.operators.panel import with_donor

    rows = with_halo(cells, max(lags))
    w = Window.partitionBy("location", "variable", "_chunk").orderBy("obs_date")
    for c in columns:
        for k in lags:
            rows = rows.withColumn(f"{c}_lag{k}", F.lag(c, k).over(w))
    lagged = drop_halo(rows)
    both = [x for c in columns for x in (c, *[f"{c}_lag{k}" for k in lags])]
    return with_donor(lagged, donors, both).drop(*[f"{c}_lag{k}" for c in columns for k in lags])


def regression3(pairs: DataFrame, fit: str = "value", donor_fit: str = "donor_value", min_rows: int = 10) -> DataFrame:
    """OLS on the donor's value, its value 1 row and 7 rows earlier.

    One aggregation gathers the centred second moments of every pair and variable;
    the 3 x 3 normal equations are solved in closed form on that row. Only cells with
    all three predictors are estimated; a singular system leaves them missing.
    """
    fitx = [donor_fit, f"{donor_fit}_lag1", f"{donor_fit}_lag7"]
    use = ["donor_value", "donor_value_lag1", "donor_value_lag7"]
    ok = F.col(fit).isNotNull()
    for x in fitx:
        ok = ok & F.col(x).isNotNull()
    moments = pairs.filter(ok).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(fit).alias("_my"),
        *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(fitx)],
        *[F.covar_pop(x, fit).alias(f"_y{i}") for i, x in enumerate(fitx)],
        *[F.covar_pop(fitx[i], fitx[j]).alias(f"_c{i}{j}") for i in range(3) for j in range(i, 3)],
    ).filter(F.col("_n") >= min_rows)
    c = [[F.col(f"_c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    y = [F.col(f"_y{i}") for i in range(3)]
    det = _det3(c)
    beta = []
    for k in range(3):
        swapped = [[y[i] if j == k else c[i][j] for j in range(3)] for i in range(3)]
        beta.append(F.try_divide(_det3(swapped), det))
    model = moments.select(
        *PAIR, *[b.alias(f"_b{i}") for i, b in enumerate(beta)],
        *[F.col(f"_m{i}") for i in range(3)], "_my",
    )
    estimate = F.col("_my")
    for i, x in enumerate(use):
        estimate = estimate + F.col(f"_b{i}") * (F.col(x) - F.col(f"_m{i}"))
    return _apply(pairs, model, estimate, use[1:])


def best_lag(
    cells: DataFrame, donors: DataFrame, value: str = "value", max_lag: int = 7, min_pairs: int = 20
) -> DataFrame:
    """Per pair and variable the lag in 0..``max_lag`` days with the highest correlation
    between target and lagged donor; on a tie (to 12 digits) the smaller lag.

    The lagged donors are the panel ``max_lag`` + 1 times, whatever the planner thinks of its files, and are sorted and merged.
    """
    lag = F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")
    moved = cells.filter(F.col(value).isNotNull()).select(
        F.col("location").alias("donor"), "variable", F.col(value).alias("_d"), "obs_date", lag
    ).withColumn("obs_date", F.date_add("obs_date", F.col("lag")))
    mine = cells.filter(F.col(value).isNotNull()).select("location", "variable", "obs_date", F.col(value).alias("_t"))
    target = join_stats(mine, donors.select(F.col("target").alias("location"), "donor"), ["location"], "inner")
    per_lag = (
        target.join(moved.hint("merge"), ["donor", "variable", "obs_date"])
        .groupBy(*PAIR, "lag")
        .agg(F.count(F.lit(1)).alias("n"), correlation("_t", "_d").alias("r"))
        .filter((F.col("n") > min_pairs) & (F.col("r") > -1))
    )
    return per_lag.groupBy(*PAIR).agg(
        F.max_by("lag", F.struct(F.round("r", 12), -F.col("lag"))).alias("lag"), F.max("r").alias("r")
    )


def advection(cells: DataFrame, donors: DataFrame, fit: str = "value", max_lag: int = 7) -> DataFrame:
    """Fill with the donor's value at its best lag: one row per cell.

    Of several donors with a value for the day the one whose best lag correlates most counts, of
    equals (to 12 digits) the first by name. The lags are few, so they go to the panel.
    """
    lags = best_lag(cells, donors, fit, max_lag).select("location", "donor", "variable", "lag", F.round("r", 12).alias("_r"))
    source = cells.select(F.col("location").alias("donor"), "variable", "obs_date", F.col("value").alias("_d")).filter(
        F.col("_d").isNotNull()
    )
    moved = join_stats(source, lags, ["donor", "variable"], "inner").withColumn("obs_date", F.date_add("obs_date", F.col("lag")))
    shifted = moved.groupBy("location", "variable", "obs_date").agg(F.min_by("_d", F.struct(-F.col("_r"), "donor")).alias("_d"))
    return cells.join(shifted, ["location", "variable", "obs_date"], "left").withColumn(
        "filled", F.coalesce("value", "_d")
    ).drop("_d")


def knn(
    wide: DataFrame, donors: DataFrame, variable: str, features: Sequence[str], k: int = 5,
    decay: float = 0.95, block_days: int = 512, train: DataFrame | None = None,
) -> DataFrame:
    """Fill ``variable`` at a target from the ``k`` most alike days at its donor.

    Distance between days t and t' is the Euclidean distance of all ``features`` at the
    donor, divided by decay^|days apart|; the estimate is the inverse-distance weighted
    mean of the donor's ``variable``. Only donor days with all features take part;
    ``train`` names another panel to learn from (the held-back truth, say).

    The estimate depends on (donor, day) alone, so it is computed once however many
    targets share the donor. It is exact: every asked day meets every training day, but
    as blocks of at most ``block_days`` x ``block_days``, spread by Spark; a block
    answers with its k best per asked day, never with its pairs, and a second grouping
    keeps the best k overall.
    """
    day = F.unix_date("obs_date").alias("day")
    site, x = F.col("location").alias("donor"), F.array(*features).alias("x")
    learn = wide if train is None else train
    known = learn.dropna(subset=[*features, variable]).select(site, day, x, F.col(variable).alias("y"))
    known = known.withColumn("tblock", F.floor(F.col("day") / block_days))
    wanted = (
        wide.filter(F.col(variable).isNull())
        .join(donors.select(F.col("target").alias("location"), "donor"), "location")
        .select("location", "obs_date", "donor", day)
    )
    complete = wide.dropna(subset=list(features)).select(site, day, x)
    asked = complete.join(wanted.select("donor", "day").distinct(), ["donor", "day"])
    # Block numbers of a donor: one per ``block_days`` of calendar.
    spans = known.select("donor", "tblock").distinct()
    asked = asked.withColumn("qblock", F.floor(F.col("day") / block_days))
    pairs = asked.select("donor", "qblock").distinct().join(spans, "donor")
    keys = ["donor", "qblock", "tblock"]

    def nearest_in_block(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"donor": [], "day": [], "dist": [], "y": [], "train_day": []})
        qx, tx = np.stack(q["x"].to_numpy()), np.stack(t["r_x"].to_numpy())
        qd, td = q["day"].to_numpy(), t["r_day"].to_numpy()
        sq = np.zeros((len(q), len(t)))
        for j in range(qx.shape[1]):
            sq += (qx[:, j, None] - tx[None, :, j]) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            # Days so far apart that the decay is 0 count as infinitely far, equal ones too.
            dist = np.nan_to_num(np.sqrt(sq) / decay ** np.abs(qd[:, None] - td[None, :]), nan=np.inf, posinf=np.inf)
        # Only what is at most as far as the k-th is sorted, with its ties.
        n = min(k, len(t))
        rows, order = np.nonzero(dist <= np.partition(dist, n - 1, axis=1)[:, n - 1 : n])
        place = np.lexsort((td[order], dist[rows, order], rows))
        rows, order = rows[place], order[place]
        first = np.searchsorted(rows, np.arange(len(q)))
        best = np.arange(len(rows)) - first[rows] < n
        rows, order = rows[best], order[best]
        return pd.DataFrame(
            {
                "donor": q["donor"].to_numpy()[rows], "day": qd[rows], "dist": dist[rows, order],
                "y": t["r_y"].to_numpy()[order], "train_day": td[order],
            }
        )

    block = known.join(pairs, ["donor", "tblock"]).select(
        *[F.col(k).alias(f"r_{k}") for k in keys], F.col("day").alias("r_day"), F.col("x").alias("r_x"), F.col("y").alias("r_y")
    )
    near = (
        asked.join(pairs, ["donor", "qblock"])
        .groupBy(*keys)
        .cogroup(block.groupBy("r_donor", "r_qblock", "r_tblock"))
        .applyInPandas(nearest_in_block, "donor string, day int, dist double, y double, train_day int")
    )
    rank = F.row_number().over(Window.partitionBy("donor", "day").orderBy("dist", "train_day"))
    w = F.lit(1.0) / (F.col("dist") + F.lit(1e-10))
    est = near.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy("donor", "day").agg(
        (F.sum(F.col("y") * w) / F.sum(w)).alias("_est")
    )
    hit = wanted.join(est, ["donor", "day"]).select("location", "obs_date", "_est")
    return wide.select("location", "obs_date", F.col(variable).alias("value")).join(
        hit, ["location", "obs_date"], "left"
    ).withColumn("filled", F.coalesce("value", "_est")).drop("_est")


def eof_pca(
    wide: DataFrame, columns: Sequence[str], share: float = 0.95, rounds: int = 5, min_rows: int = 10
) -> DataFrame:
    """Reconstruct missing cells of a wide panel (one row per date) from its leading modes.

    Modes come from the complete rows, standardised, keeping components up to ``share``
    of the variance. A row is filled when at least half of its columns are present, by
    ``rounds`` of projecting and restoring what was observed. Only the fitted matrix
    (columns x components) leaves the cluster; rows are processed in Arrow batches.
    """
    names = list(columns)
    complete = wide.dropna(subset=names)
    stats = complete.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_samp(c).alias(f"s_{c}") for c in names],
    ).first()
    if stats["n"] < min_rows:
        return wide
    mean = np.array([stats[f"m_{c}"] for c in names])
    std = np.array([stats[f"s_{c}"] for c in names]) + 1e-10
    scaled = complete.select(
        *[((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, m, s in zip(names, mean, std)]
    )
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(scaled)
    model = PCA(k=len(names), inputCol="v", outputCol="pc").fit(vectors)
    ratios = np.cumsum(model.explainedVariance.toArray())
    k = int(np.searchsorted(ratios, share) + 1)
    modes = model.pc.toArray()[:, : min(k, len(names))]

    def reconstruct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = pdf[names].to_numpy(dtype=float)
            known = ~np.isnan(raw)
            z0 = np.where(known, (raw - mean) / std, 0.0)
            z = z0
            for _ in range(rounds):
                z = np.where(known, z0, z @ modes @ modes.T)
            usable = (known.sum(axis=1) * 2 >= len(names))[:, None]
            pdf[names] = np.where(known, raw, np.where(usable, z * std + mean, np.nan))
            yield pdf

    out = wide.select("obs_date", *[F.col(c).cast("double").alias(c) for c in names])
    filled = out.mapInPandas(reconstruct, out.schema)
    return filled.select("obs_date", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])


def gradient_regression(
    df: DataFrame, target: str, features: Sequence[str], min_rows: int = 20
) -> DataFrame:
    """OLS of a variable on spatial context features; fills where all features exist."""
    from lacuna.operators.joint import context_regression

    return context_regression(df, target, features, min_rows)
