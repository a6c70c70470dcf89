"""Cutting reproducible artificial gaps into a panel, and describing them.

Selection is by ``md5(seed|variable|location|date)``: the same cells are cut whatever
the partitioning, and any other engine can repeat it. Counts follow ``floor(n * rate)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scan import chunked, hash_rank, positions
from lacuna.operators.splits import RollingOrigin, rolling_splits, window_membership

# The months of the wet season and the standard strategies.
WET_MONTHS = (6, 7, 8, 9, 10)
STRATEGIES = {
    "random_10": {"type": "random", "missing_rate": 0.10},
    "random_20": {"type": "random", "missing_rate": 0.20},
    "block_7day": {"type": "block", "block_length": 7, "num_blocks": 8},
    "block_14day": {"type": "block", "block_length": 14, "num_blocks": 4},
    "seasonal": {"type": "seasonal", "wet_rate": 0.40, "dry_rate": 0.10},
    "cross_variable": {"type": "cross_variable", "variables": (), "periods": ()},
    "rolling_origin": {"type": "rolling_origin", "window_days": 90, "num_splits": 4},
    "rolling_origin_180": {"type": "rolling_origin", "window_days": 180, "num_splits": 4},
}


@dataclass(frozen=True)
class Strategy:
    """A named masking configuration; ``options`` override the registered defaults."""

    name: str
    options: dict = field(default_factory=dict)

    def apply(self, cells: DataFrame, seed: int = 42, bounds: tuple[Column, Column] | None = None) -> DataFrame:
        o = {**STRATEGIES[self.name], **self.options}
        kind = o["type"]
        if kind == "random":
            return mask_random(cells, o["missing_rate"], seed)
        if kind == "block":
            return mask_block(cells, o["block_length"], o["num_blocks"], seed)
        if kind == "seasonal":
            return mask_seasonal(cells, o["wet_rate"], o["dry_rate"], seed)
        if kind == "cross_variable":
            return mask_cross_variable(cells, o["variables"], o["periods"])
        return mask_rolling_origin(cells, RollingOrigin(o["window_days"], o["num_splits"]), bounds)


def cell_hash(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def _lowest_hashes(cells: DataFrame, pool: Sequence[str], rate: Column, seed: int) -> DataFrame:
    """Flag the ``floor(n * rate)`` observed cells of each pool with the lowest hash."""
    hashed = cells.withColumn("_h", cell_hash(seed, "variable", "location", "obs_date"))
    ranked = hash_rank(hashed, pool, "_h", F.col("value").isNotNull())
    chosen = F.col("value").isNotNull() & (F.col("_rank") <= F.floor(F.col("_all") * rate))
    return ranked.withColumn("is_masked", chosen).drop("_h", "_rank", "_all")


def mask_random(cells: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Per variable, pooled over locations, a fixed share of the observed cells."""
    return _lowest_hashes(cells, ["variable"], F.lit(float(rate)), seed)


def mask_seasonal(
    cells: DataFrame, wet_rate: float, dry_rate: float, seed: int = 42, months: Sequence[int] = WET_MONTHS
) -> DataFrame:
    pooled = cells.withColumn("_wet", F.month("obs_date").isin(*months))
    rate = F.when(F.col("_wet"), F.lit(float(wet_rate))).otherwise(F.lit(float(dry_rate)))
    return _lowest_hashes(pooled, ["variable", "_wet"], rate, seed).drop("_wet")


def mask_block(cells: DataFrame, length: int, blocks: int, seed: int = 42) -> DataFrame:
    """Per series ``blocks`` runs of ``length`` rows, never overlapping.

    Runs start at multiples of ``length``: exactly ``blocks`` of them whenever the
    series is long enough, where drawing free starts with retries may give fewer.
    Series with fewer observed values than ``length`` are left alone; missing cells
    inside a run count as masked.
    """
    keys = ["location", "variable"]
    rows = positions(chunked(cells, keys), keys).withColumn("_slot", F.floor(F.col("pos") / length)).drop("_chunk")
    slots = rows.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_rows"), F.count("value").alias("_obs"))
    series = Window.partitionBy(*keys)
    full = slots.withColumn("_observed", F.sum("_obs").over(series)).filter(
        (F.col("_rows") == length) & (F.col("_observed") >= length)
    )
    order = series.orderBy(cell_hash(seed, "variable", "location", "_slot"))
    chosen = full.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= blocks)
    hit = chosen.select(*keys, "_slot", F.lit(True).alias("_hit"))
    return (
        rows.join(hit, [*keys, "_slot"], "left")
        .withColumn("is_masked", F.coalesce("_hit", F.lit(False)))
        .drop("_slot", "_hit", "pos", "pos_last")
    )


def mask_cross_variable(
    cells: DataFrame, variables: Sequence[str], periods: Sequence[tuple[str, str]]
) -> DataFrame:
    """The listed variables vanish during inclusive date periods, at every location."""
    day = F.col("obs_date")
    inside = F.lit(False)
    for start, end in periods:
        inside = inside | day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return cells.withColumn("is_masked", F.col("variable").isin(*variables) & inside)


def mask_rolling_origin(
    cells: DataFrame, plan: RollingOrigin, bounds: tuple[Column, Column] | None = None
) -> DataFrame:
    """One copy of the panel per split, masked in (cutoff, cutoff + window].

    ``split_num`` is added. Copies are made by ``explode`` of the split list, so no
    join is involved.
    """
    splits = rolling_splits(cells, plan, bounds)
    row = cells.withColumn("_split", F.explode(splits))
    return row.select(
        *cells.columns, F.col("_split.split_num").alias("split_num"),
        window_membership("obs_date", "_split").alias("is_masked"),
    )


def apply_mask(masked: DataFrame, out: str = "value", truth: str = "truth") -> DataFrame:
    """Move the original to ``truth`` and leave holes in ``value``."""
    return masked.withColumn(truth, F.col("value")).withColumn(out, F.when(~F.col("is_masked"), F.col("value")))


def mask_stats(masked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, original holes, masked cells and the rate per variable and overall
    (variable NULL). The rate counts against originally observed cells and may exceed
    100 % where a mask covers cells that were missing already."""
    base = F.col("total_cells") - F.col("originally_missing")
    rate = F.when(base > 0, F.round(F.col("masked_cells") / base * 100, 2)).otherwise(F.lit(0.0))
    per = masked.groupBy(*by, "variable").agg(
        F.count(F.lit(1)).alias("total_cells"),
        F.sum(F.col("value").isNull().cast("long")).alias("originally_missing"),
        F.sum(F.col("is_masked").cast("long")).alias("masked_cells"),
    )
    sums = [F.sum(c).alias(c) for c in ("total_cells", "originally_missing", "masked_cells")]
    if by:
        both = per.union(per.groupBy(*by).agg(*sums).select(*by, F.lit(None).alias("variable"), *[s for s in per.columns if s not in (*by, "variable")]))
    else:
        both = per.rollup("variable").agg(*sums)
    return both.withColumn("masked_rate_pct", rate)
