"""Ordered scans that never put a whole series, or a whole column, in one task.

Three shapes cover every order-dependent operator of the library:

* ``positions`` / ``nearest`` look arbitrarily far along a series. A series is cut
  into chunks of ``span_days``; windows run per ``(keys, chunk)``, each chunk is
  reduced to one summary row, and the summaries carry state over chunk borders.
* ``with_halo`` and ``with_row_halo`` serve frames of bounded length: every chunk gets a
  copy of the few days, or rows, before it, so the window needs no neighbour chunk.
* ``running_totals`` orders *values* (scores, readings) rather than days: values are
  pre-aggregated, cut at quantiles, and totals of the lower pieces are added on.

The summaries are joined back on the very columns the rows are already partitioned
by, and sorted by, so the large side is not shuffled again. These joins are hinted as
merges: a broadcast would send every summary through the driver and save nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_DAYS = 1024
UNBOUNDED = Window.unboundedPreceding


def time_chunk(ts: str | Column, span_days: int = CHUNK_DAYS) -> Column:
    return F.floor(F.unix_date(ts) / F.lit(span_days)).cast("int")


def chunked(df: DataFrame, keys: Sequence[str], ts: str = "obs_date", span_days: int = CHUNK_DAYS) -> DataFrame:
    """Add ``_chunk``; rows without a key or a day belong to no series. Said here, the
    null filters are the same in every branch, which lets Spark reuse one exchange."""
    out = df.withColumn("_chunk", time_chunk(ts, span_days))
    for c in (*keys, "_chunk"):
        out = out.filter(F.col(c).isNotNull())
    return out


def positions(df: DataFrame, keys: Sequence[str], ts: str = "obs_date", out: str = "pos") -> DataFrame:
    """0-based row number within ``keys`` by ``ts``, and ``<out>_last``, the last one of
    the series; ``df`` comes from :func:`chunked`."""
    part = [*keys, "_chunk"]
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(UNBOUNDED, -1)
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *part,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        (F.sum("_n").over(Window.partitionBy(*keys)) - 1).alias(f"{out}_last"),
    )
    local = F.row_number().over(Window.partitionBy(*part).orderBy(ts))
    return (
        df.withColumn("_rn", local)
        .join(offsets.hint("merge"), part)
        .withColumn(out, (F.col("_base") + F.col("_rn") - 1).cast("long"))
        .drop("_rn", "_base")
    )


def nearest(
    df: DataFrame,
    keys: Sequence[str],
    payload: str,
    prev: str = "prev",
    nxt: str = "next",
    ts: str = "obs_date",
    strict: bool = False,
) -> DataFrame:
    """Closest non-null ``payload`` at or before (``prev``) and at or after (``nxt``).

    ``strict`` leaves out the row itself. The look-ahead uses the descending order:
    the frame then only ever grows, where ``current .. unbounded following`` would
    be evaluated anew for each row. ``df`` comes from :func:`chunked`.
    """
    part = [*keys, "_chunk"]
    stop = -1 if strict else 0
    up = Window.partitionBy(*part).orderBy(ts).rowsBetween(UNBOUNDED, stop)
    down = Window.partitionBy(*part).orderBy(F.desc(ts)).rowsBetween(UNBOUNDED, stop)
    seen = F.when(F.col(payload).isNotNull(), F.col(ts))
    summary = df.groupBy(*part).agg(
        F.max_by(payload, seen).alias("_last"), F.min_by(payload, seen).alias("_first")
    )
    lower = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(UNBOUNDED, -1)
    upper = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(UNBOUNDED, -1)
    carried = summary.select(
        *part,
        F.last("_last", ignorenulls=True).over(lower).alias("_from_left"),
        F.last("_first", ignorenulls=True).over(upper).alias("_from_right"),
    )
    return (
        df.withColumn(prev, F.last(payload, ignorenulls=True).over(up))
        .withColumn(nxt, F.last(payload, ignorenulls=True).over(down))
        .join(carried.hint("merge"), part)
        .withColumn(prev, F.coalesce(prev, "_from_left"))
        .withColumn(nxt, F.coalesce(nxt, "_from_right"))
        .drop("_from_left", "_from_right")
    )


def with_halo(df: DataFrame, days_before: int, ts: str = "obs_date", span_days: int = CHUNK_DAYS) -> DataFrame:
    """Add ``_chunk`` and ``_halo``: the last ``days_before`` days of a chunk also
    appear, flagged, in the next one. Partition windows by the keys and ``_chunk``,
    then keep ``~_halo``. For frames of rows the panel must have a row for every day."""
    span_days = max(span_days, days_before + 1)
    home = time_chunk(ts, span_days)
    offset = F.unix_date(ts) - home * span_days
    targets = F.when(offset >= span_days - days_before, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_chunk", F.explode(targets)).withColumn("_halo", F.col("_chunk") != home)


def with_row_halo(df: DataFrame, rows_before: int, keys: Sequence[str], ts: str = "obs_date", span_rows: int = CHUNK_DAYS) -> DataFrame:
    """As :func:`with_halo`, by rows: every chunk of ``span_rows`` rows of a series is
    preceded by the ``rows_before`` rows before it, however many days they lie apart.

    The row number of a chunk's first row comes from the counts of the chunks before it, so that no
    series is numbered in one task.
    """
    span = max(span_rows, rows_before)
    placed = positions(chunked(df, keys, ts), keys, ts, out="_at").drop("_chunk")
    home = F.floor(F.col("_at") / span)
    reach = F.floor(F.least(F.col("_at") + rows_before, F.col("_at_last")) / span)
    out = placed.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence("_home", reach)))
    return out.withColumn("_halo", F.col("_chunk") != F.col("_home")).drop("_home", "_at", "_at_last")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_halo", "_chunk")


def running_totals(
    df: DataFrame, by: Sequence[str], order: str, measures: Sequence[str], pieces: int = 256
) -> DataFrame:
    """Running sums of ``measures`` in ascending ``order``; one input row per (by, order).

    Adds ``<m>_upto`` (inclusive) and ``<m>_all``. Quantile cuts only balance the
    work; the sums are exact wherever the cuts fall.
    """
    points = [i / pieces for i in range(1, pieces)]
    cuts = df.groupBy(*by).agg(F.percentile_approx(order, points, 10000).alias("_cuts"))
    tagged = df.join(cuts, list(by)).withColumn(
        "_piece", F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    ).drop("_cuts")
    part = [*by, "_piece"]
    sums = tagged.groupBy(*part).agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    lower = Window.partitionBy(*by).orderBy("_piece").rowsBetween(UNBOUNDED, -1)
    whole = Window.partitionBy(*by)
    offsets = sums.select(
        *part,
        *[F.coalesce(F.sum(f"_{m}").over(lower), F.lit(0)).alias(f"_{m}_base") for m in measures],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_all") for m in measures],
    )
    local = Window.partitionBy(*part).orderBy(order).rowsBetween(UNBOUNDED, 0)
    out = tagged
    for m in measures:
        out = out.withColumn(f"{m}_upto", F.sum(m).over(local))
    out = out.join(offsets.hint("merge"), part)
    for m in measures:
        out = out.withColumn(f"{m}_upto", F.col(f"{m}_upto") + F.col(f"_{m}_base"))
    return out.drop("_piece", *[f"_{m}_base" for m in measures])


def hash_rank(
    df: DataFrame, by: Sequence[str], digest: str, counted: Column | None = None, digits: int = 3
) -> DataFrame:
    """1-based rank by a hex ``digest`` within ``by`` (``_rank``) and the group's size
    (``_all``), counting only rows where ``counted`` is true.

    A group may be the whole table, so it is never sorted in one task: the leading hex
    digits split it evenly into 16^digits pieces, counts of the lower pieces give the
    rank offset, and only a piece is ordered.
    """
    one = F.lit(1).cast("long") if counted is None else counted.cast("long")
    pieces = df.withColumn("_piece", F.substring(digest, 1, digits))
    part = [*by, "_piece"]
    counts = pieces.groupBy(*part).agg(F.sum(one).alias("_c"))
    group = Window.partitionBy(*by)
    lower = group.orderBy("_piece").rowsBetween(UNBOUNDED, -1)
    offsets = counts.select(
        *part, F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_below"), F.sum("_c").over(group).alias("_all")
    )
    local = F.sum(one).over(Window.partitionBy(*part).orderBy(digest).rowsBetween(UNBOUNDED, 0))
    return (
        pieces.withColumn("_rank", local)
        .join(offsets.hint("merge"), part)
        .withColumn("_rank", F.col("_rank") + F.col("_below"))
        .drop("_piece", "_below")
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], pieces: int = 64
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group.

    Equal values are counted first, so repeated readings cost nothing; a group of
    any size is spread over ``pieces`` partitions.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(counted, by, value, ["n"], pieces)
    picks = []
    for name, p in probs.items():
        h = (F.col("n_all") - 1) * F.lit(float(p))
        for side, idx in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("n_upto") > idx) & (F.col("n_upto") - F.col("n") <= idx)
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
    picked = run.groupBy(*by).agg(F.max("n_all").alias("_all"), *picks)
    out = []
    for name, p in probs.items():
        h = (F.col("_all") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*by, *out)
