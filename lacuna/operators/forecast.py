"""Daily risk forecasts and their roll-ups. The run date is always an argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import expr as E

# Texts and keys of the published forecast document.
EXPLANATION = {
    "high": "Elevated bloom risk driven by current chlorophyll, temperature, salinity, and wind conditions.",
    "moderate": "Moderate bloom risk based on a combination of environmental factors; continue close monitoring.",
    "low": "Low bloom risk under current environmental conditions, but routine monitoring is still advised.",
    "very low": "Very low bloom risk; environmental conditions are currently unfavorable for red tide development.",
    "limited": "Forecast generated with limited real-time environmental coverage; interpret risk conservatively and verify with local monitoring and BFAR advisories.",
    "signal": "Moderate bloom risk retained due to persistent recent positive red tide history in this location.",
}
RECOMMENDATIONS = {
    "high": ("HARMFUL ALGAL BLOOM DETECTED", "Do not harvest, buy, or eat shellfish from this area.", "Wait for official BFAR advisory before resuming activities."),
    "moderate": ("Elevated risk detected.", "Limit harvesting and monitor water color changes.", "Check for latest local advisories."),
    "other": ("Conditions are favorable.", "Shellfish harvesting is permitted.", "Continue regular monitoring."),
    "limited": ("Data quality note: key environmental inputs were partially imputed.", "Use this forecast as preliminary guidance and prioritize official advisories with on-site validation."),
}
CRITICAL_VARIABLES = ("CHL", "thetao", "so", "precip_mm_day")


def recent_signal(labels: DataFrame, run_date: Column, label: str = "label", key: str = "location") -> DataFrame:
    """Days since the last positive label, positive rate over 90 and 365 days, and whether
    any of them says the event is recent. One pass with filtered aggregates."""
    positive = (F.col(label) >= 0.5).cast("int")
    age = F.datediff(run_date, F.col("obs_date"))
    seen = labels.filter(F.col(label).isNotNull() & (F.col("obs_date") <= run_date))
    agg = seen.groupBy(key).agg(
        F.min(F.when(positive == 1, age)).alias("days_since_last_positive"),
        F.avg(F.when(age <= 90, positive)).alias("_r90"),
        F.avg(F.when(age <= 365, positive)).alias("_r365"),
    )
    hit = (
        F.coalesce(F.col("days_since_last_positive") <= 90, F.lit(False))
        | F.coalesce(F.col("_r90") >= 0.15, F.lit(False))
        | F.coalesce(F.col("_r365") >= 0.10, F.lit(False))
    )
    return agg.select(
        key, "days_since_last_positive", F.round("_r90", 3).alias("recent_positive_rate_90d"),
        F.round("_r365", 3).alias("recent_positive_rate_365d"), hit.alias("has_signal"),
    )


def data_quality(df: DataFrame, variables: Sequence[str], critical: Sequence[str]) -> DataFrame:
    """Share of observed inputs, share of the critical ones, and whether data are limited."""
    have = lambda cols: sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    out = df.withColumn("critical_available", have(critical)).withColumn(
        "critical_ratio", F.col("critical_available") / F.lit(len(critical))
    ).withColumn("observed_ratio", have(variables) / F.lit(len(variables)))
    return out.withColumn("data_limited", (F.col("critical_ratio") < 0.5) | (F.col("observed_ratio") < 0.7))


def risk(df: DataFrame, prob: str = "probability") -> DataFrame:
    """Risk level and confidence from probability, ``data_limited`` and ``has_signal``.

    Limited data cap confidence at .65 and lift Very Low to Low; a recent signal lifts
    anything below Moderate to Moderate and caps confidence at .70.
    """
    p = F.col(prob)
    base = F.lit(0.5) + F.abs(p - 0.5)
    limited = F.col("data_limited")
    signal = F.coalesce(F.col("has_signal"), F.lit(False))
    out = df.withColumn("_risk0", E.ladder(p)).withColumn("_conf0", F.when(limited, F.least(base, F.lit(0.65))).otherwise(base))
    out = out.withColumn("_risk1", F.when(limited & (F.col("_risk0") == "Very Low Risk"), F.lit("Low Risk")).otherwise(F.col("_risk0")))
    lift = signal & F.col("_risk1").isin("Very Low Risk", "Low Risk")
    return (
        out.withColumn("risk_level", F.when(lift, F.lit("Moderate Risk")).otherwise(F.col("_risk1")))
        .withColumn("confidence", F.when(lift, F.least(F.col("_conf0"), F.lit(0.70))).otherwise(F.col("_conf0")))
        .drop("_risk0", "_risk1", "_conf0")
    )


def _future(run_date: Column, p: Column, conf: Column, i: int) -> Column:
    """Fields of day ``i`` of the outlook."""
    prob = p * F.lit(0.9**i)
    decayed = conf * F.lit(0.95**i)
    level = E.ladder(prob, E.HORIZON_LADDER, "Low Risk", inclusive=False)
    when = F.date_add(run_date, i)
    return F.struct(
        F.lit(i).alias("forecast_day"), when.alias("date"), F.date_format(when, "E").alias("day_label"),
        level.alias("risk_level"), F.when(conf > 0.7, F.greatest(F.lit(0.5), decayed)).otherwise(decayed).alias("confidence"),
        prob.alias("probability"),
    )


def horizon(df: DataFrame, run_date: Column, prob: str = "probability", days: int = 6) -> DataFrame:
    """The next ``days`` days of each row: probability decays by .9 a day, confidence by
    .95 with a floor of .5 where it was above .7."""
    steps = F.array(*[_future(run_date, F.col(prob), F.col("confidence"), i) for i in range(1, days + 1)])
    return df.select("location", F.inline(steps))


def explanation(level: Column, limited: Column, signal: Column) -> Column:
    low = F.lower(level)
    text = (
        F.when(low.contains("high"), EXPLANATION["high"])
        .when(low.contains("moderate"), EXPLANATION["moderate"])
        .when(low.contains("very low"), EXPLANATION["very low"])
        .otherwise(F.lit(EXPLANATION["low"]))
    )
    return F.when(limited, F.lit(EXPLANATION["limited"])).when(signal, F.lit(EXPLANATION["signal"])).otherwise(text)


def recommendations(level: Column, limited: Column) -> Column:
    texts = lambda k: F.array(*[F.lit(t) for t in RECOMMENDATIONS[k]])
    low = F.lower(level)
    base = F.when(low.contains("high"), texts("high")).when(low.contains("moderate"), texts("moderate")).otherwise(texts("other"))
    return F.when(limited, F.concat(base, texts("limited"))).otherwise(base)


def display_value(name: str, *prefixes: str) -> Column:
    """First of the candidate columns ``<prefix><name>`` with a value: live reading, raw
    input, imputed input, latest history."""
    return F.coalesce(*[F.col(f"{p}{name}") for p in prefixes])


# Column prefixes of a displayed variable, the one shown first in front: live reading, raw input, model input, latest history.
SHOWN_FIRST = ("live_", "raw_", "", "latest_")

# Displayed variable, digits, unit, name in the document.
DISPLAY = (
    ("CHL", 2, "mg/m3", "Chlorophyll-a"),
    ("thetao", 2, "°C", "Temperature"),
    ("so", 2, "PSU", "Salinity (PSU)"),
    ("mlotst", 2, "m", "MLD (m)"),
    ("precip_mm_day", 2, "mm", "Precipitation"),
    ("NDVI_daily", 4, "", "NDVI"),
    ("wind_u_ms", 2, "m/s", "U-Wind Speed (m/s)"),
    ("wind_v_ms", 2, "m/s", "V-Wind Speed (m/s)"),
    ("uo", 3, "m/s", "U-VEL (m/s)"),
    ("vo", 3, "m/s", "V-VEL (m/s)"),
)
FACTORS = (("chl-a", "CHL", 3), ("sst", "thetao", 2), ("salinity", "so", 2), ("rainfall", "precip_mm_day", 1))


def document(df: DataFrame, run_date: Column, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Nested forecast of each site, ready for a JSON sink partitioned by ``run_date``.

    Expects the output of :func:`risk` with ``data_quality`` columns, coordinates, and
    whichever displayed variables exist, each as up to four columns (``SHOWN_FIRST``) of
    which the first with a value is shown; absent ones read N/A.
    """
    def have(v: str) -> Column:
        found = [p for p in SHOWN_FIRST if f"{p}{v}" in df.columns]
        return display_value(v, *found) if found else F.lit(None).cast("double")

    limited, signal = F.col("data_limited"), F.coalesce(F.col("has_signal"), F.lit(False))
    word = F.split_part(F.col("risk_level"), F.lit(" "), F.lit(1))
    days = F.array(
        *[
            _future(run_date, F.col("probability"), F.col("confidence"), i)
            .withField("confidence", E.percent_text(F.when(F.col("confidence") > 0.7, F.greatest(F.lit(0.5), F.col("confidence") * F.lit(0.95**i))).otherwise(F.col("confidence") * F.lit(0.95**i))))
            .withField("probability", F.split_part(E.ladder(F.col("probability") * F.lit(0.9**i), E.HORIZON_LADDER, "Low Risk", inclusive=False), F.lit(" "), F.lit(1)))
            for i in range(1, 7)
        ]
    )
    return df.select(
        "location", F.col(latitude).alias("latitude"), F.col(longitude).alias("longitude"),
        run_date.alias("run_date"), F.date_format(run_date, "yyyy-MM-dd").alias("date"),
        "risk_level", E.percent_text(F.col("confidence")).alias("confidence"), word.alias("red_tide_probability"),
        recommendations(F.col("risk_level"), limited).alias("recommendations"),
        F.struct(*[F.round(have(v), d).alias(n) for n, v, d in FACTORS]).alias("contributing_factors"),
        F.struct(*[E.with_unit(have(v), d, u).alias(n) for v, d, u, n in DISPLAY]).alias("environmental_data"),
        F.struct(
            F.round("observed_ratio", 2).alias("quality_score"),
            F.when(limited, "Low").otherwise("High").alias("confidence_level"),
            F.col("critical_available").alias("critical_features_available"),
            F.when(limited, "limited").otherwise("sufficient").alias("coverage_note"),
            signal.alias("historical_positive_signal"),
        ).alias("data_quality"),
        explanation(F.col("risk_level"), limited, signal).alias("explanation"),
        days.alias("five_day_forecast"),
    )


def yesterday(today: DataFrame, past: DataFrame) -> DataFrame:
    """Yesterday's card of each site by normalised name; the latest created if several."""
    key = E.location_key(F.col("location")).alias("location_key")
    card = (
        past.select(key, F.date_add("forecast_date", 1).alias("forecast_date"), "created_at", "risk_level", "confidence")
        .groupBy("location_key", "forecast_date")
        .agg(F.max_by(F.struct("risk_level", "confidence"), F.col("created_at")).alias("y"))
    )
    return today.select("*", key).join(card, ["location_key", "forecast_date"], "left").select(
        *today.columns, "location_key", F.col("y.risk_level").alias("yesterday_risk"), F.col("y.confidence").alias("yesterday_confidence")
    )


def summary(forecasts: DataFrame, by: Sequence[str] = ("run_date",)) -> DataFrame:
    """Sites per colour, sites at Moderate or above, mean confidence and quality.

    ``confidence`` is text such as ``54.3%``. The names behind ``elevated_locations`` are
    rows of :func:`elevated_sites`, not a list in one cell.
    """
    key = E.risk_key(F.col("risk_level"))
    number = F.replace(F.col("confidence"), F.lit("%"), F.lit("")).try_cast("double")
    counts = [F.sum((key == c).cast("long")).alias(c) for c in ("green", "yellow", "orange", "red")]
    return forecasts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_locations"), *counts,
        F.round(F.avg(number), 1).alias("average_confidence"), F.round(F.avg("quality_score"), 1).alias("data_quality_avg"),
        F.sum(E.elevated(F.col("risk_level")).cast("long")).alias("elevated_locations"),
    )


def elevated_sites(forecasts: DataFrame) -> DataFrame:
    """The sites at Moderate risk or above."""
    return forecasts.filter(E.elevated(F.col("risk_level")))


def pad_outlook(cards: DataFrame, target: int = 7, key: str = "location") -> DataFrame:
    """Exactly ``target`` cards per site: surplus ones go, missing ones repeat the last
    with the following dates. ``cards`` has (key, day, date, risk_level, confidence)."""
    rows = cards.filter(F.col("day") < target).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("day", "date", "risk_level", "confidence"))).alias("_c")
    )
    last = F.element_at("_c", -1)
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(target - 1)),
        lambda i: F.when(i < F.size("_c"), F.get("_c", i)).otherwise(
            F.struct(
                i.alias("day"), F.date_add(last.date, i - F.size("_c") + 1).alias("date"),
                last.risk_level.alias("risk_level"), last.confidence.alias("confidence"),
            )
        ),
    )
    return rows.select(key, F.inline(padded))


def alerts(labels: DataFrame, location: str | None = None, start: str | None = None, end: str | None = None, label: str = "label") -> DataFrame:
    """Label rows with ``is_alert``, filtered by normalised site name and inclusive dates;
    the date filters reach the scan. A missing label is no alert."""
    out = labels
    if location and location.lower() != "all":
        out = out.filter(E.location_key(F.col("location")) == E.location_key(F.lit(location)))
    if start:
        out = out.filter(F.col("obs_date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("obs_date") <= F.lit(end).cast("date"))
    return out.withColumn("is_alert", (F.coalesce(F.col(label), F.lit(0.0)) >= 0.5).cast("long"))


def monthly_alerts(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.groupBy(F.date_format("obs_date", "yyyy-MM").alias("label")).agg(F.sum("is_alert").alias("value"))


def daily_timeline(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.groupBy("obs_date").agg(F.sum("is_alert").alias("value"))


def alert_range(alert_rows: DataFrame) -> DataFrame:
    """First and last day of the rows, how many days they cover, and their alerts: one row, nulls and 0 without rows."""
    return alert_rows.agg(
        F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"),
        (F.datediff(F.max("obs_date"), F.min("obs_date")) + 1).alias("days"), F.coalesce(F.sum("is_alert"), F.lit(0)).alias("alerts"),
    )


def quarterly_alerts(monthly: DataFrame, from_months: int = 24) -> DataFrame:
    """Monthly rows as they are, or by quarter once the range exceeds ``from_months``."""
    day = F.to_date(F.concat("label", F.lit("-01")))
    quarter = F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    span = monthly.select(
        (F.months_between(F.max(day), F.min(day)) + 1).cast("int")
    ).scalar()
    label = F.when(span > from_months, quarter).otherwise(F.col("label"))
    return monthly.groupBy(label.alias("period")).agg(F.sum("value").alias("value"))


def year_by_month(monthly: DataFrame, year: int) -> DataFrame:
    """Twelve rows for a year, months without data 0: one aggregate row per year, unfolded."""
    sums = [F.coalesce(F.sum(F.when(F.col("label") == f"{year}-{m:02d}", F.col("value"))), F.lit(0)).alias(f"m{m}") for m in range(1, 13)]
    one = monthly.agg(*sums)
    cells = F.array(*[F.struct(F.lit(m).alias("month"), F.col(f"m{m}").alias("value")) for m in range(1, 13)])
    return one.select(F.inline(cells))


def environment_overview(df: DataFrame) -> DataFrame:
    """Means over the sites, each variable over the sites that have it."""
    return df.agg(
        F.avg("chlorophyll").alias("mean_chlorophyll"), F.avg("sst").alias("mean_sst"), F.avg("salinity").alias("mean_salinity"),
        F.sum("precipitation").alias("total_precipitation"), F.count("chlorophyll").alias("sites_with_chlorophyll"),
    )


def compare_risk(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Ordinal comparison after normalising; an unknown level gives an error text."""
    p, a = E.normal_risk(F.col(predicted)), E.normal_risk(F.col(actual))
    pn, an = E.risk_number(p), E.risk_number(a)
    bad = F.when(pn.isNull(), p).when(an.isNull(), a)
    return df.select(
        "*", (F.coalesce(p == a, F.lit(False)) & bad.isNull()).alias("correct"), pn.alias("predicted_numeric"),
        an.alias("actual_numeric"), (an - pn).alias("difference"),
        F.when(bad.isNotNull(), F.concat(F.lit("Invalid risk level: "), bad)).alias("error"),
    )


def split_for_year(date: Column, last_year: int = 2025, first_year: int = 2020) -> Column:
    """Split whose test year holds the date; earlier dates use the first, later the last."""
    y = F.year(date)
    return (F.least(F.greatest(y, F.lit(first_year)), F.lit(last_year)) - first_year + 1).cast("int")


def find_location(snapshot: DataFrame, name: str) -> DataFrame:
    return snapshot.filter(E.location_key(F.col("location")) == E.location_key(F.lit(name)))
