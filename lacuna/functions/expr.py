"""Scalar column expressions shared by operators and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk ladders (lower bound, level), highest first; colour words; levels.
DAILY_LADDER = ((0.8, "High Risk"), (0.5, "Moderate Risk"), (0.2, "Low Risk"))
SERVICE_LADDER = ((0.7, "High Risk"), (0.4, "Moderate Risk"), (0.2, "Low Risk"))
HORIZON_LADDER = ((0.7, "High Risk"), (0.4, "Moderate Risk"))
RISK_NUMBER = {"Low Risk": 1, "Moderate Risk": 2, "High Risk": 3}


def ladder(p: Column, steps=DAILY_LADDER, floor: str = "Very Low Risk", inclusive: bool = True) -> Column:
    """First level whose bound the probability reaches (or, not inclusive, exceeds)."""
    out = F.lit(floor)
    for bound, level in reversed(steps):
        out = F.when((p >= bound) if inclusive else (p > bound), F.lit(level)).otherwise(out)
    return out


def _has(level: Column, *words: str) -> Column:
    low = F.lower(F.coalesce(level, F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit


def risk_colour(level: Column) -> Column:
    """Map colour: a very low risk is green, a low one yellow."""
    return (
        F.when(_has(level, "red", "high"), "red")
        .when(_has(level, "orange", "moderate"), "orange")
        .when(_has(level, "very low"), "green")
        .when(_has(level, "low"), "yellow")
        .otherwise("green")
    )


def risk_key(level: Column) -> Column:
    """Summary key: unlike the map colour, a very low risk counts as yellow."""
    return (
        F.when(_has(level, "red", "high"), "red")
        .when(_has(level, "orange", "moderate"), "orange")
        .when(_has(level, "yellow", "low"), "yellow")
        .otherwise("green")
    )


def elevated(level: Column) -> Column:
    return _has(level, "red", "orange", "high", "moderate")


def location_key(name: Column) -> Column:
    """Lower case, letters and digits of any script only."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def normal_risk(level: Column) -> Column:
    """Title-cased and trimmed when that is a known level, else as given."""
    t = F.initcap(F.trim(level))
    return F.when(t.isin(*RISK_NUMBER), t).otherwise(level)


def risk_number(level: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in RISK_NUMBER.items():
        out = F.when(level == name, F.lit(n)).otherwise(out)
    return out


def percent_text(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%"))


def with_unit(x: Column, digits: int, unit: str) -> Column:
    """``12.5 mm`` style text, N/A when missing."""
    text = F.concat_ws(" ", F.round(x, digits).cast("string"), F.lit(unit) if unit else F.lit(None).cast("string"))
    return F.when(x.isNull(), F.lit("N/A")).otherwise(text)


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def clear_sky(qa: Column, bits=(10, 11)) -> Column:
    """True when none of the QA bits is set."""
    mask = sum(1 << b for b in bits)
    return qa.bitwiseAND(F.lit(mask)) == 0


def lenient_date(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))


def lenient_number(text: Column, default: float | None = None) -> Column:
    """NULL, or ``default``, where the text is not a number; NaN counts as missing."""
    x = text.try_cast("double")
    x = F.when(~F.isnan(x), x)
    return x if default is None else F.coalesce(x, F.lit(default))


def binarise(x: Column, threshold: float, inclusive: bool = True) -> Column:
    hit = (x >= threshold) if inclusive else (x > threshold)
    return F.when(x.isNotNull(), hit.cast("int"))
