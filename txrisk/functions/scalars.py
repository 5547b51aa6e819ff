"""Scalar feature expressions.

All of them are plain Column expressions so a whole feature projection
collapses into one codegen'd Project next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.schemas import LEGACY_FLAG_THRESHOLD, RISK_BANDS

__all__ = [
    "ZERO_MODES", "nan_to_null", "safe_denominator", "capped_ratio", "cap", "parse_timestamp",
    "to_micros", "txn_hour", "txn_day_of_week", "txn_month", "flag", "is_new_card",
    "is_round_amount", "is_large_amount", "is_off_hours", "velocity_24h", "velocity_7d",
    "velocity_burst", "risk_level", "recommended_action", "rounded_score", "iso_utc",
]

# Zero-safe denominator variants: which values are replaced by the fill.
#   null_or_zero: 0 or NULL -> fill   (feature job)
#   zero_only:    0 -> fill, NULL stays NULL (old-layout adapter / simulator)
#   nonpositive:  <= 0 -> fill        (online evaluator)
ZERO_MODES = ("null_or_zero", "zero_only", "nonpositive")


def nan_to_null(c: Column) -> Column:
    """NaN has no SQL meaning here: missing numbers are NULL."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_denominator(c: Column, fill: float = 1.0, mode: str = "null_or_zero") -> Column:
    if mode == "null_or_zero":
        return F.when(c.isNull() | (c == 0), F.lit(fill)).otherwise(c)
    if mode == "zero_only":
        return F.when(c == 0, F.lit(fill)).otherwise(c)
    if mode == "nonpositive":
        return F.when(c <= 0, F.lit(fill)).otherwise(c)
    raise ValueError(f"zero mode must be one of {ZERO_MODES}, got {mode!r}")


def cap(c: Column, upper: float) -> Column:
    """Upper clip that keeps NULL (``least(NULL, x)`` would return x)."""
    return F.when(c > upper, F.lit(float(upper))).otherwise(c)


def capped_ratio(num: Column, den: Column, upper: float, fill: float = 1.0,
                 mode: str = "null_or_zero") -> Column:
    return cap(num.cast("double") / safe_denominator(den.cast("double"), fill, mode), upper)


def parse_timestamp(c: Column, dtype: T.DataType | None = None) -> Column:
    """ISO-8601 text or timestamp -> TIMESTAMP in UTC (session zone is UTC).

    Naive text means UTC, offsets are converted; unparsable text gives NULL
    (callers choose to fail or quarantine).
    """
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp")
    return F.try_to_timestamp(c.cast("string"))


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def txn_hour(ts: Column) -> Column:
    return F.hour(ts)


def txn_day_of_week(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(ts)


def txn_month(ts: Column) -> Column:
    return F.month(ts)


def flag(cond: Column) -> Column:
    """Boolean condition -> 0/1 int, NULL counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def is_new_card(card_age_months: Column, months: int = 3) -> Column:
    return flag(card_age_months < months)


def is_round_amount(amount: Column, unit: float = 100.0) -> Column:
    return flag(amount % F.lit(unit) == 0)


def is_large_amount(amount: Column, threshold: float = 5000.0) -> Column:
    return flag(amount > threshold)


def is_off_hours(hour: Column, start: int = 6, end: int = 22) -> Column:
    """Hour before ``start`` or after ``end`` (22:xx is not off-hours)."""
    return flag((hour < start) | (hour > end))


def velocity_24h(count_24h: Column) -> Column:
    return count_24h.cast("double") / 24.0


def velocity_7d(count_7d: Column) -> Column:
    return count_7d.cast("double") / 168.0


def velocity_burst(v24: Column, v7: Column, mode: str = "null_or_zero", upper: float = 50.0) -> Column:
    return cap(v24 / safe_denominator(v7, 0.01, mode), upper)


def _by_band(score: Column, field: int) -> Column:
    out = F.lit(RISK_BANDS[-1][field])
    for band in reversed(RISK_BANDS[:-1]):
        out = F.when(score < band[0], band[field]).otherwise(out)
    return out


def risk_level(score: Column) -> Column:
    """Decided on the unrounded score."""
    return _by_band(score, 1)


def recommended_action(score: Column) -> Column:
    return _by_band(score, 2)


def is_flagged(score: Column, threshold: float = LEGACY_FLAG_THRESHOLD) -> Column:
    """The legacy service's flag."""
    return score >= threshold


def rounded_score(score: Column) -> Column:
    return F.round(score, 4)


def iso_utc(ts: Column) -> Column:
    """UTC ISO-8601 with microseconds and a trailing Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
