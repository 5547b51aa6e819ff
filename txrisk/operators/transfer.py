"""Transfer feature job (M15, F1-F15): raw transfer events (L4) -> L5.

One projection: every feature is a Column expression, so the job is a
single scan -> Project stage with no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import scalars as S
from txrisk.schemas import TRANSFER_FEATURE_COLUMNS, TRANSFER_RAW_COLUMNS, require_columns

INVALID_TS = "a time cannot be read"


def checked_timestamp(df: DataFrame, column: str = "timestamp", on_invalid: str = "fail"):
    """Parsed UTC timestamp; ``fail`` raises at run time on any bad value,
    ``keep`` leaves NULL for a quarantine step to route."""
    ts = S.parse_timestamp(F.col(column), df.schema[column].dataType)
    if on_invalid == "fail":
        return F.when(ts.isNull(), F.raise_error(F.lit(INVALID_TS))).otherwise(ts)
    if on_invalid == "keep":
        return ts
    raise ValueError("on_invalid must be 'fail' or 'keep'")


def time_features(df: DataFrame, column: str = "timestamp", on_invalid: str = "fail") -> DataFrame:
    ts = checked_timestamp(df, column, on_invalid)
    return df.withColumns({"txn_hour": S.txn_hour(ts), "txn_day_of_week": S.txn_day_of_week(ts)})


def amount_ratios(df: DataFrame, zero_mode: str = "null_or_zero") -> DataFrame:
    amount = S.nan_to_null(F.col("transaction_amount").cast("double"))
    return df.withColumns({
        "amount_to_avg_ratio": S.capped_ratio(amount, S.nan_to_null(F.col("avg_transaction_amount_7d")), 100.0, 1.0, zero_mode),
        "balance_drain_ratio": S.capped_ratio(amount, S.nan_to_null(F.col("account_balance_before")), 1.0, 1.0, zero_mode),
    })


def velocity_features(df: DataFrame, zero_mode: str = "null_or_zero") -> DataFrame:
    v24 = S.velocity_24h(F.col("transaction_count_24h"))
    v7 = S.velocity_7d(F.col("transaction_count_7d"))
    return df.withColumns({"velocity_24h": v24, "velocity_7d": v7,
                           "velocity_burst": S.velocity_burst(v24, v7, zero_mode)})


def risk_indicators(df: DataFrame) -> DataFrame:
    amount = S.nan_to_null(F.col("transaction_amount").cast("double"))
    off = S.is_off_hours(F.col("txn_hour")) if "txn_hour" in df.columns else F.lit(0)
    return df.withColumns({
        "is_new_card": S.is_new_card(F.col("card_age_months")),
        "is_round_amount": S.is_round_amount(amount),
        "is_large_amount": S.is_large_amount(amount),
        "is_off_hours": off,
    })


def transfer_features(df: DataFrame, zero_mode: str = "null_or_zero", on_invalid: str = "fail",
                      keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """L4 -> (keep columns +) the 16 L5 features in their fixed order."""
    require_columns(df, TRANSFER_RAW_COLUMNS, "transfer events")
    out = time_features(df, "timestamp", on_invalid)
    out = amount_ratios(out, zero_mode)
    out = velocity_features(out, zero_mode)
    out = risk_indicators(out)
    out = out.withColumns({c: F.col(c).cast("int") for c in ("previous_fraud_flag", "is_new_receiver", "is_weekend")})
    return out.select(*keep, *TRANSFER_FEATURE_COLUMNS)


def split_on_timestamp(df: DataFrame, column: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Quarantine mode of the time parser: (rows with a parsable timestamp,
    rows without one plus a ``reason``)."""
    parsed = checked_timestamp(df, column, "keep").isNotNull()
    return df.filter(parsed), df.filter(~parsed).withColumn("reason", F.lit(f"{column}:invalid"))
