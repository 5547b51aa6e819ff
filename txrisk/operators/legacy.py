"""Legacy card-transaction layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import scalars as S
from txrisk.functions.hashing import u01
from txrisk.operators.transfer import checked_timestamp
from txrisk.schemas import (LEGACY_FEATURE_COLUMNS, LEGACY_RAW_COLUMNS, SUBSET_RENAME,
                            TRANSFER_FEATURE_COLUMNS, require_columns)


def subset_rename(df: DataFrame, mapping: dict[str, str] = SUBSET_RENAME) -> DataFrame:
    """Keep the mapped columns only, renamed (column pruning reaches the scan)."""
    require_columns(df, mapping.keys(), "raw source")
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def legacy_features(df: DataFrame, on_invalid: str = "fail", keep: tuple[str, ...] = ()) -> DataFrame:
    """L3: raw legacy columns -> (keep columns +) the feature list with hour / weekday / month."""
    require_columns(df, LEGACY_RAW_COLUMNS, "legacy transactions")
    ts = checked_timestamp(df, "timestamp", on_invalid)
    doubles = ("amount", "account_balance", "daily_transaction_count", "avg_transaction_amount_7d",
               "failed_transaction_count_7d", "card_age", "risk_score")
    out = df.withColumns({c: S.nan_to_null(F.col(c).cast("double")) for c in doubles})
    out = out.withColumns({
        "user_id": F.col("user_id").cast("string"),
        "previous_fraudulent_activity": F.col("previous_fraudulent_activity").cast("int"),
        "is_weekend": F.col("is_weekend").cast("int"),
        "txn_hour": S.txn_hour(ts), "txn_day_of_week": S.txn_day_of_week(ts), "txn_month": S.txn_month(ts),
    })
    return out.select(*keep, *LEGACY_FEATURE_COLUMNS)


def legacy_training_table(subset: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Subset layout -> the legacy features and the target ``is_fraud``."""
    df = subset.withColumnRenamed("transaction_amount", "amount")
    require_columns(df, LEGACY_RAW_COLUMNS + ["fraud_label"], "subset")
    out = legacy_features(df, keep=(*keep, "fraud_label"))
    return out.select(*keep, *LEGACY_FEATURE_COLUMNS, F.col("fraud_label").cast("int").alias("is_fraud"))


OLD_LAYOUT_MARKER = "transaction_amount"


def load_transfer_dataset(df: DataFrame, row_id: str = "Transaction_ID", keep: tuple[str, ...] = ()) -> DataFrame:
    """Transfer training table from either layout: L6 (has transaction_amount)
    or the old Title_Case layout, adapted here. Output: features + ``label``."""
    if OLD_LAYOUT_MARKER in df.columns:
        require_columns(df, TRANSFER_FEATURE_COLUMNS + ["fraud_label"], "transfer training data")
        return df.select(*keep, *TRANSFER_FEATURE_COLUMNS, F.col("fraud_label").cast("int").alias("label"))
    return legacy_layout_adapter(df, row_id, keep)


def legacy_layout_adapter(df: DataFrame, row_id: str = "Transaction_ID", keep: tuple[str, ...] = ()) -> DataFrame:
    """Old layout -> L5 using the zero-only denominators and lenient time.

    The reference draws ``is_new_receiver`` at random (30 % ones); here it
    is a deterministic hash of the row id so reruns agree.
    """
    amount = S.nan_to_null(F.col("Transaction_Amount").cast("double"))
    balance = S.nan_to_null(F.col("Account_Balance").cast("double"))
    avg7 = S.nan_to_null(F.col("Avg_Transaction_Amount_7d").cast("double"))
    c24 = F.col("Daily_Transaction_Count")
    c7 = c24 * 3
    ts = F.try_to_timestamp(F.col("Timestamp").cast("string"))
    hour = F.coalesce(S.txn_hour(ts), F.lit(12))
    v24, v7 = S.velocity_24h(c24), S.velocity_7d(c7)
    age = F.col("Card_Age")
    feats = {
        "amount_to_avg_ratio": S.capped_ratio(amount, avg7, 100.0, 1.0, "zero_only"),
        "balance_drain_ratio": S.capped_ratio(amount, balance, 1.0, 1.0, "zero_only"),
        "velocity_24h": v24, "velocity_7d": v7,
        "velocity_burst": S.velocity_burst(v24, v7, "zero_only"),
        "card_age_months": age.cast("int"),
        "card_type": F.col("Card_Type").cast("string"),
        "is_new_receiver": (u01(F.concat(F.col(row_id).cast("string"), F.lit("|new_receiver"))) > 0.7).cast("int"),
        "is_new_card": S.is_new_card(age),
        "is_round_amount": S.is_round_amount(amount),
        "is_large_amount": S.is_large_amount(amount),
        "is_off_hours": S.is_off_hours(hour),
        "previous_fraud_flag": F.col("Previous_Fraudulent_Activity").cast("int"),
        "is_weekend": F.col("Is_Weekend").cast("int"),
        "txn_hour": hour,
        "txn_day_of_week": F.coalesce(S.txn_day_of_week(ts), F.lit(0)),
    }
    return df.select(*keep, *[feats[c].alias(c) for c in TRANSFER_FEATURE_COLUMNS],
                     F.col("Fraud_Label").cast("int").alias("label"))
