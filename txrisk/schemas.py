"""Record layouts (StructTypes) and feature lists.

Column names and their order are fixed values that must equal the
reference's for the layouts to be interchangeable.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: column names / orders of the reference layouts ----

# L1 raw source CSV header -> L2 subset name (order as in the source file)
SUBSET_RENAME = {
    "User_ID": "user_id",
    "Transaction_Amount": "transaction_amount",
    "Timestamp": "timestamp",
    "Account_Balance": "account_balance",
    "Previous_Fraudulent_Activity": "previous_fraudulent_activity",
    "Daily_Transaction_Count": "daily_transaction_count",
    "Avg_Transaction_Amount_7d": "avg_transaction_amount_7d",
    "Failed_Transaction_Count_7d": "failed_transaction_count_7d",
    "Card_Type": "card_type",
    "Card_Age": "card_age",
    "Risk_Score": "risk_score",
    "Is_Weekend": "is_weekend",
    "Fraud_Label": "fraud_label",
}

# L3 legacy raw inputs and feature list
LEGACY_RAW_COLUMNS = [
    "user_id", "amount", "timestamp", "account_balance", "previous_fraudulent_activity",
    "daily_transaction_count", "avg_transaction_amount_7d", "failed_transaction_count_7d",
    "card_type", "card_age", "risk_score", "is_weekend",
]
LEGACY_FEATURE_COLUMNS = [
    "user_id", "amount", "account_balance", "previous_fraudulent_activity",
    "daily_transaction_count", "avg_transaction_amount_7d", "failed_transaction_count_7d",
    "card_type", "card_age", "risk_score", "is_weekend", "txn_hour", "txn_day_of_week",
    "txn_month",
]

# L4 transfer raw event and L5 transfer feature list
TRANSFER_RAW_COLUMNS = [
    "transaction_id", "user_id", "transaction_amount", "transaction_type", "merchant_category",
    "card_type", "card_age_months", "account_balance_before", "avg_transaction_amount_7d",
    "transaction_count_24h", "transaction_count_7d", "previous_fraud_flag", "is_new_receiver",
    "is_weekend", "timestamp",
]
TRANSFER_FEATURE_COLUMNS = [
    "amount_to_avg_ratio", "balance_drain_ratio", "velocity_24h", "velocity_7d", "velocity_burst",
    "card_age_months", "card_type", "is_new_receiver", "is_new_card", "is_round_amount",
    "is_large_amount", "is_off_hours", "previous_fraud_flag", "is_weekend", "txn_hour",
    "txn_day_of_week",
]

# Target column candidates, first present wins
TARGET_CANDIDATES = ("is_fraud", "fraud_label", "target")

# L7 request message: (snake name, camelCase alias, kind, required, default, non-negative)
REQUEST_FIELDS = [
    ("transaction_id", "transactionId", "str", True, None, False),
    ("user_id", "userId", "str", True, None, False),
    ("transaction_amount", "transactionAmount", "float", True, None, True),
    ("transaction_type", "transactionType", "str", False, "TRANSFER", False),
    ("merchant_category", "merchantCategory", "str", False, "P2P_TRANSFER", False),
    ("card_type", "cardType", "str", True, None, False),
    ("card_age_months", "cardAgeMonths", "int", True, None, True),
    ("account_balance_before", "accountBalanceBefore", "float", True, None, True),
    ("avg_transaction_amount_7d", "avgTransactionAmount7d", "float", True, None, True),
    ("transaction_count_24h", "transactionCount24h", "int", True, None, True),
    ("transaction_count_7d", "transactionCount7d", "int", True, None, True),
    ("previous_fraud_flag", "previousFraudFlag", "bool", True, None, False),
    ("is_new_receiver", "isNewReceiver", "bool", True, None, False),
    ("is_weekend", "isWeekend", "bool", True, None, False),
    ("timestamp", "timestamp", "str", True, None, False),
]

# L9 legacy payload: (name, kind); unknown keys are refused
LEGACY_PAYLOAD_FIELDS = [
    ("user_id", "str"), ("amount", "float"), ("timestamp", "str"), ("account_balance", "float"),
    ("previous_fraudulent_activity", "int"), ("daily_transaction_count", "float"),
    ("avg_transaction_amount_7d", "float"), ("failed_transaction_count_7d", "float"),
    ("card_type", "str"), ("card_age", "float"), ("risk_score", "float"), ("is_weekend", "int"),
]

# Decision policy bands and labels
RISK_BANDS = [(0.30, "LOW", "APPROVE"), (0.70, "MEDIUM", "HOLD"), (None, "HIGH", "BLOCK")]
LEGACY_FLAG_THRESHOLD = 0.5

# ---- StructTypes ----

L1_RAW = T.StructType([
    T.StructField("Transaction_ID", T.StringType()),
    T.StructField("User_ID", T.StringType()),
    T.StructField("Transaction_Amount", T.DoubleType()),
    T.StructField("Timestamp", T.StringType()),
    T.StructField("Account_Balance", T.DoubleType()),
    T.StructField("Previous_Fraudulent_Activity", T.IntegerType()),
    T.StructField("Daily_Transaction_Count", T.IntegerType()),
    T.StructField("Avg_Transaction_Amount_7d", T.DoubleType()),
    T.StructField("Failed_Transaction_Count_7d", T.IntegerType()),
    T.StructField("Card_Type", T.StringType()),
    T.StructField("Card_Age", T.IntegerType()),
    T.StructField("Risk_Score", T.DoubleType()),
    T.StructField("Is_Weekend", T.IntegerType()),
    T.StructField("Fraud_Label", T.IntegerType()),
])

L4_TRANSFER_RAW = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("transaction_amount", T.DoubleType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("card_type", T.StringType()),
    T.StructField("card_age_months", T.IntegerType()),
    T.StructField("account_balance_before", T.DoubleType()),
    T.StructField("avg_transaction_amount_7d", T.DoubleType()),
    T.StructField("transaction_count_24h", T.IntegerType()),
    T.StructField("transaction_count_7d", T.IntegerType()),
    T.StructField("previous_fraud_flag", T.BooleanType()),
    T.StructField("is_new_receiver", T.BooleanType()),
    T.StructField("is_weekend", T.BooleanType()),
    T.StructField("timestamp", T.StringType()),
])

RESULT_SCHEMA = T.StructType([
    T.StructField("transactionId", T.StringType()),
    T.StructField("riskScore", T.DoubleType()),
    T.StructField("riskLevel", T.StringType()),
    T.StructField("recommendedAction", T.StringType()),
    T.StructField("evaluatedAt", T.StringType()),
    T.StructField("featureImportance", T.MapType(T.StringType(), T.DoubleType())),
])


def require_columns(df, required, what="input") -> None:
    """Fail before planning when columns are missing; names listed sorted."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise KeyError(f"Missing required columns in {what}: {', '.join(missing)}")
