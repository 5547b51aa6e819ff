"""Bridge from the provided tables to the reference's record layouts.

Every fixture is a lazy Spark plan over the parquet tables, so its work
grows with them. Definitions (shared with the DuckDB oracle):

transfers  = events joined to customer on user_id = c_custkey
  k                      integer in props
  transaction_id         'TXN_' + event_id zero-padded to 6 digits
  transaction_amount     k % 10 = 0 ? floor(value*(1+k)/100)*100 : floor(value*(1+k)*100)/100
  card_type              CREDIT for segments BUILDING / MACHINERY, else DEBIT
  card_age_months        user_id % 60
  account_balance_before c_acctbal if > 0 else 0
  avg_transaction_amount_7d  mean amount over [t - 7 d + 1 us, t - 1 us], 0 if none
  transaction_count_24h / _7d  rows over [t - 1 d + 1 us, t - 1 us] / 7 d
  previous_fraud_flag    an earlier row is an error with k < 5
  is_new_receiver        first row of (user, k) by (ts, event_id)
  fraud_label            (amount > 0.7 * c_acctbal and k even) or (error and k < 5)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.functions.hashing import u01
from txrisk.functions.scalars import to_micros
from txrisk.operators import timeframes as tf
from txrisk.schemas import TRANSFER_FEATURE_COLUMNS
from txrisk.session import prepare

_PLANS: dict = {}


def _memo(fn):
    """Fixture plans are immutable lazy DataFrames: build each once per
    (session, data folder, arguments) and hand out the same plan."""
    import functools

    @functools.wraps(fn)
    def wrapper(spark, sf_dir, *args, **kwargs):
        key = (fn.__name__, id(spark), sf_dir.rstrip("/"), args, tuple(sorted(kwargs.items())))
        prepare(spark)
        # the session is kept with its plan, so that no later session can have its id
        if key not in _PLANS or _PLANS[key][0] is not spark:
            _PLANS[key] = (spark, fn(spark, sf_dir, *args, **kwargs))
        return _PLANS[key][1]
    return wrapper


DAY = tf.DAY_US
WEEK = 7 * DAY

# fixed values: card segments mapped to CREDIT
CREDIT_SEGMENTS = ["BUILDING", "MACHINERY"]


@_memo
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def transfer_amount(value: Column, k: Column) -> Column:
    raw = value * (F.lit(1) + k)
    return F.when(k % 10 == 0, (F.floor(raw / 100) * 100).cast("double")) \
            .otherwise(F.floor(raw * 100).cast("double") / 100)


@_memo
def transfers(spark: SparkSession, sf_dir: str, bucket_days: int = 14) -> DataFrame:
    """L4 transfer events + event_id, fraud_label and a few bridge columns."""
    ev = (table(spark, sf_dir, "events")
          .select("event_id", "ts", "user_id", "event_type", "value", _k().alias("k"))
          .withColumn("_us", to_micros(F.col("ts")))
          .withColumn("transaction_amount", transfer_amount(F.col("value"), F.col("k")))
          .withColumn("_bad", (F.col("event_type") == "error") & (F.col("k") < 5)))

    rows = tf.explode_buckets(ev, "_us", bucket_days * DAY, WEEK)
    w7 = tf.frame_by_time("user_id", "_us", -WEEK + 1, -1)
    w1 = tf.frame_by_time("user_id", "_us", -DAY + 1, -1)
    before = tf.frame_rows("user_id", ["_us", "event_id"], Window.unboundedPreceding, -1)
    windowed = (rows.select(
        "*",
        F.avg("transaction_amount").over(w7).alias("_avg7"),
        F.count("transaction_amount").over(w7).cast("int").alias("transaction_count_7d"),
        F.count("transaction_amount").over(w1).cast("int").alias("transaction_count_24h"),
        F.count(F.when(F.col("event_type") == "error", 1)).over(w7).cast("int").alias("failed_count_7d"),
        F.max(F.col("_bad").cast("int")).over(before).alias("_bad_before"))
        .filter(F.col(tf.PRIMARY)))
    carry = tf.bucket_carry(rows, "user_id", "_us", {"bad": F.col("_bad")})
    first_of_k = ev.groupBy("user_id", "k").agg(F.min(F.struct("_us", "event_id")).alias("_first"))

    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    # these three grow with the input: broadcast, each would pass whole through the driver
    out = (windowed
           .join(carry.hint("merge"), on=["user_id", tf.BUCKET], how="left")
           .join(first_of_k.hint("merge"), on=["user_id", "k"], how="left")
           .join(cust.hint("merge"), F.col("user_id") == F.col("c_custkey"), "inner"))
    amount = F.col("transaction_amount")
    return out.select(
        "event_id",
        F.format_string("TXN_%06d", F.col("event_id")).alias("transaction_id"),
        F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("user_id"),
        amount.alias("transaction_amount"),
        F.lit("TRANSFER").alias("transaction_type"),
        F.lit("P2P_TRANSFER").alias("merchant_category"),
        F.when(F.col("c_mktsegment").isin(*CREDIT_SEGMENTS), "CREDIT").otherwise("DEBIT").alias("card_type"),
        (F.col("user_id") % 60).cast("int").alias("card_age_months"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.lit(0.0)).alias("account_balance_before"),
        F.coalesce(F.col("_avg7"), F.lit(0.0)).alias("avg_transaction_amount_7d"),
        "transaction_count_24h", "transaction_count_7d",
        ((F.coalesce(F.col("_bad_before"), F.lit(0)) + F.col("prev_any_bad")) > 0).alias("previous_fraud_flag"),
        (F.struct("_us", "event_id") == F.col("_first")).alias("is_new_receiver"),
        (F.weekday("ts") >= 5).alias("is_weekend"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (((amount > F.lit(0.7) * F.col("c_acctbal")) & (F.col("k") % 2 == 0))
         | ((F.col("event_type") == "error") & (F.col("k") < 5))).cast("int").alias("fraud_label"),
        F.col("user_id").alias("user_key"), "k", "event_type", "failed_count_7d", "c_mktsegment", "c_acctbal",
    )


@_memo
def legacy_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 raw source layout (Title_Case) plus an extra Transaction_ID column."""
    t = transfers(spark, sf_dir)
    return t.select(
        F.col("transaction_id").alias("Transaction_ID"),
        F.col("user_id").alias("User_ID"),
        F.col("transaction_amount").alias("Transaction_Amount"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("account_balance_before").alias("Account_Balance"),
        F.col("previous_fraud_flag").cast("int").alias("Previous_Fraudulent_Activity"),
        F.col("transaction_count_24h").alias("Daily_Transaction_Count"),
        F.col("avg_transaction_amount_7d").alias("Avg_Transaction_Amount_7d"),
        F.col("failed_count_7d").alias("Failed_Transaction_Count_7d"),
        F.col("c_mktsegment").alias("Card_Type"),
        (F.col("card_age_months") * 30).alias("Card_Age"),
        u01(F.concat(F.col("event_id").cast("string"), F.lit("|risk"))).alias("Risk_Score"),
        F.col("is_weekend").cast("int").alias("Is_Weekend"),
        F.col("fraud_label").alias("Fraud_Label"),
    )


@_memo
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label, score with three decimals (ties), positives higher."""
    t = transfers(spark, sf_dir).select("event_id", "fraud_label")
    eid = F.col("event_id").cast("string")
    raw = 0.5 * u01(F.concat(eid, F.lit("|score"))) + \
        0.5 * F.col("fraud_label") * u01(F.concat(eid, F.lit("|pos")))
    return t.select("event_id", F.col("fraud_label").alias("label"),
                    (F.floor(raw * 1000).cast("double") / 1000).alias("score"))


@_memo
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, contribs array<struct<feature, value>> over the 16 L5 names."""
    ev = table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id").cast("string")
    items = [F.struct(F.lit(n).alias("feature"),
                      (u01(F.concat(eid, F.lit("|" + n))) - 0.5).alias("value"))
             for n in TRANSFER_FEATURE_COLUMNS]
    return ev.select("event_id", F.array(*items).alias("contribs"))


@_memo
def timestamp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, text: event instants written as ISO-8601 with Z, with a
    +03:00 offset, naive, or unparsable (every 7th event)."""
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    eid = F.col("event_id")
    text = (F.when(eid % 7 == 0, F.concat(F.lit("bad-"), eid.cast("string")))
             .when(eid % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
             .when(eid % 3 == 1, F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"),
                                          F.lit("+03:00")))
             .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return ev.select("event_id", text.alias("text"))


@_memo
def behavior_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("timestamp"))


@_memo
def behavior_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "user_id",
        F.col("value").alias("amount"), F.col("ts").alias("timestamp"))


# ---- request messages (L7) with defects chosen by event_id ----

CAMEL = [
    ("transactionId", "transaction_id"), ("userId", "user_id"),
    ("transactionAmount", "transaction_amount"), ("transactionType", "transaction_type"),
    ("merchantCategory", "merchant_category"), ("cardType", "card_type"),
    ("cardAgeMonths", "card_age_months"), ("accountBalanceBefore", "account_balance_before"),
    ("avgTransactionAmount7d", "avg_transaction_amount_7d"),
    ("transactionCount24h", "transaction_count_24h"), ("transactionCount7d", "transaction_count_7d"),
    ("previousFraudFlag", "previous_fraud_flag"), ("isNewReceiver", "is_new_receiver"),
    ("isWeekend", "is_weekend"), ("timestamp", "timestamp"),
]
# defect rules in priority order: (modulus, name)
DEFECTS = [(50, "truncated"), (53, "negative_amount"), (59, "missing_card_type"),
           (61, "snake_case"), (67, "extra_key"), (71, "numeric_strings"),
           (73, "fractional_int"), (79, "alias_null")]


@_memo
def requests_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, defect, value (JSON text of an evaluation request)."""
    t = transfers(spark, sf_dir)
    ts_text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def field(snake: str) -> Column:
        return ts_text if snake == "timestamp" else F.col(snake)

    def obj(overrides: dict | None = None, drop=(), snake_keys=False, extra=None) -> Column:
        overrides = overrides or {}
        parts = []
        for camel, snake in CAMEL:
            if camel in drop:
                continue
            parts.append((overrides[camel] if camel in overrides else field(snake)).alias(snake if snake_keys else camel))
        if extra:
            parts += [v.alias(k) for k, v in extra.items()]
        return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})

    base = obj()
    variants = {
        "truncated": F.substring(base, 1, (F.length(base) / 2).cast("int")),
        "negative_amount": obj({"transactionAmount": -(F.col("transaction_amount") + 1)}),
        "missing_card_type": obj(drop=("cardType",)),
        "snake_case": obj(snake_keys=True),
        "extra_key": obj(extra={"channel": F.lit("web")}),
        "numeric_strings": obj({"transactionAmount": F.col("transaction_amount").cast("string"),
                                "cardAgeMonths": F.col("card_age_months").cast("string"),
                                "transactionCount24h": F.col("transaction_count_24h").cast("string")}),
        "fractional_int": obj({"cardAgeMonths": F.col("card_age_months") + F.lit(0.5)}),
        "alias_null": obj({"userId": F.lit(None).cast("string")}, extra={"user_id": F.col("user_id")}),
    }
    defect = F.lit("none")
    value = base
    for modulus, name in reversed(DEFECTS):
        hit = F.col("event_id") % modulus == 0
        defect = F.when(hit, F.lit(name)).otherwise(defect)
        value = F.when(hit, variants[name]).otherwise(value)
    return t.select("event_id", defect.alias("defect"), value.alias("value"))


# ---- legacy payload messages (L9) with defects chosen by event_id ----

LEGACY_DEFECTS = [(50, "truncated"), (59, "missing_card_type"), (67, "extra_key"),
                  (71, "numeric_strings"), (73, "fractional_int")]


@_memo
def legacy_payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, defect, value: the 12 raw legacy fields as snake_case JSON."""
    raw = legacy_raw(spark, sf_dir).withColumn("event_id", F.substring("Transaction_ID", 5, 20).cast("long"))
    src = {
        "user_id": F.col("User_ID"), "amount": F.col("Transaction_Amount"), "timestamp": F.col("Timestamp"),
        "account_balance": F.col("Account_Balance"),
        "previous_fraudulent_activity": F.col("Previous_Fraudulent_Activity"),
        "daily_transaction_count": F.col("Daily_Transaction_Count"),
        "avg_transaction_amount_7d": F.col("Avg_Transaction_Amount_7d"),
        "failed_transaction_count_7d": F.col("Failed_Transaction_Count_7d"),
        "card_type": F.col("Card_Type"), "card_age": F.col("Card_Age"), "risk_score": F.col("Risk_Score"),
        "is_weekend": F.col("Is_Weekend"),
    }

    def obj(overrides=None, drop=(), extra=None):
        overrides = overrides or {}
        parts = [(overrides.get(k, c)).alias(k) for k, c in src.items() if k not in drop]
        parts += [c.alias(k) for k, c in (extra or {}).items()]
        return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})

    base = obj()
    variants = {
        "truncated": F.substring(base, 1, (F.length(base) / 2).cast("int")),
        "missing_card_type": obj(drop=("card_type",)),
        "extra_key": obj(extra={"channel": F.lit("web")}),
        "numeric_strings": obj({"amount": F.col("Transaction_Amount").cast("string")}),
        "fractional_int": obj({"previous_fraudulent_activity": F.col("Previous_Fraudulent_Activity") + F.lit(0.5)}),
    }
    defect, value = F.lit("none"), base
    for modulus, name in reversed(LEGACY_DEFECTS):
        hit = F.col("event_id") % modulus == 0
        defect = F.when(hit, F.lit(name)).otherwise(defect)
        value = F.when(hit, variants[name]).otherwise(value)
    return raw.select("event_id", defect.alias("defect"), value.alias("value"))
