"""Request validation edge cases (lax coercion, alias precedence, reasons)."""

import json

from txrisk.operators.validation import strict_payload, validate_requests

BASE = {"transactionId": "T1", "userId": "U1", "transactionAmount": 100.0, "cardType": "DEBIT",
        "cardAgeMonths": 12, "accountBalanceBefore": 1000.0, "avgTransactionAmount7d": 50.0,
        "transactionCount24h": 1, "transactionCount7d": 3, "previousFraudFlag": False,
        "isNewReceiver": True, "isWeekend": False, "timestamp": "2024-01-15T14:30:00Z"}


def _run(spark, payloads, fn=validate_requests):
    df = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)],
                               "id long, value string")
    return {r["id"]: r for r in fn(df).collect()}


def test_cases(spark):
    snake = {"transaction_id": "T1", "user_id": "U1", "transaction_amount": 1.0, "card_type": "C",
             "card_age_months": 1, "account_balance_before": 1.0, "avg_transaction_amount_7d": 1.0,
             "transaction_count_24h": 1, "transaction_count_7d": 1, "previous_fraud_flag": True,
             "is_new_receiver": False, "is_weekend": True, "timestamp": "x"}
    cases = [
        BASE,                                                   # 0 valid, defaults applied
        {**BASE, "cardAgeMonths": 3.5},                         # 1 fractional int
        {**BASE, "cardAgeMonths": 3.0, "transactionAmount": "12.5", "transactionCount24h": "4"},  # 2 lax ok
        {**BASE, "userId": None, "user_id": "U9"},              # 3 alias wins even when null
        {**BASE, "transactionAmount": -1},                      # 4 negative
        {k: v for k, v in BASE.items() if k != "cardType"},     # 5 missing
        '{"transactionId": "T1", "userId": ',                   # 6 malformed
        snake,                                                  # 7 snake_case accepted
        {**BASE, "extra": 1},                                   # 8 unknown key ignored
        {**BASE, "isWeekend": 2, "previousFraudFlag": "yes", "userId": 5},  # 9 bool 2 bad, "yes" ok, int not str
        {**BASE, "transactionType": None},                      # 10 explicit null on defaulted field
    ]
    r = _run(spark, cases)
    assert r[0]["is_valid"] and r[0]["transaction_type"] == "TRANSFER" and r[0]["merchant_category"] == "P2P_TRANSFER"
    assert r[1]["errors"] == "cardAgeMonths:type" and r[1]["card_age_months"] is None
    assert r[2]["is_valid"] and r[2]["card_age_months"] == 3 and r[2]["transaction_amount"] == 12.5
    assert r[2]["transaction_count_24h"] == 4
    assert r[3]["errors"] == "userId:null"
    assert r[4]["errors"] == "transactionAmount:negative"
    assert r[5]["errors"] == "cardType:missing"
    assert r[6]["errors"] == "json:malformed" and r[6]["transaction_id"] is None
    assert r[7]["is_valid"] and r[7]["previous_fraud_flag"] is True
    assert r[8]["is_valid"]
    assert r[9]["errors"] == "userId:type;isWeekend:type" and r[9]["previous_fraud_flag"] is True
    assert r[10]["errors"] == "transactionType:null"


def test_strict_payload_refuses_unknown_keys(spark):
    good = {"user_id": "u", "amount": 1.0, "timestamp": "2024-01-01 00:00:00", "account_balance": 2.0,
            "previous_fraudulent_activity": 0, "daily_transaction_count": 1.0, "avg_transaction_amount_7d": 1.0,
            "failed_transaction_count_7d": 0.0, "card_type": "Visa", "card_age": 10.0, "risk_score": 0.5,
            "is_weekend": 1}
    r = _run(spark, [good, {**good, "zeta": 1, "alpha": 2}, {**good, "userId": "camel"}], strict_payload)
    assert r[0]["is_valid"]
    assert r[1]["errors"] == "alpha:extra_forbidden;zeta:extra_forbidden"
    assert r[2]["errors"] == "userId:extra_forbidden"


def test_filter_on_the_outcome_repeats_nothing(spark):
    df = spark.createDataFrame([(json.dumps(BASE),), ("{",)], "value string")
    kept = validate_requests(df).filter("is_valid")
    lookups = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("variant_get(")
    assert lookups(kept) == lookups(validate_requests(df)) and kept.count() == 1
