"""DuckDB oracle SQL, written independently of the Spark plans.

Shared CTEs rebuild the fixtures from the raw views; windows use DuckDB
RANGE frames or self-joins, splits use plain row_number().
"""

from __future__ import annotations

# events -> transfers (see txrisk.plans.fixtures for the definitions)
TRANSFERS_CTE = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         epoch_us(ts) AS us
  FROM events
), ev2 AS (
  SELECT *,
         CASE WHEN k % 10 = 0 THEN floor(value * (1 + k) / 100) * 100
              ELSE floor(value * (1 + k) * 100) / 100 END AS amount,
         (event_type = 'error' AND k < 5) AS bad
  FROM ev
), evw AS (
  SELECT *,
    avg(amount) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604799999999 PRECEDING AND 1 PRECEDING) AS avg7,
    count(amount) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604799999999 PRECEDING AND 1 PRECEDING) AS c7,
    count(amount) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS c24,
    count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604799999999 PRECEDING AND 1 PRECEDING) AS failed7,
    bool_or(bad) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad_before,
    row_number() OVER (PARTITION BY user_id, k ORDER BY us, event_id) AS rn_k
  FROM ev2
), transfers AS (
  SELECT event_id,
    printf('TXN_%06d', event_id) AS transaction_id,
    'USER_' || CAST(user_id AS VARCHAR) AS user_id,
    CAST(amount AS DOUBLE) AS transaction_amount,
    'TRANSFER' AS transaction_type,
    'P2P_TRANSFER' AS merchant_category,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'CREDIT' ELSE 'DEBIT' END AS card_type,
    CAST(user_id % 60 AS INTEGER) AS card_age_months,
    CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END AS account_balance_before,
    coalesce(avg7, 0.0) AS avg_transaction_amount_7d,
    CAST(c24 AS INTEGER) AS transaction_count_24h,
    CAST(c7 AS INTEGER) AS transaction_count_7d,
    coalesce(bad_before, false) AS previous_fraud_flag,
    (rn_k = 1) AS is_new_receiver,
    (isodow(ts) >= 6) AS is_weekend,
    ts AS "timestamp",
    CAST(((amount > 0.7 * c_acctbal AND k % 2 = 0) OR (event_type = 'error' AND k < 5)) AS INTEGER) AS fraud_label,
    user_id AS user_key, k, event_type, CAST(failed7 AS INTEGER) AS failed_count_7d, c_mktsegment, c_acctbal
  FROM evw JOIN customer ON user_id = c_custkey
)"""

# transfers -> L5 features (null_or_zero denominators)
FEATURES_CTE = """
feat AS (
  SELECT t.*,
    CAST(hour("timestamp") AS INTEGER) AS txn_hour,
    CAST(isodow("timestamp") - 1 AS INTEGER) AS txn_day_of_week,
    CASE WHEN r1 > 100 THEN 100.0 ELSE r1 END AS amount_to_avg_ratio,
    CASE WHEN r2 > 1 THEN 1.0 ELSE r2 END AS balance_drain_ratio,
    transaction_count_24h / 24.0 AS velocity_24h,
    transaction_count_7d / 168.0 AS velocity_7d,
    CASE WHEN b > 50 THEN 50.0 ELSE b END AS velocity_burst,
    CAST(coalesce(card_age_months < 3, false) AS INTEGER) AS is_new_card,
    CAST(coalesce(transaction_amount % 100 = 0, false) AS INTEGER) AS is_round_amount,
    CAST(coalesce(transaction_amount > 5000, false) AS INTEGER) AS is_large_amount,
    CAST(coalesce(hour("timestamp") < 6 OR hour("timestamp") > 22, false) AS INTEGER) AS is_off_hours,
    CAST(previous_fraud_flag AS INTEGER) AS prev_flag_i,
    CAST(is_new_receiver AS INTEGER) AS new_recv_i,
    CAST(is_weekend AS INTEGER) AS weekend_i
  FROM (
    SELECT *,
      transaction_amount / CASE WHEN avg_transaction_amount_7d IS NULL OR avg_transaction_amount_7d = 0 THEN 1.0 ELSE avg_transaction_amount_7d END AS r1,
      transaction_amount / CASE WHEN account_balance_before IS NULL OR account_balance_before = 0 THEN 1.0 ELSE account_balance_before END AS r2,
      (transaction_count_24h / 24.0) / CASE WHEN transaction_count_7d / 168.0 = 0 THEN 0.01 ELSE transaction_count_7d / 168.0 END AS b
    FROM transfers
  ) t
)"""

FEATURE_SELECT = """
    round(amount_to_avg_ratio, 6) AS amount_to_avg_ratio, round(balance_drain_ratio, 6) AS balance_drain_ratio,
    round(velocity_24h, 6) AS velocity_24h, round(velocity_7d, 6) AS velocity_7d,
    round(velocity_burst, 6) AS velocity_burst, card_age_months, card_type,
    new_recv_i AS is_new_receiver, is_new_card, is_round_amount, is_large_amount, is_off_hours,
    prev_flag_i AS previous_fraud_flag, weekend_i AS is_weekend, txn_hour, txn_day_of_week"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


ORACLE: dict[str, str] = {}

ORACLE["transfer_features"] = with_ctes(TRANSFERS_CTE, FEATURES_CTE) + f"""
SELECT event_id, {FEATURE_SELECT} FROM feat"""

ORACLE["class_means"] = with_ctes(TRANSFERS_CTE, FEATURES_CTE) + """
SELECT fraud_label,
  CAST(count(*) AS BIGINT) AS n_rows,
  round(avg(transaction_amount), 6) AS mean_transaction_amount,
  round(avg(balance_drain_ratio), 6) AS mean_balance_drain_ratio,
  round(avg(amount_to_avg_ratio), 6) AS mean_amount_to_avg_ratio,
  round(avg(velocity_burst), 6) AS mean_velocity_burst,
  round(avg(transaction_count_24h), 6) AS mean_transaction_count_24h,
  round(avg(card_age_months), 6) AS mean_card_age_months
FROM feat GROUP BY fraud_label"""


def u01(expr: str) -> str:
    return f"(CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT) / 4294967296.0)"


LEGACY_RAW_CTE = f"""
legacy_raw AS (
  SELECT transaction_id AS Transaction_ID, user_id AS User_ID, transaction_amount AS Transaction_Amount,
    strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "Timestamp",
    account_balance_before AS Account_Balance,
    CAST(previous_fraud_flag AS INTEGER) AS Previous_Fraudulent_Activity,
    transaction_count_24h AS Daily_Transaction_Count,
    avg_transaction_amount_7d AS Avg_Transaction_Amount_7d,
    failed_count_7d AS Failed_Transaction_Count_7d,
    c_mktsegment AS Card_Type,
    card_age_months * 30 AS Card_Age,
    {u01("CAST(event_id AS VARCHAR) || '|risk'")} AS Risk_Score,
    CAST(is_weekend AS INTEGER) AS Is_Weekend,
    fraud_label AS Fraud_Label
  FROM transfers
)"""

SCORES_CTE = f"""
scores AS (
  SELECT event_id, fraud_label AS label,
    floor(1000 * (0.5 * {u01("CAST(event_id AS VARCHAR) || '|score'")}
                  + 0.5 * fraud_label * {u01("CAST(event_id AS VARCHAR) || '|pos'")})) / 1000 AS score
  FROM transfers
)"""

ORACLE["amount_ratios"] = with_ctes(TRANSFERS_CTE, FEATURES_CTE) + """
SELECT event_id, round(amount_to_avg_ratio, 6) AS amount_to_avg_ratio,
  round(balance_drain_ratio, 6) AS balance_drain_ratio,
  round(CASE WHEN rz > 1 THEN 1.0 ELSE rz END, 6) + 0.0 AS drain_zero_only,
  round(CASE WHEN rn > 1 THEN 1.0 ELSE rn END, 6) + 0.0 AS drain_nonpositive
FROM (SELECT *, transaction_amount / CASE WHEN c_acctbal = 0 THEN 1.0 ELSE c_acctbal END AS rz,
                transaction_amount / CASE WHEN c_acctbal <= 0 THEN 1.0 ELSE c_acctbal END AS rn FROM feat)"""

ORACLE["velocity_features"] = with_ctes(TRANSFERS_CTE, FEATURES_CTE) + """
SELECT event_id, round(velocity_24h, 6) AS velocity_24h, round(velocity_7d, 6) AS velocity_7d,
  round(velocity_burst, 6) AS velocity_burst FROM feat"""

ORACLE["risk_indicators"] = with_ctes(TRANSFERS_CTE, FEATURES_CTE) + """
SELECT event_id, is_new_card, is_round_amount, is_large_amount, is_off_hours FROM feat"""

ORACLE["time_features"] = with_ctes(TRANSFERS_CTE) + """
SELECT event_id, CAST(hour("timestamp") AS INTEGER) AS txn_hour,
  CAST(isodow("timestamp") - 1 AS INTEGER) AS txn_day_of_week,
  CAST(month("timestamp") AS INTEGER) AS txn_month FROM transfers"""

ORACLE["parse_timestamps"] = """
WITH t AS (
  SELECT event_id, CASE
    WHEN event_id % 7 = 0 THEN 'bad-' || CAST(event_id AS VARCHAR)
    WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN event_id % 3 = 1 THEN strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S') || '+03:00'
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS text
  FROM events
), p AS (
  SELECT event_id, text, CASE
    WHEN text LIKE '%Z' THEN try_strptime(text, '%Y-%m-%dT%H:%M:%SZ')
    WHEN text LIKE '%+03:00' THEN try_strptime(substr(text, 1, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 3 HOUR
    ELSE try_strptime(text, '%Y-%m-%d %H:%M:%S') END AS ts
  FROM t
)
SELECT event_id, text, epoch_us(ts) AS parsed_us, CAST(hour(ts) AS INTEGER) AS txn_hour,
  ts IS NOT NULL AS is_valid FROM p"""

ORACLE["subset_rename"] = with_ctes(TRANSFERS_CTE, LEGACY_RAW_CTE) + """
SELECT User_ID AS user_id, round(Transaction_Amount, 6) AS transaction_amount, "Timestamp" AS "timestamp",
  round(Account_Balance, 6) AS account_balance, Previous_Fraudulent_Activity AS previous_fraudulent_activity,
  Daily_Transaction_Count AS daily_transaction_count, round(Avg_Transaction_Amount_7d, 6) AS avg_transaction_amount_7d,
  Failed_Transaction_Count_7d AS failed_transaction_count_7d, Card_Type AS card_type, Card_Age AS card_age,
  round(Risk_Score, 6) AS risk_score, Is_Weekend AS is_weekend, Fraud_Label AS fraud_label
FROM legacy_raw"""

ORACLE["legacy_features"] = with_ctes(TRANSFERS_CTE, LEGACY_RAW_CTE) + """
SELECT User_ID AS user_id, round(Transaction_Amount, 6) AS amount, round(Account_Balance, 6) AS account_balance,
  Previous_Fraudulent_Activity AS previous_fraudulent_activity,
  CAST(Daily_Transaction_Count AS DOUBLE) AS daily_transaction_count,
  round(Avg_Transaction_Amount_7d, 6) AS avg_transaction_amount_7d,
  CAST(Failed_Transaction_Count_7d AS DOUBLE) AS failed_transaction_count_7d,
  Card_Type AS card_type, CAST(Card_Age AS DOUBLE) AS card_age, round(Risk_Score, 6) AS risk_score,
  Is_Weekend AS is_weekend,
  CAST(hour(CAST("Timestamp" AS TIMESTAMP)) AS INTEGER) AS txn_hour,
  CAST(isodow(CAST("Timestamp" AS TIMESTAMP)) - 1 AS INTEGER) AS txn_day_of_week,
  CAST(month(CAST("Timestamp" AS TIMESTAMP)) AS INTEGER) AS txn_month,
  Fraud_Label AS is_fraud
FROM legacy_raw"""

ORACLE["legacy_layout_adapter"] = with_ctes(TRANSFERS_CTE, LEGACY_RAW_CTE) + f"""
SELECT Transaction_ID,
  round(CASE WHEN r1 > 100 THEN 100.0 ELSE r1 END, 6) AS amount_to_avg_ratio,
  round(CASE WHEN r2 > 1 THEN 1.0 ELSE r2 END, 6) AS balance_drain_ratio,
  round(v24, 6) AS velocity_24h, round(v7, 6) AS velocity_7d,
  round(CASE WHEN v24 / (CASE WHEN v7 = 0 THEN 0.01 ELSE v7 END) > 50 THEN 50.0
             ELSE v24 / (CASE WHEN v7 = 0 THEN 0.01 ELSE v7 END) END, 6) AS velocity_burst,
  Card_Age AS card_age_months, Card_Type AS card_type,
  CAST({u01("Transaction_ID || '|new_receiver'")} > 0.7 AS INTEGER) AS is_new_receiver,
  CAST(Card_Age < 3 AS INTEGER) AS is_new_card,
  CAST(Transaction_Amount % 100 = 0 AS INTEGER) AS is_round_amount,
  CAST(Transaction_Amount > 5000 AS INTEGER) AS is_large_amount,
  CAST(hr < 6 OR hr > 22 AS INTEGER) AS is_off_hours,
  Previous_Fraudulent_Activity AS previous_fraud_flag, Is_Weekend AS is_weekend,
  hr AS txn_hour, dow AS txn_day_of_week, Fraud_Label AS label
FROM (
  SELECT *, Transaction_Amount / CASE WHEN Avg_Transaction_Amount_7d = 0 THEN 1.0 ELSE Avg_Transaction_Amount_7d END AS r1,
    Transaction_Amount / CASE WHEN Account_Balance = 0 THEN 1.0 ELSE Account_Balance END AS r2,
    Daily_Transaction_Count / 24.0 AS v24, Daily_Transaction_Count * 3 / 168.0 AS v7,
    CAST(coalesce(hour(try_cast("Timestamp" AS TIMESTAMP)), 12) AS INTEGER) AS hr,
    CAST(coalesce(isodow(try_cast("Timestamp" AS TIMESTAMP)) - 1, 0) AS INTEGER) AS dow
  FROM legacy_raw)"""

_LEGACY_COLS = ["Transaction_ID", "User_ID", "Transaction_Amount", "Timestamp", "Account_Balance",
                "Previous_Fraudulent_Activity", "Daily_Transaction_Count", "Avg_Transaction_Amount_7d",
                "Failed_Transaction_Count_7d", "Card_Type", "Card_Age", "Risk_Score", "Is_Weekend", "Fraud_Label"]
ORACLE["dataset_profile"] = with_ctes(TRANSFERS_CTE, LEGACY_RAW_CTE) + "\n" + "\nUNION ALL\n".join(
    f'SELECT CAST({i} AS INTEGER) AS position, \'{c}\' AS column_name, '
    f'CAST(count(*) - count("{c}") AS BIGINT) AS null_count, CAST(count(*) AS BIGINT) AS n_rows, '
    f'CAST({len(_LEGACY_COLS)} AS INTEGER) AS n_columns FROM legacy_raw'
    for i, c in enumerate(_LEGACY_COLS))

ORACLE["target_check"] = with_ctes(TRANSFERS_CTE, LEGACY_RAW_CTE) + """
SELECT 'is_fraud' AS target_column, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(sum(CASE WHEN Fraud_Label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
  CAST(sum(CASE WHEN Fraud_Label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
  CAST(sum(CASE WHEN Fraud_Label IN (0, 1) THEN 0 ELSE 1 END) AS BIGINT) AS invalid,
  sum(CASE WHEN Fraud_Label IN (0, 1) THEN 0 ELSE 1 END) = 0 AS is_binary
FROM legacy_raw"""

ORACLE["positive_rate"] = with_ctes(TRANSFERS_CTE) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, round(avg(fraud_label), 6) AS positive_rate FROM transfers"""

ORACLE["class_weight"] = with_ctes(TRANSFERS_CTE) + """
SELECT CAST(sum(fraud_label) AS BIGINT) AS positives, CAST(sum(1 - fraud_label) AS BIGINT) AS negatives,
  round(sum(1 - fraud_label) / sum(fraud_label), 6) AS scale_pos_weight FROM transfers"""

PART_COUNTS_CTE = """
pc AS (
  SELECT 'p_type' AS "column", p_type AS value, CAST(count(*) AS BIGINT) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type
  UNION ALL
  SELECT 'p_brand', p_brand, CAST(count(*) AS BIGINT) FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
)"""

ORACLE["category_counts"] = with_ctes(PART_COUNTS_CTE) + """
SELECT "column", value, count FROM pc"""

ORACLE["topk_categories"] = with_ctes(PART_COUNTS_CTE) + """
SELECT * FROM (SELECT "column", value, count,
  CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC) AS INTEGER) AS rank FROM pc)
WHERE rank <= 20"""

ORACLE["mode_fit"] = with_ctes(PART_COUNTS_CTE) + """
SELECT "column", value AS mode, count FROM (SELECT *,
  row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC) AS rn FROM pc) WHERE rn = 1"""

_NUMERIC = ["amount_to_avg_ratio", "balance_drain_ratio", "velocity_24h", "velocity_7d", "velocity_burst",
            "card_age_months", "is_new_receiver", "is_new_card", "is_round_amount", "is_large_amount",
            "is_off_hours", "previous_fraud_flag", "is_weekend", "txn_hour", "txn_day_of_week"]
_FEAT_ALIAS = {"is_new_receiver": "new_recv_i", "previous_fraud_flag": "prev_flag_i", "is_weekend": "weekend_i"}

NUMERIC_LONG_CTE = """
numlong AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT '{c}' AS \"column\", CAST({_FEAT_ALIAS.get(c, c)} AS DOUBLE) AS value FROM feat" for c in _NUMERIC) + "\n)"

ORACLE["numeric_fit"] = with_ctes(TRANSFERS_CTE, FEATURES_CTE, NUMERIC_LONG_CTE) + """
SELECT "column", round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std FROM (
  SELECT "column", quantile_cont(value, 0.5) AS median,
    avg(coalesce(value, med)) AS mean, stddev_pop(coalesce(value, med)) AS std
  FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY "column") AS med FROM numlong)
  GROUP BY "column")"""

ORACLE["pattern_tags"] = with_ctes(TRANSFERS_CTE, FEATURES_CTE) + """
SELECT event_id, concat_ws(',', t1, t2, t3, t4, t5) AS pattern_tags,
  CAST((t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT + (t3 IS NOT NULL)::INT + (t4 IS NOT NULL)::INT
       + (t5 IS NOT NULL)::INT AS INTEGER) AS n_patterns
FROM (SELECT event_id,
  CASE WHEN balance_drain_ratio >= 0.7 THEN 'balance_drain' END AS t1,
  CASE WHEN amount_to_avg_ratio >= 10 THEN 'amount_spike' END AS t2,
  CASE WHEN transaction_count_24h >= 10 THEN 'velocity_burst' END AS t3,
  CASE WHEN card_age_months < 3 AND transaction_amount >= 1000 THEN 'new_card' END AS t4,
  CASE WHEN balance_drain_ratio >= 0.8 AND transaction_count_24h >= 5 AND card_age_months < 6 THEN 'combined' END AS t5
  FROM feat)"""

ORACLE["flag_threshold"] = with_ctes(TRANSFERS_CTE, SCORES_CTE) + """
SELECT event_id, score, score >= 0.5 AS is_flagged FROM scores"""

ORACLE["risk_policy"] = with_ctes(TRANSFERS_CTE, SCORES_CTE) + """
SELECT event_id, round(score, 4) AS risk_score,
  CASE WHEN score < 0.30 THEN 'LOW' WHEN score < 0.70 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
  CASE WHEN score < 0.30 THEN 'APPROVE' WHEN score < 0.70 THEN 'HOLD' ELSE 'BLOCK' END AS recommended_action
FROM scores"""


# ---- behaviour windows: independent self-join over (t - d, t] with ties by position ----

def _behavior_oracle(source: str, select: str) -> str:
    return f"""
WITH src AS ({source}),
b AS (SELECT *, epoch_us(CAST("timestamp" AS TIMESTAMP)) AS us FROM src),
pairs AS (
  SELECT x.row_id, y.amount AS amt, y.us AS yus, x.us AS xus
  FROM b x JOIN b y ON x.user_id = y.user_id
   AND y.us > x.us - 30 * 86400000000 AND (y.us < x.us OR (y.us = x.us AND y.row_id <= x.row_id))
),
roll AS (
  SELECT row_id, sum(CAST(amt AS DECIMAL(38,10))) AS sum30, count(amt) AS n30, stddev_samp(amt) AS s30,
    count(amt) FILTER (WHERE yus > xus - 7 * 86400000000) AS c7
  FROM pairs GROUP BY row_id
),
us_stats AS (SELECT user_id, avg(amount) AS um, stddev_samp(amount) AS us_sd FROM b GROUP BY user_id),
prev AS (
  SELECT row_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, row_id) AS gap FROM b
)
SELECT {select} FROM b JOIN roll USING (row_id) JOIN us_stats USING (user_id) JOIN prev USING (row_id)"""


ORDERS_SRC = 'SELECT o_orderkey AS row_id, o_custkey AS user_id, o_totalprice AS amount, o_orderdate AS "timestamp" FROM orders'
EVENTS_SRC = 'SELECT event_id AS row_id, user_id, value AS amount, ts AS "timestamp" FROM events'
_Z = "round(coalesce((amount - um) / CASE WHEN us_sd <> 0 THEN us_sd END, 0.0), 6) + 0.0 AS amount_zscore"
# mean rounded half away from zero in exact integer arithmetic
_MEAN = ("CASE WHEN n30 > 0 THEN sign(CAST(sum30 * 10000000000 AS HUGEINT)) * "
         "((2 * abs(CAST(sum30 * 10000000000 AS HUGEINT)) + n30 * 10000) // (2 * n30 * 10000)) / 1000000.0 END")
_M = f"{_MEAN} AS user_mean_30d, round(s30, 6) AS user_std_30d"
_C = "CAST(c7 AS BIGINT) AS txn_count_7d"
_H = "round(coalesce(gap / 3600000000.0, -1.0), 6) AS hours_since_last_tx"

ORACLE["amount_zscore"] = _behavior_oracle(ORDERS_SRC, f"row_id, user_id, {_Z}")
ORACLE["rolling_30d"] = _behavior_oracle(ORDERS_SRC, f"row_id, user_id, {_M}")
ORACLE["rolling_7d_count"] = _behavior_oracle(ORDERS_SRC, f"row_id, user_id, {_C}")
ORACLE["hours_since_last"] = _behavior_oracle(ORDERS_SRC, f"row_id, user_id, {_H}")
ORACLE["behavior_features"] = _behavior_oracle(
    EVENTS_SRC, f"row_id, user_id, round(amount, 6) AS amount, {_Z}, {_M}, {_C}, {_H}")


# ---- message validation oracle (DuckDB JSON functions) ----

from txrisk.schemas import LEGACY_PAYLOAD_FIELDS as _LP, REQUEST_FIELDS as _RF  # noqa: E402

_TRUE = "('1','on','t','true','y','yes')"
_FALSE = "('0','off','f','false','n','no')"
_DUCK_TYPES = {"str": "VARCHAR", "float": "DOUBLE", "int": "BIGINT", "bool": "BOOLEAN"}


def _validation_sql(source_cte: str, fields, strict: bool, accept_snake: bool, digits: int = 6) -> str:
    """Staged CTEs: raw JSON type/text per field -> kind -> coerced value ->
    error code -> errors and typed columns (each stage reads the previous)."""
    specs = [(f[0], f[0], f[1], True, None, False) if len(f) == 2 else f for f in fields]
    raw, kinds, vals, codes, errs, cols, known = [], [], [], [], [], [], []
    for snake, alias, kind, required, default, nonneg in specs:
        known += [alias] + ([snake] if accept_snake and snake != alias else [])
        ta = f"json_type(v, '$.{alias}')"
        if accept_snake and snake != alias:
            raw.append(f"coalesce({ta}, json_type(v, '$.{snake}')) AS t_{snake}")
            raw.append(f"CASE WHEN {ta} IS NOT NULL THEN json_extract_string(v, '$.{alias}') "
                       f"ELSE json_extract_string(v, '$.{snake}') END AS x_{snake}")
        else:
            raw.append(f"{ta} AS t_{snake}")
            raw.append(f"json_extract_string(v, '$.{alias}') AS x_{snake}")
        t = f"t_{snake}"
        kinds.append(f"CASE WHEN {t} IS NULL THEN 'missing' WHEN {t} = 'NULL' THEN 'null' WHEN {t} = 'VARCHAR' "
                     f"THEN 'string' WHEN {t} = 'BOOLEAN' THEN 'bool' WHEN {t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') "
                     f"THEN 'number' ELSE 'other' END AS k_{snake}")
        k, x = f"k_{snake}", f"x_{snake}"
        if kind == "str":
            val = f"CASE WHEN {k} = 'string' THEN {x} END"
        elif kind in ("float", "int"):
            d = (f"(CASE WHEN {k} IN ('number', 'string') THEN TRY_CAST({x} AS DOUBLE) "
                 f"WHEN {k} = 'bool' THEN CASE WHEN {x} = 'true' THEN 1.0 ELSE 0.0 END END)")
            val = d if kind == "float" else (f"CASE WHEN NOT isnan({d}) AND {d} = floor({d}) "
                                             f"THEN CAST({d} AS BIGINT) END")
        else:
            w = f"lower(trim({x}))"
            val = (f"CASE WHEN {k} = 'bool' THEN {x} = 'true' "
                   f"WHEN {k} = 'number' AND TRY_CAST({x} AS DOUBLE) = 1 THEN true "
                   f"WHEN {k} = 'number' AND TRY_CAST({x} AS DOUBLE) = 0 THEN false "
                   f"WHEN {k} = 'string' AND {w} IN {_TRUE} THEN true "
                   f"WHEN {k} = 'string' AND {w} IN {_FALSE} THEN false END")
        if not required:
            dv = f"'{default}'" if isinstance(default, str) else str(default)
            val = f"CASE WHEN {k} = 'missing' THEN {dv} ELSE {val} END"
        vals.append(f"CAST({val} AS {_DUCK_TYPES[kind]}) AS val_{snake}")
        miss = "'missing'" if required else "NULL"
        code = (f"CASE WHEN {k} = 'missing' THEN {miss} WHEN {k} = 'null' THEN 'null' "
                f"WHEN val_{snake} IS NULL THEN 'type' ")
        if nonneg:
            code += f"WHEN isnan(CAST(val_{snake} AS DOUBLE)) OR val_{snake} < 0 THEN 'negative' "
        codes.append(code + f"END AS c_{snake}")
        errs.append(f"CASE WHEN c_{snake} IS NOT NULL THEN '{alias}:' || c_{snake} END")
        typed = f"CASE WHEN is_obj AND c_{snake} IS NULL THEN val_{snake} END"
        cols.append(f"round({typed}, {digits}) AS {snake}" if kind == "float" else f"{typed} AS {snake}")
    base_err = "concat_ws(';', " + ", ".join(errs) + ")"
    if strict:
        known_list = "[" + ", ".join(f"'{x}'" for x in known) + "]"
        extra = (f"NULLIF(array_to_string(list_transform(list_sort(list_filter(json_keys(v), lambda x: NOT list_contains("
                 f"{known_list}, x))), lambda x: x || ':extra_forbidden'), ';'), '')")
        base_err = f"concat_ws(';', NULLIF({base_err}, ''), {extra})"
    return f"""{source_cte}
, parsed AS (
  SELECT event_id, defect, CASE WHEN is_obj THEN v0 ELSE '{{}}' END AS v, is_obj
  FROM (SELECT *, coalesce(json_type(v0) = 'OBJECT', false) AS is_obj FROM (
    SELECT event_id, defect, CASE WHEN json_valid(value) THEN value ELSE 'null' END AS v0 FROM req))
), s_raw AS (SELECT event_id, defect, v, is_obj, {", ".join(raw)} FROM parsed
), s_kind AS (SELECT *, {", ".join(kinds)} FROM s_raw
), s_val AS (SELECT *, {", ".join(vals)} FROM s_kind
), s_code AS (SELECT *, {", ".join(codes)} FROM s_val
), checked AS (
  SELECT event_id, defect, CASE WHEN is_obj THEN {base_err} ELSE 'json:malformed' END AS errors,
    {", ".join(cols)}
  FROM s_code
)
SELECT *, errors = '' AS is_valid FROM checked"""


def _json_obj(pairs):
    return "json_object(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + ")::VARCHAR"


_CAMEL = [("transactionId", "transaction_id"), ("userId", "user_id"), ("transactionAmount", "transaction_amount"),
          ("transactionType", "transaction_type"), ("merchantCategory", "merchant_category"),
          ("cardType", "card_type"), ("cardAgeMonths", "card_age_months"),
          ("accountBalanceBefore", "account_balance_before"), ("avgTransactionAmount7d", "avg_transaction_amount_7d"),
          ("transactionCount24h", "transaction_count_24h"), ("transactionCount7d", "transaction_count_7d"),
          ("previousFraudFlag", "previous_fraud_flag"), ("isNewReceiver", "is_new_receiver"),
          ("isWeekend", "is_weekend"), ("timestamp", "ts_text")]


def _req_obj(overrides=None, drop=(), snake=False, extra=()):
    overrides = overrides or {}
    pairs = []
    for camel, col in _CAMEL:
        if camel in drop:
            continue
        key = (col if col != "ts_text" else "timestamp") if snake else camel
        pairs.append((key, overrides.get(camel, col)))
    return _json_obj(pairs + list(extra))


_REQ_VARIANTS = [
    (50, "truncated", "substr(base, 1, CAST(length(base) // 2 AS INTEGER))"),
    (53, "negative_amount", _req_obj({"transactionAmount": "-(transaction_amount + 1)"})),
    (59, "missing_card_type", _req_obj(drop=("cardType",))),
    (61, "snake_case", _req_obj(snake=True)),
    (67, "extra_key", _req_obj(extra=[("channel", "'web'")])),
    (71, "numeric_strings", _req_obj({"transactionAmount": "CAST(transaction_amount AS VARCHAR)",
                                      "cardAgeMonths": "CAST(card_age_months AS VARCHAR)",
                                      "transactionCount24h": "CAST(transaction_count_24h AS VARCHAR)"})),
    (73, "fractional_int", _req_obj({"cardAgeMonths": "card_age_months + 0.5"})),
    (79, "alias_null", _req_obj({"userId": "NULL::VARCHAR"}, extra=[("user_id", "user_id")])),
]


def _defect_case(variants):
    d = "CASE " + " ".join(f"WHEN event_id % {m} = 0 THEN '{n}'" for m, n, _ in variants) + " ELSE 'none' END"
    v = "CASE " + " ".join(f"WHEN event_id % {m} = 0 THEN {e}" for m, _, e in variants) + " ELSE base END"
    return d, v


_d, _v = _defect_case(_REQ_VARIANTS)
REQUESTS_CTE = f"""
req AS (
  SELECT event_id, {_d} AS defect, {_v} AS value FROM (
    SELECT *, {_req_obj()} AS base FROM (
      SELECT *, strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ') AS ts_text FROM transfers))
)"""

ORACLE["validate_requests"] = _validation_sql(with_ctes(TRANSFERS_CTE, REQUESTS_CTE), _RF, strict=False, accept_snake=True)

_LEGACY_SRC = [("user_id", "User_ID"), ("amount", "Transaction_Amount"), ("timestamp", '"Timestamp"'),
               ("account_balance", "Account_Balance"), ("previous_fraudulent_activity", "Previous_Fraudulent_Activity"),
               ("daily_transaction_count", "Daily_Transaction_Count"),
               ("avg_transaction_amount_7d", "Avg_Transaction_Amount_7d"),
               ("failed_transaction_count_7d", "Failed_Transaction_Count_7d"), ("card_type", "Card_Type"),
               ("card_age", "Card_Age"), ("risk_score", "Risk_Score"), ("is_weekend", "Is_Weekend")]


def _legacy_obj(overrides=None, drop=(), extra=()):
    overrides = overrides or {}
    return _json_obj([(k, overrides.get(k, c)) for k, c in _LEGACY_SRC if k not in drop] + list(extra))


_LEGACY_VARIANTS = [
    (50, "truncated", "substr(base, 1, CAST(length(base) // 2 AS INTEGER))"),
    (59, "missing_card_type", _legacy_obj(drop=("card_type",))),
    (67, "extra_key", _legacy_obj(extra=[("channel", "'web'")])),
    (71, "numeric_strings", _legacy_obj({"amount": "CAST(Transaction_Amount AS VARCHAR)"})),
    (73, "fractional_int", _legacy_obj({"previous_fraudulent_activity": "Previous_Fraudulent_Activity + 0.5"})),
]
_d, _v = _defect_case(_LEGACY_VARIANTS)
LEGACY_PAYLOAD_CTE = f"""
req AS (
  SELECT event_id, {_d} AS defect, {_v} AS value FROM (
    SELECT *, {_legacy_obj()} AS base FROM (
      SELECT *, CAST(substr(Transaction_ID, 5) AS BIGINT) AS event_id FROM legacy_raw))
)"""

ORACLE["strict_payload"] = _validation_sql(with_ctes(TRANSFERS_CTE, LEGACY_RAW_CTE, LEGACY_PAYLOAD_CTE), _LP,
                                           strict=True, accept_snake=False)


# ---- metrics: brute-force sweep over distinct scores ----

CURVE_CTE = """
d AS (SELECT score AS threshold, sum(label) AS pos, count(*) - sum(label) AS neg FROM scores GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM d),
pr AS (SELECT threshold, tp, fp, tp / (tp + fp) AS precision, CASE WHEN P > 0 THEN tp / P ELSE 1.0 END AS recall FROM c),
f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM pr)"""

_MET = with_ctes(TRANSFERS_CTE, SCORES_CTE, CURVE_CTE)
ORACLE["average_precision"] = _MET + """
SELECT round(CASE WHEN max(P) > 0 THEN sum(pos / P * tp / (tp + fp)) END, 6) AS average_precision FROM c"""
ORACLE["roc_auc"] = _MET + """
SELECT round(CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(N)) END, 6)
  AS roc_auc FROM c"""
ORACLE["pr_curve"] = _MET + """
SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr"""
ORACLE["optimal_threshold"] = _MET + """
SELECT round(threshold, 6) AS optimal_threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, threshold ASC LIMIT 1"""
ORACLE["confusion_f1"] = _MET + """
, best AS (SELECT threshold FROM f ORDER BY f1 DESC, threshold ASC LIMIT 1)
SELECT CAST(sum(CASE WHEN score >= threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN score >= threshold AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN score < threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN score < threshold AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  round(2.0 * sum(CASE WHEN score >= threshold AND label = 1 THEN 1 ELSE 0 END)
    / (2 * sum(CASE WHEN score >= threshold AND label = 1 THEN 1 ELSE 0 END)
       + sum(CASE WHEN score >= threshold AND label = 0 THEN 1 ELSE 0 END)
       + sum(CASE WHEN score < threshold AND label = 1 THEN 1 ELSE 0 END)), 6) AS f1,
  round(max(threshold), 6) AS threshold
FROM scores JOIN best ON true"""

ORACLE["stratified_split"] = with_ctes(TRANSFERS_CTE) + f"""
SELECT event_id, label, rn <= CAST(ceil(n * 0.2) AS BIGINT) AS is_test FROM (
  SELECT event_id, fraud_label AS label,
    row_number() OVER (PARTITION BY fraud_label ORDER BY h, event_id) AS rn,
    count(*) OVER (PARTITION BY fraud_label) AS n
  FROM (SELECT event_id, fraud_label,
          CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) AS h FROM transfers))"""

_L5 = ["amount_to_avg_ratio", "balance_drain_ratio", "velocity_24h", "velocity_7d", "velocity_burst",
       "card_age_months", "card_type", "is_new_receiver", "is_new_card", "is_round_amount",
       "is_large_amount", "is_off_hours", "previous_fraud_flag", "is_weekend", "txn_hour", "txn_day_of_week"]
ORACLE["top_contributions"] = "WITH c AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT event_id, {i} AS idx, '{n}' AS feature, "
    f"{u01(chr(39).join(['CAST(event_id AS VARCHAR) || ', '|' + n, '']))} - 0.5 AS value FROM events"
    for i, n in enumerate(_L5)) + """
)
SELECT event_id, CAST(rank AS INTEGER) AS rank, feature, round(value, 4) AS contribution FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(value) DESC, idx ASC) AS rank FROM c)
WHERE rank <= 5"""


# ---- encoders ----

ORACLE["topk_encode"] = with_ctes(PART_COUNTS_CTE) + """
, kept AS (SELECT "column", value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC) AS rn FROM pc) WHERE rn <= 20)
SELECT p_partkey,
  CASE WHEN p_type IN (SELECT value FROM kept WHERE "column" = 'p_type') THEN p_type ELSE 'RARE' END AS p_type,
  CASE WHEN p_brand IN (SELECT value FROM kept WHERE "column" = 'p_brand') THEN p_brand ELSE 'RARE' END AS p_brand
FROM part"""

ORACLE["onehot_counts"] = with_ctes(PART_COUNTS_CTE) + """
, kept AS (SELECT "column", value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC) AS rn FROM pc) WHERE rn <= 20)
, enc AS (
  SELECT 'p_type' AS col, CASE WHEN p_type IN (SELECT value FROM kept WHERE "column" = 'p_type') THEN p_type ELSE 'RARE' END AS v FROM part
  UNION ALL
  SELECT 'p_brand', CASE WHEN p_brand IN (SELECT value FROM kept WHERE "column" = 'p_brand') THEN p_brand ELSE 'RARE' END FROM part)
SELECT 'cat__' || col || '_' || v AS feature, CAST(count(*) AS BIGINT) AS n_ones FROM enc GROUP BY col, v"""

ORACLE["numeric_prepare"] = with_ctes(TRANSFERS_CTE, FEATURES_CTE, NUMERIC_LONG_CTE) + """
, fit AS (
  SELECT "column", avg(coalesce(value, med)) AS mean, stddev_pop(coalesce(value, med)) AS std, max(med) AS med
  FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY "column") AS med FROM numlong) GROUP BY "column"
), p AS (SELECT map_from_entries(list(struct_pack(k := "column", v := struct_pack(mean := mean, std := std, med := med)))) AS m FROM fit)
SELECT event_id, """ + ",\n  ".join(
    f"round((coalesce(CAST({_FEAT_ALIAS.get(c, c)} AS DOUBLE), m['{c}'].med) - m['{c}'].mean) / "
    f"CASE WHEN m['{c}'].std = 0 OR m['{c}'].std IS NULL THEN 1.0 ELSE m['{c}'].std END, 6) + 0.0 AS {c}"
    for c in _NUMERIC) + "\nFROM feat, p"


# ---- constant tree models: paths walked down from the nodes, Shapley values over all subsets of a tree's features ----

from txrisk.plans import fixed_models as _fixed  # noqa: E402


def _model_ctes(trees, weights, categories, columns: dict[str, str], source: str) -> str:
    """CTEs ``reached`` (event_id, margin, bias) and ``phi`` (event_id, feature, value, place) for the rows of ``source``."""
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else repr(v)

    nodes = ",\n".join("(" + ", ".join([lit(t), lit(n), lit(f), f"{lit(thr)}::DOUBLE", f"{lit(cats)}::VARCHAR[]", lit(a), lit(b),
                                        f"{lit(v)}::DOUBLE", lit(c), lit(weights[t])]) + ")"
                       for t, n, f, thr, cats, a, b, v, c in _fixed.node_rows(trees, categories))
    used = sorted({f for _, _, f, *_ in _fixed.node_rows(trees, categories) if f})
    xs = "\n  UNION ALL ".join(
        f"SELECT event_id, '{f}' AS feature, " + (f"NULL::DOUBLE AS num, {columns[f]}::VARCHAR AS cat" if f in categories
                                                  else f"{columns[f]}::DOUBLE AS num, NULL::VARCHAR AS cat") + f" FROM {source}" for f in used)
    places = ", ".join(f"('{f}', {i})" for i, f in enumerate(columns))
    return f"""
nodes(tree, node, feature, thr, cats, l, r, value, cover, weight) AS (VALUES {nodes}),
walk AS (
  SELECT tree, 0 AS node, []::STRUCT(feature VARCHAR, thr DOUBLE, cats VARCHAR[], went_left BOOLEAN, share DOUBLE)[] AS conds FROM nodes WHERE node = 0
  UNION ALL
  SELECT n.tree, c.node, list_append(conds, {{'feature': n.feature, 'thr': n.thr, 'cats': n.cats, 'went_left': c.node = n.l, 'share': c.cover / n.cover}})
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN nodes c ON c.tree = n.tree AND c.node IN (n.l, n.r)
), leaf AS MATERIALIZED (
  SELECT w.tree, w.node AS leaf, 2 * n.weight * n.value AS value, conds FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature IS NULL
), cond AS (SELECT tree, leaf, unnest(conds, recursive := true) FROM leaf
), x AS MATERIALIZED ({xs}
), met AS MATERIALIZED (
  SELECT event_id, tree, leaf, c.feature, product(share) AS share,
         bool_and(went_left = coalesce(CASE WHEN cats IS NULL THEN num <= thr ELSE list_contains(cats, cat) END, false)) AS ok
  FROM cond c JOIN x ON x.feature = c.feature GROUP BY event_id, tree, leaf, c.feature
), player AS (SELECT tree, feature, row_number() OVER (PARTITION BY tree ORDER BY feature) - 1 AS i, count(*) OVER (PARTITION BY tree) AS m
              FROM (SELECT DISTINCT tree, feature FROM cond)
), coalition AS (SELECT tree, unnest(range(1::BIGINT << m)) AS s FROM (SELECT DISTINCT tree, m FROM player)
), worth AS MATERIALIZED (
  SELECT event_id, q.tree AS tree, s, sum(p * value) AS v
  FROM (SELECT event_id, met.tree, leaf, s, product(CASE WHEN (s >> i) & 1 = 1 THEN ok::INT ELSE share END) AS p
        FROM met JOIN player ON player.tree = met.tree AND player.feature = met.feature JOIN coalition ON coalition.tree = met.tree
        GROUP BY event_id, met.tree, leaf, s) q
  JOIN leaf ON leaf.tree = q.tree AND leaf.leaf = q.leaf GROUP BY event_id, q.tree, s
), shapley AS (
  SELECT a.event_id, feature, sum((b.v - a.v) * factorial(bit_count(a.s)::INT) * factorial((m - 1 - bit_count(a.s))::INT) / factorial(m::INT)) AS value
  FROM worth a JOIN player p ON p.tree = a.tree AND (a.s >> i) & 1 = 0
  JOIN worth b ON b.event_id = a.event_id AND b.tree = a.tree AND b.s = a.s + (1::BIGINT << i) GROUP BY a.event_id, feature
), place(feature, pos) AS (VALUES {places}
), phi AS MATERIALIZED (
  SELECT e.event_id, place.feature, pos, coalesce(value, 0.0)::DOUBLE AS value
  FROM (SELECT DISTINCT event_id FROM met) e CROSS JOIN place LEFT JOIN shapley ON shapley.event_id = e.event_id AND shapley.feature = place.feature
), reached AS MATERIALIZED (
  SELECT event_id, sum(v) FILTER (s = last) AS margin, sum(v) FILTER (s = 0) AS bias
  FROM (SELECT *, max(s) OVER (PARTITION BY tree) AS last FROM worth) GROUP BY event_id
), ranked AS MATERIALIZED (
  SELECT event_id, feature, value, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(value), 12) DESC, pos) AS rank FROM phi
), top AS (SELECT * FROM ranked WHERE rank <= 5)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_TRANSFER_COLUMNS = {c: {"is_new_receiver": "new_recv_i", "previous_fraud_flag": "prev_flag_i", "is_weekend": "weekend_i"}.get(c, c) for c in _L5}
_TREES = _recursive(with_ctes(TRANSFERS_CTE, FEATURES_CTE, _model_ctes(
    _fixed.TRANSFER_TREES, _fixed.TRANSFER_WEIGHTS, _fixed.TRANSFER_CATEGORIES, _TRANSFER_COLUMNS, "feat")))
ORACLE["tree_scores"] = _TREES + """
SELECT event_id, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS probability FROM reached"""
ORACLE["tree_contributions"] = _TREES + """
SELECT event_id, round(bias, 6) AS bias, round(margin, 6) AS margin_sum, CAST(rank AS INTEGER) AS rank, feature, round(value, 4) AS contribution
FROM top JOIN reached USING (event_id)"""
ORACLE["tree_importance_table"] = _TREES + """
SELECT feature, round(avg(abs(value)), 6) AS mean_abs, round(avg(value), 6) AS mean FROM phi GROUP BY feature"""

# the message's fields -> online features (denominators of zero or less count as 1, velocity as 0.01)
_ONLINE_CTE = """
online AS (
  SELECT event_id, least(transaction_amount / CASE WHEN avg_transaction_amount_7d > 0 THEN avg_transaction_amount_7d ELSE 1.0 END, 100.0) AS amount_to_avg_ratio,
    least(transaction_amount / CASE WHEN account_balance_before > 0 THEN account_balance_before ELSE 1.0 END, 1.0) AS balance_drain_ratio,
    transaction_count_24h / 24.0 AS velocity_24h, transaction_count_7d / 168.0 AS velocity_7d,
    least((transaction_count_24h / 24.0) / CASE WHEN transaction_count_7d > 0 THEN transaction_count_7d / 168.0 ELSE 0.01 END, 50.0) AS velocity_burst,
    card_age_months, card_type, is_new_receiver::INT AS is_new_receiver, (card_age_months < 3)::INT AS is_new_card,
    (transaction_amount % 100 = 0)::INT AS is_round_amount, (transaction_amount > 5000)::INT AS is_large_amount,
    (hour(t) < 6 OR hour(t) > 22)::INT AS is_off_hours, previous_fraud_flag::INT AS previous_fraud_flag, is_weekend::INT AS is_weekend,
    hour(t) AS txn_hour, isodow(t) - 1 AS txn_day_of_week
  FROM (SELECT *, strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ') AS t FROM val WHERE is_valid))"""
_REQUESTS = _validation_sql(with_ctes(TRANSFERS_CTE, REQUESTS_CTE), _RF, strict=False, accept_snake=True, digits=15)
_EVALUATE = f"WITH RECURSIVE val AS MATERIALIZED ({_REQUESTS}), {_ONLINE_CTE}, " + _model_ctes(
    _fixed.TRANSFER_TREES, _fixed.TRANSFER_WEIGHTS, _fixed.TRANSFER_CATEGORIES, {c: c for c in _L5}, "online") + """
, shown AS (
  SELECT event_id, '{' || string_agg('"' || feature || '":' || CASE
      WHEN c <> 0 AND abs(c) < 0.001 THEN printf('%.1fE-4', c * 10000) ELSE CAST(c AS VARCHAR) END, ',' ORDER BY rank) || '}' AS importance
  FROM (SELECT *, round(value, 4) + 0.0 AS c FROM top) GROUP BY event_id
), decided AS (
  SELECT val.event_id, is_valid, errors, CASE WHEN is_valid THEN transaction_id END AS "transactionId", round(p, 4) AS "riskScore",
    CASE WHEN p < 0.30 THEN 'LOW' WHEN p < 0.70 THEN 'MEDIUM' WHEN p >= 0.70 THEN 'HIGH' END AS "riskLevel",
    CASE WHEN p < 0.30 THEN 'APPROVE' WHEN p < 0.70 THEN 'HOLD' WHEN p >= 0.70 THEN 'BLOCK' END AS "recommendedAction",
    CASE WHEN is_valid THEN '1970-01-01T00:00:00.000000Z' END AS "evaluatedAt", importance AS "featureImportance"
  FROM val LEFT JOIN (SELECT event_id, 1 / (1 + exp(-margin)) AS p FROM reached) r ON r.event_id = val.event_id
  LEFT JOIN shown ON shown.event_id = val.event_id)"""
ORACLE["tree_evaluate"] = _EVALUATE + """
SELECT * FROM decided"""
ORACLE["tree_result_json"] = _EVALUATE + """
SELECT "transactionId" AS key, '{"transactionId":"' || "transactionId" || '","riskScore":' || CASE
    WHEN "riskScore" <> 0 AND "riskScore" < 0.001 THEN printf('%.1fE-4', "riskScore" * 10000) ELSE CAST("riskScore" AS VARCHAR) END
  || ',"riskLevel":"' || "riskLevel" || '","recommendedAction":"' || "recommendedAction" || '","evaluatedAt":"' || "evaluatedAt"
  || '","featureImportance":' || "featureImportance" || '}' AS value
FROM decided WHERE is_valid"""

_LEGACY_COLUMNS = ["user_id", "amount", "account_balance", "previous_fraudulent_activity", "daily_transaction_count",
                   "avg_transaction_amount_7d", "failed_transaction_count_7d", "card_type", "card_age", "risk_score", "is_weekend",
                   "txn_hour", "txn_day_of_week", "txn_month"]
_PAYLOADS = _validation_sql(with_ctes(TRANSFERS_CTE, LEGACY_RAW_CTE, LEGACY_PAYLOAD_CTE), _LP, strict=True, accept_snake=False, digits=15)
ORACLE["legacy_scoring"] = f"""WITH RECURSIVE val AS MATERIALIZED ({_PAYLOADS}), taken AS (
  SELECT *, hour(t) AS txn_hour, isodow(t) - 1 AS txn_day_of_week, month(t) AS txn_month
  FROM (SELECT *, strptime("timestamp", '%Y-%m-%d %H:%M:%S') AS t FROM val WHERE is_valid)), """ + _model_ctes(
    _fixed.LEGACY_TREES, _fixed.LEGACY_WEIGHTS, _fixed.LEGACY_CATEGORIES, {c: c for c in _LEGACY_COLUMNS}, "taken") + """
SELECT val.event_id, defect, is_valid, errors, round(p, 6) AS anomaly_score, p >= 0.5 AS is_flagged, CAST(rank AS INTEGER) AS rank, feature,
  round(value, 6) AS contribution
FROM val LEFT JOIN (SELECT event_id, 1 / (1 + exp(-margin)) AS p FROM reached) r ON r.event_id = val.event_id
LEFT JOIN top ON top.event_id = val.event_id"""

ORACLE["stream_velocity"] = """
SELECT event_id, user_id,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS count_24h,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604799999999 PRECEDING AND 1 PRECEDING) AS count_7d
FROM (SELECT event_id, user_id, epoch_us(ts) AS us, max(epoch_us(ts)) OVER () AS newest FROM events)
QUALIFY us < (newest // 1000) * 1000 - 3600000000"""
