"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
over the whole provided tables. Computed columns carry the same aliases
as the DuckDB oracle in ``oracle_sql``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions import scalars as S
from txrisk.ml import encoders as EN
from txrisk.ml import prep as PR
from txrisk.ml import scoring as SC
from txrisk.ml import train as TN
from txrisk.ml.explain import explain as _explain
from txrisk.ml.tree_tables import with_contributions
from txrisk.operators import aggregates as A
from txrisk.operators import legacy as lg
from txrisk.operators import metrics as Mx
from txrisk.operators import topk as TK
from txrisk.operators import transfer as tr
from txrisk.operators import validation as V
from txrisk.operators.behavior import behavior_features as _behavior
from txrisk.operators.patterns import pattern_tags as _pattern_tags
from txrisk.operators.split import stratified_split as _split
from txrisk.operators.timeframes import half_up_mean
from txrisk.operators.validation import validate_requests as _validate
from txrisk.plans import fixed_models as fixed
from txrisk.plans import fixtures as fx
from txrisk.plans.util import round_doubles
from txrisk.session import checkpoint_dir, stored
from txrisk.streaming.velocity import split_late, velocity_counts
from txrisk.schemas import LEGACY_PAYLOAD_FIELDS, REQUEST_FIELDS, TRANSFER_FEATURE_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _features(spark, sf_dir, keep=("event_id",)):
    return tr.transfer_features(fx.transfers(spark, sf_dir), keep=keep)


@query
def transfer_features(spark, sf_dir):
    return round_doubles(_features(spark, sf_dir))


@query
def class_means(spark, sf_dir):
    df = _features(spark, sf_dir, keep=("event_id", "fraud_label", "transaction_amount", "transaction_count_24h"))
    cols = ["transaction_amount", "balance_drain_ratio", "amount_to_avg_ratio", "velocity_burst",
            "transaction_count_24h", "card_age_months"]
    return round_doubles(A.class_means(df, "fraud_label", cols))


# ---- scalar features (F2-F17) ----


NUMERIC_FEATURES = [c for c in TRANSFER_FEATURE_COLUMNS if c != "card_type"]


@query
def amount_ratios(spark, sf_dir):
    t = fx.transfers(spark, sf_dir)
    amt, bal = F.col("transaction_amount"), F.col("c_acctbal")
    out = tr.amount_ratios(t).select(
        "event_id", "amount_to_avg_ratio", "balance_drain_ratio",
        S.capped_ratio(amt, bal, 1.0, 1.0, "zero_only").alias("drain_zero_only"),
        S.capped_ratio(amt, bal, 1.0, 1.0, "nonpositive").alias("drain_nonpositive"))
    return round_doubles(out)


@query
def velocity_features(spark, sf_dir):
    t = tr.velocity_features(fx.transfers(spark, sf_dir))
    return round_doubles(t.select("event_id", "velocity_24h", "velocity_7d", "velocity_burst"))


@query
def risk_indicators(spark, sf_dir):
    t = tr.risk_indicators(tr.time_features(fx.transfers(spark, sf_dir)))
    return t.select("event_id", "is_new_card", "is_round_amount", "is_large_amount", "is_off_hours")


@query
def time_features(spark, sf_dir):
    t = fx.transfers(spark, sf_dir)
    ts = F.col("timestamp")
    return t.select("event_id", S.txn_hour(ts).alias("txn_hour"), S.txn_day_of_week(ts).alias("txn_day_of_week"),
                    S.txn_month(ts).alias("txn_month"))


@query
def parse_timestamps(spark, sf_dir):
    t = fx.timestamp_texts(spark, sf_dir)
    ts = S.parse_timestamp(F.col("text"))
    return t.select("event_id", "text", S.to_micros(ts).alias("parsed_us"),
                    S.txn_hour(ts).alias("txn_hour"), ts.isNotNull().alias("is_valid"))


# ---- legacy layouts (S2/P1, M14, P11) ----

@query
def subset_rename(spark, sf_dir):
    return round_doubles(lg.subset_rename(fx.legacy_raw(spark, sf_dir)))


@query
def legacy_features(spark, sf_dir):
    return round_doubles(lg.legacy_training_table(lg.subset_rename(fx.legacy_raw(spark, sf_dir))))


@query
def legacy_layout_adapter(spark, sf_dir):
    out = lg.load_transfer_dataset(fx.legacy_raw(spark, sf_dir), keep=("Transaction_ID",))
    return round_doubles(out)


# ---- profile, target, aggregates (S9, P5, P6, A1-A7, O3) ----

@query
def dataset_profile(spark, sf_dir):
    return A.dataset_profile(fx.legacy_raw(spark, sf_dir))


@query
def target_check(spark, sf_dir):
    return A.target_check(lg.legacy_training_table(lg.subset_rename(fx.legacy_raw(spark, sf_dir))))


@query
def positive_rate(spark, sf_dir):
    return round_doubles(A.positive_rate(fx.transfers(spark, sf_dir), "fraud_label"))


@query
def class_weight(spark, sf_dir):
    return round_doubles(A.class_weight(fx.transfers(spark, sf_dir), "fraud_label"))


PART_CATEGORIES = ["p_type", "p_brand"]


@query
def category_counts(spark, sf_dir):
    return A.category_counts(fx.table(spark, sf_dir, "part"), PART_CATEGORIES)


@query
def topk_categories(spark, sf_dir):
    return A.topk_categories(fx.table(spark, sf_dir, "part"), PART_CATEGORIES, 20)


@query
def mode_fit(spark, sf_dir):
    return A.mode_fit(fx.table(spark, sf_dir, "part"), PART_CATEGORIES)


@query
def numeric_fit(spark, sf_dir):
    """Median imputer fitted (exact, distributed), then mean/std after imputation."""
    feats = _features(spark, sf_dir)
    med = PR.fit_cached(EN.MedianImputer(inputCols=NUMERIC_FEATURES), feats).getStats()  # one value per column
    med_df = spark.createDataFrame([(c, med[c]) for c in NUMERIC_FEATURES], "column string, median double")
    return round_doubles(A.numeric_fit(feats, NUMERIC_FEATURES, F.broadcast(med_df)))


@query
def pattern_tags(spark, sf_dir):
    df = _features(spark, sf_dir, keep=("event_id", "transaction_amount", "transaction_count_24h"))
    return _pattern_tags(df).select("event_id", "pattern_tags", "n_patterns")


# ---- policy on scores (P12, F19-F21) ----

@query
def flag_threshold(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    return s.select("event_id", "score", S.is_flagged(F.col("score")).alias("is_flagged"))


@query
def risk_policy(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    sc = F.col("score")
    return s.select("event_id", S.rounded_score(sc).alias("risk_score"), S.risk_level(sc).alias("risk_level"),
                    S.recommended_action(sc).alias("recommended_action"))


# ---- behaviour windows (W1-W5) ----


def _exact_mean(df):
    """user_mean_30d rounded half-up at 6 digits from the exact window sum."""
    return df.withColumn("user_mean_30d", half_up_mean(F.col("user_sum_30d"), F.col("user_n_30d"))) \
             .drop("user_sum_30d", "user_n_30d")


def _orders_behavior(spark, sf_dir):
    return _exact_mean(_behavior(fx.behavior_orders(spark, sf_dir), tiebreak="row_id", keep_sums=True))


def _zero_fix(df):
    # -0.0 and 0.0 are the same number; print one form
    return df.select(*[(F.col(c) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def amount_zscore(spark, sf_dir):
    return _zero_fix(round_doubles(_orders_behavior(spark, sf_dir).select("row_id", "user_id", "amount_zscore")))


@query
def rolling_30d(spark, sf_dir):
    return round_doubles(_orders_behavior(spark, sf_dir).select("row_id", "user_id", "user_mean_30d", "user_std_30d"))


@query
def rolling_7d_count(spark, sf_dir):
    return _orders_behavior(spark, sf_dir).select("row_id", "user_id", "txn_count_7d")


@query
def hours_since_last(spark, sf_dir):
    return round_doubles(_orders_behavior(spark, sf_dir).select("row_id", "user_id", "hours_since_last_tx"))


@query
def behavior_features(spark, sf_dir):
    out = _exact_mean(_behavior(fx.behavior_events(spark, sf_dir), tiebreak="row_id", keep_sums=True)).drop("timestamp")
    return _zero_fix(round_doubles(out))


# ---- message validation (P8-P10, F24, F25) ----


@query
def validate_requests(spark, sf_dir):
    out = V.validate_requests(fx.requests_json(spark, sf_dir))
    return round_doubles(out.select("event_id", "defect", "is_valid", "errors", *[f[0] for f in REQUEST_FIELDS]))


@query
def strict_payload(spark, sf_dir):
    out = V.strict_payload(fx.legacy_payload_json(spark, sf_dir))
    return round_doubles(out.select("event_id", "defect", "is_valid", "errors", *[f[0] for f in LEGACY_PAYLOAD_FIELDS]))


# ---- ranking metrics, split, top contributions (A11-A15, M7, O4, F23) ----


@query
def average_precision(spark, sf_dir):
    return round_doubles(Mx.average_precision(fx.scores(spark, sf_dir)))


@query
def roc_auc(spark, sf_dir):
    return round_doubles(Mx.roc_auc(fx.scores(spark, sf_dir)))


@query
def pr_curve(spark, sf_dir):
    return round_doubles(Mx.pr_curve(fx.scores(spark, sf_dir)))


@query
def optimal_threshold(spark, sf_dir):
    return round_doubles(Mx.optimal_threshold(fx.scores(spark, sf_dir)))


@query
def confusion_f1(spark, sf_dir):
    return round_doubles(Mx.confusion_f1(fx.scores(spark, sf_dir)))


@query
def stratified_split(spark, sf_dir):
    t = fx.transfers(spark, sf_dir).select("event_id", F.col("fraud_label").alias("label"))
    return _split(t, "event_id", "label", 0.2, 42)


@query
def top_contributions(spark, sf_dir):
    c = fx.contributions(spark, sf_dir).withColumn("top", TK.top_abs(F.col("contribs"), 5))
    return TK.explode_ranked(c, "top", ["event_id"])


# ---- ML preparation and model queries (M1-M13) ----


@query
def topk_encode(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select("p_partkey", *PART_CATEGORIES)
    model = EN.TopKCategoryEncoder(inputCols=PART_CATEGORIES, topK=20).fit(part)
    return model.transform(part)


@query
def onehot_counts(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select("p_partkey", *PART_CATEGORIES)
    pipe = PR.build_preprocessor(part, PART_CATEGORIES, top_k=20)
    model = PR.fit_cached(pipe, part)
    names = PR.feature_names(model, [], PART_CATEGORIES)
    vec = model.transform(part).select(F.posexplode(vector_to_array("features")).alias("slot", "x"))
    sums = vec.groupBy("slot").agg(F.sum("x").cast("long").alias("n_ones"))
    name_df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "slot int, feature string")
    return sums.join(F.broadcast(name_df), "slot").select("feature", "n_ones")


@query
def numeric_prepare(spark, sf_dir):
    feats = _features(spark, sf_dir)
    pipe = Pipeline(stages=[EN.MedianImputer(inputCols=NUMERIC_FEATURES), EN.PopulationScaler(inputCols=NUMERIC_FEATURES)])
    out = PR.fit_cached(pipe, feats).transform(feats).select("event_id", *NUMERIC_FEATURES)
    return _zero_fix(round_doubles(out))


_MODELS: dict = {}


def _training_table(spark, sf_dir):
    return _features(spark, sf_dir, keep=("event_id", "fraud_label")).withColumnRenamed("fraud_label", "label")


def _trained(spark, sf_dir, profile="fast", table=None):
    """Model fitted on the 80 % split of the transfer table (cached per process). ``table``: the transfer table, where the
    caller has stored it for its own use."""
    key = (spark.sparkContext.applicationId, sf_dir, profile)
    if key not in _MODELS:
        from txrisk.operators.split import stratified_split
        if table is None:
            table = stored(_training_table(spark, sf_dir), "training")
        data = stratified_split(table, "event_id", "label", 0.2, 42)
        train = data.filter(~F.col("is_test")).drop("is_test")
        model = TN.fit(train, TRANSFER_FEATURE_COLUMNS, profile)
        num, cat = PR.split_columns(train, TRANSFER_FEATURE_COLUMNS)
        _MODELS[key] = (model, PR.feature_names(model, num, cat))
    return _MODELS[key]


@query
def train_and_score(spark, sf_dir):
    model, _ = _trained(spark, sf_dir)
    return TN.score(model, _training_table(spark, sf_dir)).select("event_id", "label", "risk_score")


@query
def training_metrics(spark, sf_dir):
    """AUC-PR, AUC-ROC, best-F1 threshold and F1 on the 20 % hold-out, of the reference's transfer model in full size."""
    from txrisk.operators.split import stratified_split
    table = stored(_training_table(spark, sf_dir), "training")
    model, _ = _trained(spark, sf_dir, "transfer", table)
    data = stratified_split(table, "event_id", "label", 0.2, 42)
    metrics, _ = TN.holdout_metrics(model, data.filter(F.col("is_test")).drop("is_test"), "event_id")
    return metrics


@query
def explain_scores(spark, sf_dir):
    table = stored(_training_table(spark, sf_dir), "training")
    model, names = _trained(spark, sf_dir, table=table)
    scored = TN.score(model, table)
    ex = _explain(model, scored, names, ["event_id", "risk_score"])
    # exploding the bare column would make Spark infer the filter size(top) > 0 and push it below, explanation and all
    return TK.explode_ranked(ex, "top", ["event_id", "risk_score", "bias", "margin_sum"])


EVALUATED_AT = "1970-01-01T00:00:00.000000Z"


def _judged(spark, sf_dir, model, names):
    return SC.judge_requests(model, fx.requests_json(spark, sf_dir), names, keep=("event_id",), evaluated_at=F.lit(EVALUATED_AT))


@query
def evaluate_batch(spark, sf_dir):
    """Every message: its decision, or the reasons why it has none."""
    return _judged(spark, sf_dir, *_trained(spark, sf_dir))


@query
def result_json(spark, sf_dir):
    return SC.result_json(SC.valid_results(_judged(spark, sf_dir, *_trained(spark, sf_dir))))


# ---- the same on constant models, which SQL can follow (M9, M10, M12, O4, F23, P12) ----


def _ranked(df, top, keys):
    """A row per (keys, rank) of an explanation; rows without one have a single row with NULLs."""
    return TK.explode_ranked(df, top, keys, outer=True)


@query
def tree_scores(spark, sf_dir):
    model = fixed.transfer_model()
    feats = _features(spark, sf_dir)
    return round_doubles(with_contributions(feats, model, model.values(feats)).select("event_id", "margin", "probability"))


@query
def tree_contributions(spark, sf_dir):
    model = fixed.transfer_model()
    feats = _features(spark, sf_dir)
    ex = _explain(model, feats.withColumn("features", model.values(feats)), model.names, ["event_id"])
    return round_doubles(_ranked(ex, "top", ["event_id", "bias", "margin_sum"]))


@query
def tree_importance_table(spark, sf_dir):
    """Mean absolute contribution of every feature over all events."""
    model = fixed.transfer_model()
    feats = _features(spark, sf_dir)
    out = with_contributions(feats, model, model.values(feats)).select(F.inline("contribs"))
    return round_doubles(out.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean")))


@query
def tree_evaluate(spark, sf_dir):
    """Every message of the stream's layout with its decision, or the reasons why it has none."""
    model = fixed.transfer_model()
    out = _judged(spark, sf_dir, model, model.names)
    return out.withColumn("featureImportance", F.to_json("featureImportance"))


@query
def tree_result_json(spark, sf_dir):
    model = fixed.transfer_model()
    return SC.result_json(SC.valid_results(_judged(spark, sf_dir, model, model.names)))


@query
def legacy_scoring(spark, sf_dir):
    """Strict legacy payloads through their own model: score, flag and ranked contributions, or the reasons against."""
    model = fixed.legacy_model()
    out = SC.judge_payloads(model, fx.legacy_payload_json(spark, sf_dir), model.names, keep=("event_id", "defect"))
    top = F.transform(F.map_entries("explain"), lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("value")))
    ranked = _ranked(out.withColumn("top", top), "top", ["event_id", "defect", "is_valid", "errors", "anomaly_score", "is_flagged"])
    return round_doubles(ranked)


# ---- velocity counts by the streaming job (T1, T7; the counts behind F8-F10) ----


@query
def stream_velocity(spark, sf_dir):
    """The events as a bounded stream: settled rows, that is all but those of the last hour."""
    table = fx.table(spark, sf_dir, "events")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/velocity-{uuid.uuid4().hex}"
    # a pattern: a stream takes no single file, and the table may be a file or a folder
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    counts = velocity_counts(stream, "user_id", "event_id", "ts")
    (counts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True).start().awaitTermination())
    settled, _ = split_late(spark.read.schema(counts.schema).parquet(f"{folder}/out"))
    return settled.select(F.col("id").cast("long").alias("event_id"), F.col("user").cast("long").alias("user_id"), "count_24h", "count_7d")
