"""Offline jobs end to end, required-column errors, and plan shapes."""

import os

import pytest

from txrisk.ml import prep as PR
from txrisk.ml import train as TN
from txrisk.ml.scoring import evaluate
from txrisk.operators.transfer import transfer_features
from txrisk.operators.validation import split_valid, validate_requests
from txrisk.plans import fixtures as fx
from txrisk.plans.jobs import build_train_set_job, subset_job, summarize_job, train_transfer_job
from txrisk.schemas import TRANSFER_FEATURE_COLUMNS, TRANSFER_RAW_COLUMNS
from txrisk.sources.io import write_csv, write_parquet

from sf_paths import SF_SMALL


def test_csv_to_parquet_to_model(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    write_csv(fx.legacy_raw(spark, SF_SMALL), raw)
    prof, head = summarize_job(spark, raw)
    assert prof.count() == 14 and prof.filter("null_count > 0").count() == 0 and head.count() == 5
    subset_job(spark, raw, os.path.join(tmp_dir, "subset"))
    build_train_set_job(spark, os.path.join(tmp_dir, "subset"), os.path.join(tmp_dir, "train"))
    train = spark.read.parquet(os.path.join(tmp_dir, "train"))
    assert train.columns[-1] == "is_fraud" and train.count() == fx.legacy_raw(spark, SF_SMALL).count()
    metrics = train_transfer_job(spark, spark.read.option("header", True).schema(
        fx.legacy_raw(spark, SF_SMALL).schema).csv(raw), os.path.join(tmp_dir, "model"), profile="fast")
    assert set(metrics) >= {"auc_pr", "auc_roc", "optimal_threshold", "f1_score"}
    assert os.path.exists(os.path.join(tmp_dir, "model", "metadata"))


def test_missing_columns_listed_sorted(spark):
    df = spark.createDataFrame([(1,)], "transaction_id int")
    with pytest.raises(KeyError, match="account_balance_before, avg_transaction_amount_7d"):
        transfer_features(df)


def test_transfer_features_plan_is_one_stage(spark, tmp_dir):
    path = os.path.join(tmp_dir, "l4")
    write_parquet(fx.transfers(spark, SF_SMALL).select(*TRANSFER_RAW_COLUMNS), path)
    plan = transfer_features(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "*(1) Project" in plan  # one codegen stage: scan -> project


def test_importance_fallback(spark):
    data = transfer_features(fx.transfers(spark, SF_SMALL), keep=("event_id", "fraud_label")) \
        .withColumnRenamed("fraud_label", "label")
    model = TN.fit(data, TRANSFER_FEATURE_COLUMNS, "fast")
    num, cat = PR.split_columns(data, TRANSFER_FEATURE_COLUMNS)
    names = PR.feature_names(model, num, cat)
    valid, _ = split_valid(validate_requests(fx.requests_json(spark, SF_SMALL)))
    out = evaluate(model, valid, names, with_explanation="importances").limit(3).collect()
    assert all(0 < len(r["featureImportance"]) <= 5 for r in out)
    assert all(v > 0 for r in out for v in r["featureImportance"].values())
