"""Rows out = rows in, CSV by column name, failing messages isolated, both training layouts, trees that split."""

import math
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.ml import prep as PR
from txrisk.ml import train as TN
from txrisk.ml.explain import gbt_stage
from txrisk.operators.split import stratified_split
from txrisk.operators.transfer import transfer_features
from txrisk.operators.validation import validate_requests
from txrisk.plans import fixtures as fx
from txrisk.plans.jobs import subset_job, train_transfer_job
from txrisk.schemas import L1_RAW, SUBSET_RENAME, TRANSFER_FEATURE_COLUMNS
from txrisk.sources import kafka_reader_options, bus_config
from txrisk.sources.io import read_csv, write_csv
from txrisk.streaming.job import committed_rejected, committed_results, run_bounded, start

from sf_paths import SF_SMALL


def test_split_keeps_rows_without_id(spark):
    df = spark.range(1000).select(F.when(F.col("id") >= 100, F.col("id")).alias("key"), (F.col("id") < 100).cast("int").alias("label"),
                                  F.col("id").alias("v"))
    rows = stratified_split(df, "key", "label", 0.2, 1).collect()
    assert sorted(r.v for r in rows) == list(range(1000))
    for label, n in ((0, 900), (1, 100)):
        assert sum(r.is_test for r in rows if r.label == label) == math.ceil(0.2 * n)


def test_csv_is_read_by_name(spark, tmp_dir):
    raw = fx.legacy_raw(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "csv")
    shuffled = raw.select(*[c for c in reversed(raw.columns)], F.lit("x").alias("Extra"))
    write_csv(shuffled, path)
    back = read_csv(spark, path, L1_RAW)
    assert back.columns == L1_RAW.fieldNames()
    assert back.exceptAll(raw.select(*back.columns)).count() == 0
    subset_job(spark, path, os.path.join(tmp_dir, "subset"))
    subset = spark.read.option("header", True).csv(os.path.join(tmp_dir, "subset"))
    assert subset.columns == list(SUBSET_RENAME.values()) and subset.count() == raw.count()
    with pytest.raises(KeyError, match="Absent"):
        read_csv(spark, path, T.StructType([T.StructField("Absent", T.StringType())]))


def test_bad_csv_cells_are_told(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad")
    write_csv(spark.createDataFrame([("1", "2.5"), ("x", "3"), (None, "y")], "b string, a string"), path)
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.IntegerType())])
    got = sorted((r.why, r.a, r.b) for r in read_csv(spark, path, schema, reasons="why").collect())
    assert got == [("", 2.5, 1), ("a:type", None, None), ("b:type", 3.0, None)]
    with pytest.raises(Exception, match="cannot read"):
        read_csv(spark, path, schema).collect()


def test_validation_reads_numbers_and_words_exactly(spark):
    base = {"transactionId": "t", "userId": "u", "transactionAmount": 1, "cardType": "c", "cardAgeMonths": 1, "accountBalanceBefore": 1,
            "avgTransactionAmount7d": 1, "transactionCount24h": 1, "transactionCount7d": 1, "previousFraudFlag": True,
            "isNewReceiver": False, "isWeekend": False, "timestamp": "2024-01-01T00:00:00Z"}
    import json
    cases = [("cardAgeMonths", "9007199254740993", None, 9007199254740993), ("cardAgeMonths", '"9007199254740993"', None, 9007199254740993),
             ("cardAgeMonths", '"1e3"', "type", None), ("cardAgeMonths", '"7.0"', None, 7), ("cardAgeMonths", "3.5", "type", None),
             ("transactionAmount", '"1.5d"', "type", None), ("transactionAmount", '"1e3"', None, 1000.0),
             ("isWeekend", '" true "', "type", None), ("isWeekend", '"True"', None, True), ("cardAgeMonths", "99999999999999999999", "type", None)]
    messages = []
    for k, (field, text, _, _) in enumerate(cases):
        body = json.dumps({n: v for n, v in base.items() if n != field})
        messages.append((k, body[:-1] + f', "{field}": {text}}}'))
    messages.append((len(cases), json.dumps(base)[:-1] + ', "cardType": "last"}'))
    rows = {r.k: r for r in validate_requests(spark.createDataFrame(messages, "k long, value string")).collect()}
    snake = {"cardAgeMonths": "card_age_months", "transactionAmount": "transaction_amount", "isWeekend": "is_weekend"}
    for k, (field, _, code, value) in enumerate(cases):
        assert rows[k].errors == (f"{field}:{code}" if code else ""), cases[k]
        assert rows[k][snake[field]] == value
    assert rows[len(cases)].errors == "" and rows[len(cases)].card_type == "last"


@pytest.fixture(scope="module")
def small_model(spark):
    data = transfer_features(fx.transfers(spark, SF_SMALL), keep=("event_id", "fraud_label")).withColumnRenamed("fraud_label", "label")
    model = TN.fit(data, TRANSFER_FEATURE_COLUMNS, "fast")
    return model, PR.feature_names(model, *PR.split_columns(data, TRANSFER_FEATURE_COLUMNS))


def test_stream_sets_failing_messages_aside_in_any_zone(spark, tmp_dir, small_model):
    model, names = small_model
    messages = fx.requests_json(spark, SF_SMALL).select("event_id", "value").limit(40)
    good = validate_requests(messages).filter("is_valid").select("event_id", "value")
    count = good.count()
    bad = good.limit(2).withColumn("value", F.regexp_replace("value", r'"timestamp": ?"[^"]*"', '"timestamp":"not-a-time"'))
    src = os.path.join(tmp_dir, "in")
    good.unionByName(bad).write.parquet(src)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = spark.readStream.schema("event_id long, value string").parquet(src)
        out = os.path.join(tmp_dir, "out")
        run_bounded(stream, model, names, out, checkpoint=os.path.join(tmp_dir, "ckpt"))
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert committed_results(spark, out).count() == count
    assert [r.errors for r in committed_rejected(spark, out).collect()] == ["timestamp:invalid"] * 2


def test_stream_needs_its_own_checkpoint(spark, small_model):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="checkpoint"):
        start(stream, *small_model, "unused")


def test_lost_offsets_stop_the_stream_by_default():
    cfg = bus_config({})
    assert kafka_reader_options(cfg)["failOnDataLoss"] == "true"
    assert kafka_reader_options(cfg, fail_on_data_loss=False)["failOnDataLoss"] == "false"


def test_transfer_profile_learns(spark):
    from dataclasses import replace
    data = transfer_features(fx.transfers(spark, SF_SMALL), keep=("event_id", "fraud_label")).withColumnRenamed("fraud_label", "label")
    profile = replace(TN.PROFILES["transfer"], trees=6)
    model, metrics, _ = TN.train_and_evaluate(data, TRANSFER_FEATURE_COLUMNS, "event_id", profile)
    assert sum(t.numNodes > 1 for t in gbt_stage(model).trees) >= 5
    rate = data.agg(F.avg("label")).first()[0]
    assert metrics.first().auc_pr > 2 * rate or metrics.first().auc_pr > 0.8


def test_training_job_takes_the_new_layout(spark, tmp_dir):
    table = transfer_features(fx.transfers(spark, SF_SMALL), keep=("transaction_id", "transaction_amount", "fraud_label"))
    got = train_transfer_job(spark, table, os.path.join(tmp_dir, "a"), profile="fast")
    assert got["auc_pr"] > 0
    got = train_transfer_job(spark, table.drop("transaction_id"), os.path.join(tmp_dir, "b"), profile="fast")
    assert got["auc_pr"] > 0
