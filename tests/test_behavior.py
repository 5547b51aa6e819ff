"""Behaviour windows against a pandas implementation written here, plus plan shape."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from txrisk.operators.behavior import behavior_features

from sf_paths import SF_SMALL


def pandas_reference(pdf: pd.DataFrame) -> pd.DataFrame:
    w = pdf.copy()
    w["_pos"] = range(len(w))
    w["timestamp"] = pd.to_datetime(w["timestamp"], utc=True)
    w = w.sort_values(["user_id", "timestamp", "_pos"], kind="mergesort")
    g = w.groupby("user_id", group_keys=False)
    mean, std = g["amount"].transform("mean"), g["amount"].transform("std").replace(0.0, np.nan)
    w["amount_zscore"] = ((w["amount"] - mean) / std).fillna(0.0)
    r30 = g.rolling("30D", on="timestamp")["amount"]
    w["user_mean_30d"] = r30.mean().reset_index(level=0, drop=True).to_numpy()
    w["user_std_30d"] = r30.std().reset_index(level=0, drop=True).to_numpy()
    w["txn_count_7d"] = g.rolling("7D", on="timestamp")["amount"].count().reset_index(level=0, drop=True).to_numpy()
    w["hours_since_last_tx"] = (g["timestamp"].diff().dt.total_seconds() / 3600.0).fillna(-1.0)
    return w.sort_values("_pos")


def _compare(spark_rows, ref):
    got = spark_rows.set_index("row_id").sort_index()
    exp = ref.set_index("row_id").sort_index()
    for c in ["amount_zscore", "user_mean_30d", "user_std_30d", "txn_count_7d", "hours_since_last_tx"]:
        a, b = got[c].astype(float).to_numpy(), exp[c].astype(float).to_numpy()
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_ties_nulls_single_rows(spark):
    rows = [
        (1, 1, 10.0, "2024-01-01 00:00:00"), (2, 1, 20.0, "2024-01-01 00:00:00"), (3, 1, None, "2024-01-01 00:00:00"),
        (4, 1, 40.0, "2024-01-20 00:00:00"), (5, 1, 50.0, "2024-02-25 00:00:00"), (6, 2, 7.0, "2024-01-05 12:00:00"),
        (7, 3, 5.0, "2024-01-01 00:00:00"), (8, 3, 5.0, "2024-01-02 00:00:00"), (9, 3, 5.0, "2024-01-03 00:00:00"),
        (10, 4, None, "2024-03-01 00:00:00"),
    ]
    pdf = pd.DataFrame(rows, columns=["row_id", "user_id", "amount", "timestamp"])
    df = spark.createDataFrame(rows, "row_id long, user_id long, amount double, timestamp string")
    out = behavior_features(df, tiebreak="row_id").toPandas()
    _compare(out, pandas_reference(pdf))
    single = out.set_index("row_id").loc[6]
    assert single.amount_zscore == 0 and np.isnan(single.user_std_30d) and single.txn_count_7d == 1
    assert single.hours_since_last_tx == -1
    const = out.set_index("row_id").loc[9]
    assert const.amount_zscore == 0 and const.user_std_30d == 0


def test_orders_against_pandas(spark):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("timestamp"))
    pdf = orders.toPandas().sort_values("row_id").reset_index(drop=True)
    out = behavior_features(orders, tiebreak="row_id", slice_hours=12).toPandas()
    _compare(out, pandas_reference(pdf))


def test_one_row_shuffle(spark):
    """Rows cross the network once (on (user, slice)); the rest are summaries."""
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("timestamp"))
    plan = behavior_features(df, tiebreak="row_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(user_id#") >= 1
    assert "Generate explode" in plan  # slice copies
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_hot_user_across_buckets_and_boundaries(spark):
    """One user holds most rows; instants straddle bucket edges and 1970."""
    import random
    rnd = random.Random(3)
    day = 86400
    base = -40 * day  # before 1970
    rows = []
    rid = 0
    for i in range(400):
        user = 1 if i % 5 else 2 + i % 3  # user 1 holds 80 %
        t = base + rnd.randint(0, 200) * day // 2
        if i % 17 == 0:
            t = (t // (14 * day)) * 14 * day  # exactly on a bucket edge
        rows.append((rid, user, round(rnd.uniform(1, 100), 2) if i % 9 else None, pd.Timestamp(t, unit="s")))
        rid += 1
    pdf = pd.DataFrame(rows, columns=["row_id", "user_id", "amount", "timestamp"])
    df = spark.createDataFrame(pdf.assign(timestamp=pdf.timestamp.dt.strftime("%Y-%m-%d %H:%M:%S")))
    out = behavior_features(df, tiebreak="row_id", slice_hours=168 / 7).toPandas()
    _compare(out, pandas_reference(pdf))


def test_narrow_slices(spark):
    """Slices of an hour under 30-day windows: same results."""
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("timestamp"))
    pdf = orders.toPandas().sort_values("row_id").reset_index(drop=True)
    out = behavior_features(orders, tiebreak="row_id", slice_hours=1).toPandas()
    _compare(out, pandas_reference(pdf))


def test_null_user_is_refused(spark):
    import pytest
    df = spark.createDataFrame([(1, None, 1.0, "2024-01-01 00:00:00")], "row_id long, user_id long, amount double, timestamp string")
    with pytest.raises(Exception, match="user id contains NULL"):
        behavior_features(df, tiebreak="row_id").collect()


def test_user_with_a_third_of_the_rows_inside_a_week(spark):
    """No task gets a large share of a hot user, and the result is right with many equal instants."""
    import random

    from txrisk.operators import timeframes as tf
    rnd = random.Random(8)
    rows = [(i, 1, rnd.choice([None, 1e9 + rnd.random(), 1e9]), rnd.randrange(7 * 86400 // 600) * 600) for i in range(1000)]
    rows += [(1000 + i, 2 + i % 97, rnd.uniform(0, 1e-9), rnd.randrange(90 * 86400)) for i in range(2000)]
    pdf = pd.DataFrame(rows, columns=["row_id", "user_id", "amount", "s"])
    pdf["timestamp"] = pd.to_datetime(pdf.s + 1_600_000_000, unit="s").dt.strftime("%Y-%m-%d %H:%M:%S")
    df = spark.createDataFrame(pdf.drop(columns="s"))
    copies = tf.slice_copies(df.withColumn("_us", F.unix_micros(F.col("timestamp").cast("timestamp"))), "_us", tf.DAY_US // 24,
                             [30 * tf.DAY_US, 7 * tf.DAY_US], ["user_id"])
    largest = copies.groupBy("user_id", tf.SLICE).count().agg(F.max("count")).first()[0]
    assert largest < 0.02 * copies.count()
    out = behavior_features(df, tiebreak="row_id", slice_hours=1).toPandas()
    exact = pdf.groupby("user_id").amount.count()
    assert (out.user_mean_30d[out.user_id > 1] > 0).all() and len(exact)          # tiny amounts do not vanish
    ref = pandas_reference(pdf)
    got, exp = out.set_index("row_id").sort_index(), ref.set_index("row_id").sort_index()
    assert (got.txn_count_7d == exp.txn_count_7d).all()
    hot, brute = got[got.user_id == 1], []
    stamps, amounts = pd.to_datetime(hot.timestamp).to_numpy(), hot.amount.to_numpy()
    for i, (at, ident) in enumerate(zip(stamps, hot.index, strict=True)):
        seen = (stamps > at - np.timedelta64(30, "D")) & ((stamps < at) | ((stamps == at) & (hot.index <= ident)))
        x = amounts[seen]
        x = x[~np.isnan(x)]
        brute.append((x.mean() if len(x) else np.nan, x.std(ddof=1) if len(x) > 1 else np.nan))
    assert np.allclose(hot.user_mean_30d.to_numpy(), [b[0] for b in brute], rtol=1e-14, equal_nan=True)
    assert np.allclose(hot.user_std_30d.to_numpy(), [b[1] for b in brute], atol=1e-6, equal_nan=True)      # of amounts near 1e9
