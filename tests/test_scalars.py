"""Hand-written edge rows for the scalar features and the policy."""

import math

import pytest
from pyspark.sql import functions as F

from txrisk.functions import scalars as S


def _one(spark, expr, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


@pytest.mark.parametrize("mode,expected", [
    ("null_or_zero", [10.0, 10.0, -10.0, 5.0]),
    ("zero_only", [10.0, None, -10.0, 5.0]),
    ("nonpositive", [10.0, None, 10.0, 5.0]),
])
def test_zero_modes(spark, mode, expected):
    rows = [(10.0, 0.0), (10.0, None), (10.0, -1.0), (10.0, 2.0)]
    got = _one(spark, S.capped_ratio(F.col("a"), F.col("b"), 100.0, 1.0, mode), rows, "a double, b double")
    assert got == expected


def test_cap_keeps_null_and_nan_is_null(spark):
    got = _one(spark, S.cap(S.nan_to_null(F.col("x")), 1.0), [(None,), (float("nan"),), (5.0,), (0.5,)], "x double")
    assert got == [None, None, 1.0, 0.5]


def test_flags(spark):
    df = spark.createDataFrame([(5000.0, 5, 2), (5000.01, 6, 3), (None, 22, None), (300.0, 23, 1)],
                               "amt double, hour int, age int")
    got = df.select(S.is_large_amount(F.col("amt")), S.is_off_hours(F.col("hour")), S.is_new_card(F.col("age")),
                    S.is_round_amount(F.col("amt"))).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1), (1, 0, 0, 0), (0, 0, 0, 0), (0, 1, 1, 1)]


def test_velocity_burst_zero(spark):
    df = spark.createDataFrame([(24, 0), (2, 168), (100, 1)], "c24 int, c7 int")
    v24, v7 = S.velocity_24h(F.col("c24")), S.velocity_7d(F.col("c7"))
    got = [r[0] for r in df.select(S.velocity_burst(v24, v7)).collect()]
    assert got[0] == 50.0 and math.isclose(got[1], (2 / 24) / 1.0) and got[2] == 50.0


def test_policy_on_unrounded_score(spark):
    rows = [(0.29996,), (0.30,), (0.69996,), (0.70,)]
    df = spark.createDataFrame(rows, "s double")
    got = df.select(S.rounded_score(F.col("s")), S.risk_level(F.col("s")), S.recommended_action(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(0.3, "LOW", "APPROVE"), (0.3, "MEDIUM", "HOLD"),
                                       (0.7, "MEDIUM", "HOLD"), (0.7, "HIGH", "BLOCK")]


def test_timestamps(spark):
    rows = [("2024-01-15T14:30:00Z",), ("2024-01-15T14:30:00+03:00",), ("2024-01-15 14:30:00",), ("bad",)]
    df = spark.createDataFrame(rows, "t string")
    ts = S.parse_timestamp(F.col("t"))
    got = [(r[0], r[1]) for r in df.select(S.txn_hour(ts), F.minute(ts)).collect()]
    assert got == [(14, 30), (11, 30), (14, 30), (None, None)]


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-07 10:00:00",)], "t string")
    got = [r[0] for r in df.select(S.txn_day_of_week(S.parse_timestamp(F.col("t")))).collect()]
    assert got == [0, 6]


def test_fail_mode_raises(spark):
    from txrisk.operators.transfer import time_features
    df = spark.createDataFrame([("bad",)], "timestamp string")
    with pytest.raises(Exception, match="a time cannot be read"):
        time_features(df).collect()


from hypothesis import given, settings, strategies as st  # noqa: E402

_num = st.one_of(st.none(), st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), st.just(0.0))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(_num, _num, _num), min_size=1, max_size=40),
       st.sampled_from(["null_or_zero", "zero_only", "nonpositive"]))
def test_ratios_within_caps(spark, rows, mode):
    df = spark.createDataFrame(rows, "amt double, avg double, bal double")
    out = df.select(S.capped_ratio(F.col("amt"), F.col("avg"), 100.0, 1.0, mode).alias("r1"),
                    S.capped_ratio(F.col("amt"), F.col("bal"), 1.0, 1.0, mode).alias("r2")).collect()
    for (amt, avg, bal), r in zip(rows, out):
        assert r["r1"] is None or r["r1"] <= 100.0
        assert r["r2"] is None or r["r2"] <= 1.0
        if amt is None:
            assert r["r1"] is None and r["r2"] is None


def test_timestamp_quarantine_split(spark):
    from txrisk.operators.transfer import split_on_timestamp
    df = spark.createDataFrame([(1, "2024-01-15T14:30:00Z"), (2, "bad"), (3, None)], "id int, timestamp string")
    valid, rejected = split_on_timestamp(df)
    assert [r["id"] for r in valid.collect()] == [1]
    assert sorted((r["id"], r["reason"]) for r in rejected.collect()) == [(2, "timestamp:invalid"), (3, "timestamp:invalid")]
