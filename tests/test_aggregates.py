"""Profile, target checks and category statistics on hand-made tables."""

import pytest

from txrisk.operators import aggregates as A


def test_profile_counts_nulls_per_column(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, None, "b"), (3, 2.0, None)], "x int, y double, z string")
    rows = {r["column_name"]: r for r in A.dataset_profile(df).collect()}
    assert {c: r["null_count"] for c, r in rows.items()} == {"x": 1, "y": 2, "z": 1}
    assert all(r["n_rows"] == 3 and r["n_columns"] == 3 for r in rows.values())
    assert [r["x"] for r in A.head_rows(df, ["z"], 2).collect()] == [3, 1]


def test_target_resolution_and_binary_check(spark):
    df = spark.createDataFrame([(True, 5), (False, 5)], "target boolean, fraud_label int")
    r = A.target_check(df).first()
    assert r["target_column"] == "fraud_label" and r["is_binary"] is False and r["invalid"] == 2
    r = A.target_check(df.drop("fraud_label")).first()
    assert r["target_column"] == "target" and r["positives"] == 1 and r["is_binary"]
    with pytest.raises(ValueError, match="no target column"):
        A.target_check(df.drop("fraud_label").withColumnRenamed("target", "other"))
    with pytest.raises(Exception, match="takes 0 and 1 only"):
        A.require_binary(spark.createDataFrame([(2,)], "y int"), "y").collect()


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    r = A.mode_fit(df, ["c"]).first()
    assert r["mode"] == "a" and r["count"] == 2


def test_topk_of_as_many_values_as_rows_counts_candidates_only(spark, monkeypatch):
    """A few frequent values in a column of otherwise unique ones: the exact count sees a small part of the rows."""
    from collections import Counter

    from txrisk.operators import aggregates as A
    values = [f"u{i}" for i in range(20_000)] + ["x"] * 300 + ["y"] * 300 + ["z"] * 299 + [None] * 50
    df = spark.createDataFrame([(v, v if i % 2 else "same") for i, v in enumerate(values)], "a string, b string").repartition(4)
    seen, count = [], A._count_within

    def counting(named, chosen, k):
        wanted = set(chosen)
        seen.append(sum((r["column"], r["_b"]) in wanted for r in named.collect()))
        return count(named, chosen, k)

    monkeypatch.setattr(A, "_count_within", counting)
    got = {(r.column, r.rank): (r.value, r["count"]) for r in A.topk_categories(df, ["a", "b"], 3).collect()}
    assert [got["a", r] for r in (1, 2, 3)] == [("x", 300), ("y", 300), ("z", 299)]
    assert got["b", 1] == ("same", (len(values) + 1) // 2) and got["b", 2][1] <= 150
    assert len(seen) == 1 and seen[0] < 0.6 * 2 * len(values)
    monkeypatch.undo()
    # collisions in few buckets, ties at the last place, fewer values than k: as a full count says
    for k in (1, 3, 7):
        rows = [(f"v{(i * i) % 41}", f"t{i % 5}") for i in range(600)]
        small = spark.createDataFrame(rows, "a string, b string")
        for buckets in (4, 64):
            top = {(r.column, r.rank): (r.value, r["count"]) for r in A.topk_categories(small, ["a", "b"], k, buckets).collect()}
            for at, c in enumerate("ab"):
                want = sorted(Counter(r[at] for r in rows).items(), key=lambda x: (-x[1], x[0]))[:k]
                assert [top[c, i + 1] for i in range(len(want))] == want
    assert A.topk_categories(df.limit(0), ["a"], 3).count() == 0
