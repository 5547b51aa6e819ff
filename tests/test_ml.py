"""Encoders, imputer/scaler semantics, training, contribution additivity, save/load."""

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from txrisk.ml import encoders as EN
from txrisk.ml import prep as PR
from txrisk.ml import train as TN
from txrisk.ml.explain import explain, global_importances
from txrisk.operators.transfer import transfer_features
from txrisk.plans import fixtures as fx
from txrisk.schemas import TRANSFER_FEATURE_COLUMNS

from sf_paths import SF_SMALL


def test_topk_rare_and_unseen(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",), (None,)], "x string")
    m = EN.TopKCategoryEncoder(inputCols=["x"], topK=2).fit(df)
    new = spark.createDataFrame([("a",), ("c",), ("zzz",), (None,)], "x string")
    assert [r[0] for r in m.transform(new).collect()] == ["a", "RARE", "RARE", "RARE"]


def test_median_even_and_scaler_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (10.0, 5.0)], "a double, b double")
    model = Pipeline(stages=[EN.MedianImputer(inputCols=["a", "b"]), EN.PopulationScaler(inputCols=["a", "b"])]).fit(df)
    med = model.stages[0].getStats()
    assert med == {"a": 2.0, "b": 5.0}
    out = model.transform(df).collect()
    a = np.array([1.0, 2.0, 2.0, 10.0])
    assert np.allclose([r["a"] for r in out], (a - a.mean()) / a.std())
    assert [r["b"] for r in out] == [0.0] * 4


def test_onehot_unknown_is_all_zero(spark):
    df = spark.createDataFrame([("x",), ("y",)], "c string")
    model = PR.build_preprocessor(df, ["c"], top_k=5).fit(df)
    new = spark.createDataFrame([("x",), ("q",)], "c string")
    vecs = [r["features"].toArray().tolist() for r in model.transform(new).collect()]
    assert vecs[0] == [1.0, 0.0] and vecs[1] == [0.0, 0.0]
    assert PR.feature_names(model, [], ["c"]) == ["cat__c_x", "cat__c_y"]


def test_train_explain_additivity_and_save_load(spark, tmp_dir):
    data = transfer_features(fx.transfers(spark, SF_SMALL), keep=("event_id", "fraud_label")) \
        .withColumnRenamed("fraud_label", "label")
    model = TN.fit(data, TRANSFER_FEATURE_COLUMNS, "fast")
    num, cat = PR.split_columns(data, TRANSFER_FEATURE_COLUMNS)
    names = PR.feature_names(model, num, cat)
    scored = TN.score(model, data)
    ex = explain(model, scored, names, ["event_id", "risk_score"]).collect()
    assert len(ex) == data.count()
    for r in ex[:200]:
        p = r["risk_score"]
        margin = math.log(p / (1 - p))
        assert abs(r["bias"] + 0 - r["bias"]) == 0
        assert abs(r["margin_sum"] - margin) < 1e-6
        vals = [abs(t["value"]) for t in r["top"]]
        assert vals == sorted(vals, reverse=True) and len(vals) == 5
    assert global_importances(model, names)
    TN.save(model, f"{tmp_dir}/model")
    again = TN.load(f"{tmp_dir}/model")
    a = TN.score(again, data).select("event_id", "risk_score").orderBy("event_id").collect()
    b = scored.select("event_id", "risk_score").orderBy("event_id").collect()
    assert a == b


def test_class_weight_requires_positive(spark):
    import pytest
    df = spark.createDataFrame([(0,), (0,)], "label int")
    with pytest.raises(Exception, match="no row has the label 1"):
        TN.with_weights(df).collect()


def _expected(nodes, at, x, known):
    """The tree's output when only the features ``known`` of ``x`` are known, straight from its nodes."""
    n = nodes[at]
    if n["feature"] is None:
        return n["value"]
    kids = nodes[n["left"]], nodes[n["right"]]
    if n["feature"] in known:
        v = x[n["feature"]]
        if n["left_categories"] is not None:
            left = not math.isnan(v) and int(v) in n["left_categories"]
        else:
            left = v <= n["threshold"]
        return _expected(nodes, n["left"] if left else n["right"], x, known)
    return sum(k["cover"] / n["cover"] * _expected(nodes, i, x, known) for k, i in zip(kids, (n["left"], n["right"])))


def _brute_shapley(model, x):
    """(contributions by feature, bias, margin) by enumerating all subsets of each tree's features."""
    from itertools import combinations
    phi, bias, margin = {}, 0.0, 0.0
    for t, weight in enumerate(model.weights):
        nodes = {n["node"]: n for n in model.nodes if n["tree"] == t}
        used = sorted({n["feature"] for n in nodes.values() if n["feature"] is not None})
        f = lambda known: model.scale * weight * _expected(nodes, 0, x, set(known))  # noqa: B023, E731
        bias, margin, m = bias + f(()), margin + f(used), len(used)
        for i in used:
            others = [u for u in used if u != i]
            for s in range(m):
                w = math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m)
                phi[i] = phi.get(i, 0.0) + sum(w * (f((*c, i)) - f(c)) for c in combinations(others, s))
    return phi, bias, margin


def test_contributions_equal_brute_force_shapley(spark):
    from pyspark.ml.functions import vector_to_array
    from txrisk.ml import tree_tables as TT
    data = transfer_features(fx.transfers(spark, SF_SMALL), keep=("event_id", "fraud_label")) \
        .withColumnRenamed("fraud_label", "label")
    model = TN.fit(data, TRANSFER_FEATURE_COLUMNS, TN.Profile(trees=3, step=0.3, depth=3, subsample=1.0,
                                                             feature_fraction=1.0))
    trees = model.stages[-1].model()
    X = np.array([r[0] for r in TN.score(model, data).select(vector_to_array("features")).limit(5).collect()])
    phi, bias = TT.contributions(X, TT.games(trees), X.shape[1])
    for r in range(len(X)):
        ref, ref_bias, ref_margin = _brute_shapley(trees, X[r])
        assert abs(bias[r] - ref_bias) < 1e-9 and abs(bias[r] + phi[r].sum() - ref_margin) < 1e-9
        assert all(abs(phi[r, i] - ref.get(i, 0.0)) < 1e-9 for i in range(X.shape[1]))


def _random_model(seed, depth, n_categories):
    """Random trees over two numbers, one category of ``n_categories`` values and a number with repeated splits."""
    import random

    from txrisk.ml.tree_tables import TreeModel
    rnd = random.Random(seed)
    nodes = []

    def grow(tree, at, level, cover, free):
        if level == depth or cover < 4 or rnd.random() < 0.1:
            nodes.append({"tree": tree, "node": at, "feature": None, "threshold": None, "left_categories": None, "n_categories": None,
                          "left": None, "right": None, "value": rnd.uniform(-1, 1), "cover": cover})
            return free
        f = rnd.randrange(4)
        cats = rnd.sample(range(n_categories), n_categories // 3) if f == 2 else None
        a = float(rnd.randrange(1, int(cover)))
        nodes.append({"tree": tree, "node": at, "feature": f, "threshold": None if cats else rnd.uniform(-1, 1), "left_categories": cats,
                      "n_categories": n_categories if cats else None, "left": free, "right": free + 1, "value": 0.0, "cover": cover})
        return grow(tree, nodes[-1]["right"], level + 1, cover - a, grow(tree, nodes[-1]["left"], level + 1, a, free + 2))

    for t in range(4):
        grow(t, 0, 0, 1000.0, 1)
    return TreeModel(["a", "b", "cat", "d"], nodes, [rnd.uniform(0.1, 1) for _ in range(4)])


def test_plan_and_arrays_agree_with_brute_force_on_100_categories(spark):
    import random

    from txrisk.ml import tree_tables as TT
    rnd = random.Random(3)
    for seed in (1, 2):
        model = TT.TreeModel.from_json(_random_model(seed, 4, 100).to_json())
        x = [[rnd.uniform(-1.5, 1.5), rnd.uniform(-1.5, 1.5), float(rnd.randrange(-1, 104)), rnd.uniform(-1.5, 1.5)] for _ in range(25)]
        x += [[float("nan")] * 4, [0.0, float("nan"), 99.0, float("inf")]]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, v array<double>")
        df = df.unionByName(spark.createDataFrame([(99, [None] * 4)], "id int, v array<double>"))
        out = {r.id: r for r in TT.with_contributions(df, model, F.col("v")).collect()}
        phi, bias = TT.contributions(np.array(x), TT.games(model), 4)
        for i, v in enumerate(x):
            ref, ref_bias, ref_margin = _brute_shapley(model, v)
            got = [c.value for c in out[i].contribs]
            assert all(abs(got[f] - ref.get(f, 0.0)) < 1e-9 and abs(phi[i, f] - got[f]) < 1e-9 for f in range(4))
            assert abs(out[i].margin - ref_margin) < 1e-9 and abs(out[i].bias - ref_bias) < 1e-9 and abs(bias[i] - ref_bias) < 1e-9
            assert abs(out[i].probability - 1 / (1 + math.exp(-ref_margin))) < 1e-9
        assert abs(out[99].margin - out[len(x) - 2].margin) < 1e-12         # null counts as NaN: right at every split


def test_tables_hold_the_model(spark, tmp_dir):
    from pyspark.ml import PipelineModel
    from txrisk.ml import tree_tables as TT
    from txrisk.plans.fixed_models import transfer_model
    model = transfer_model()
    paths = model.path_table(spark)
    leaves = sum(n["feature"] is None for n in model.nodes)
    assert model.node_table(spark).count() == len(model.nodes) and paths.select("tree", "leaf").distinct().count() == leaves
    shares = paths.groupBy("tree", "leaf").agg(F.product("share").alias("p")).groupBy("tree").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-12 for r in shares)
    stage = TT.TreeArrays(tables=model.to_json())
    PipelineModel([stage]).write().overwrite().save(f"{tmp_dir}/trees")
    assert PipelineModel.load(f"{tmp_dir}/trees").stages[0].model() == model


def test_explaining_writes_nothing_and_both_ways_agree(spark):
    import os

    from txrisk.session import checkpoint_dir
    data = transfer_features(fx.transfers(spark, SF_SMALL), keep=("event_id", "fraud_label")).withColumnRenamed("fraud_label", "label")
    model = TN.fit(data, TRANSFER_FEATURE_COLUMNS, "fast")
    names = PR.feature_names(model, *PR.split_columns(data, TRANSFER_FEATURE_COLUMNS))
    scored = TN.score(model, data)
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = sorted(os.listdir(folder))
    in_plan, in_batches = ({r.event_id: r for r in explain(model, scored, names, ["event_id"], in_plan=w).collect()} for w in (True, False))
    assert sorted(os.listdir(folder)) == before
    assert "MapInPandas" not in explain(model, scored, names, ["event_id"])._jdf.queryExecution().executedPlan().toString()
    for k, a in in_plan.items():
        b = in_batches[k]
        assert abs(a.margin_sum - b.margin_sum) < 1e-9
        assert all(abs(x.value - y.value) < 1.1e-4 for x, y in zip(a.top, b.top, strict=True))


def test_topk_large_dictionary_uses_join(spark):
    df = spark.createDataFrame([(f"v{i % 40}",) for i in range(400)] + [(None,)], "x string")
    m = EN.TopKCategoryEncoder(inputCols=["x"], topK=35).fit(df)
    out = m.transform(df)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    vals = {r[0] for r in out.collect()}
    assert "RARE" in vals and len(vals) == 36


def test_legacy_training_job(spark, tmp_dir):
    import os
    from txrisk.operators.legacy import legacy_training_table, subset_rename
    from txrisk.plans.jobs import train_legacy_job
    from txrisk.sources.io import write_parquet
    path = os.path.join(tmp_dir, "l3")
    write_parquet(legacy_training_table(subset_rename(fx.legacy_raw(spark, SF_SMALL))), path)
    metrics = train_legacy_job(spark, path, os.path.join(tmp_dir, "legacy_model"), profile="fast")
    assert 0.0 <= metrics["auc_roc"] <= 1.0


def test_exact_medians_by_narrowing(spark):
    """Whatever the bracket sizes: duplicates, ties across the middle, infinities, signed zeros, empty columns."""
    import random

    from txrisk.operators.quantiles import exact_median, exact_medians, exact_ranks
    rnd = random.Random(5)
    inf = float("inf")
    for n in (1, 2, 3, 2001, 2002):
        half = n // 2
        rows = [(rnd.choice([1.0, 2.0, 2.0, 3.0, None]), rnd.uniform(-1e3, 1e3), float(i % 7), 5.0 if i < half else 6.0 + 1e-12 * (i - half),
                 rnd.choice([-inf, inf, 0.0, -0.0]), rnd.expovariate(1) * 10.0 ** rnd.randrange(-300, 300), None) for i in range(n)]
        cols = list("abcdefg")
        df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
        whole = exact_medians(df, cols)
        narrowed = exact_medians(df, cols, limit=3, points=8, accuracy=50)
        for k, c in enumerate(cols):
            vals = sorted(x[k] for x in rows if x[k] is not None)
            m = len(vals)
            expect = (vals[(m - 1) // 2] + vals[m // 2]) / 2 if m else None
            same = lambda x: x == expect or (x is not None and x != x and expect != expect)  # noqa: B023, E731
            assert same(whole[c]) and same(narrowed[c]), (n, c)
    assert {r["column"]: r["median"] for r in exact_median(df, cols[:4]).collect()} == {c: whole[c] for c in cols[:4]}
    b = sorted(x[1] for x in rows)
    ranks = [0, 1, 17, 1000, n - 2, n - 1]
    assert exact_ranks(df, ["b"], lambda n: ranks, limit=5, points=8)["b"] == [b[r] for r in ranks]


def test_numeric_fit_has_no_python_and_no_copies(spark):
    from txrisk.operators.aggregates import numeric_fit
    df = spark.range(100).selectExpr("cast(id as double) a", "cast(id % 3 as double) b")
    plan = numeric_fit(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Generate") == 1      # of the one aggregated row




def test_written_out_tables_equal_the_lambdas(spark, monkeypatch):
    from txrisk.ml import tree_tables as TT
    model = TT.TreeModel.from_json(_random_model(5, 3, 6).to_json())
    x = [[0.3, -0.2, 4.0, 1.0], [-1.0, 0.9, -1.0, None], [float("nan"), 0.0, 99.0, float("inf")], [None] * 4]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, v array<double>")
    written = TT.with_contributions(df, model, F.col("v"))
    assert "lambda" not in written._jdf.queryExecution().optimizedPlan().toString()      # lambdas are interpreted per element
    monkeypatch.setattr(TT, "WRITTEN_PLAYERS", 0)
    assert written.orderBy("id").collect()[:2] == TT.with_contributions(df, model, F.col("v")).orderBy("id").collect()[:2]
    assert written.columns == TT.with_contributions(df, model, F.col("v")).columns
    as_text = lambda d: sorted(map(str, d.collect()))
    assert as_text(written) == as_text(TT.with_contributions(df, model, F.col("v")))


def test_training_table_is_not_collected(spark):
    """Tables that grow with the events are joined by shuffle: a broadcast passes whole through the driver."""
    plan = fx.transfers(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3


def _event_tables(spark, folder, n=240):
    """Own events and customers, with both labels."""
    import datetime
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(minutes=37 * i), i % 12, ["view", "error", "click"][i % 3], float(1 + i * 7 % 50),
               f'{{"k": {i % 11}}}') for i in range(n)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{folder}/events.parquet")
    customers = [(i, f"c{i}", 0, 40.0 * i - 20, ["BUILDING", "FURNITURE"][i % 2]) for i in range(12)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string") \
        .write.parquet(f"{folder}/customer.parquet")
    return folder


def test_explained_scores_are_ranked_without_an_inferred_filter(spark, tmp_dir):
    """Exploding a bare column makes Spark filter on its size, below the explanation: the whole of it once more."""
    from txrisk.plans.queries import QUERIES
    out = QUERIES["explain_scores"](spark, _event_tables(spark, tmp_dir))
    assert "size(" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert sorted((r["event_id"], r["rank"]) for r in rows) == [(i, k) for i in range(240) for k in range(1, 6)]
    assert out.columns == ["event_id", "risk_score", "bias", "margin_sum", "rank", "feature", "contribution"]


def test_training_metrics_are_those_of_the_transfer_profile(spark, tmp_dir, monkeypatch):
    """The query measures the reference's model: 400 trees of depth 6, not the small profile of the other queries."""
    from txrisk.plans import queries as Q
    asked, fit = [], TN.fit

    def small(train, features, profile):
        asked.append(TN.PROFILES[profile])
        return fit(train, features, TN.Profile(trees=2, step=0.3, depth=2, subsample=1.0, feature_fraction=1.0))

    monkeypatch.setattr(TN, "fit", small)
    monkeypatch.setattr(Q, "_MODELS", {})
    row = Q.QUERIES["training_metrics"](spark, _event_tables(spark, tmp_dir)).first()
    assert [(p.trees, p.depth, p.step, p.subsample, p.feature_fraction, p.min_instances) for p in asked] == [(400, 6, 0.03, 0.85, 0.85, 3)]
    assert 48 <= row.tp + row.fp + row.fn + row.tn <= 49 and 0 <= row.auc_roc <= 1       # a fifth of each class, rounded up
