import random

import pytest
from pyspark.sql import functions as F

from txrisk.llm import exact_dedup, mixing, queries, rule_cascade, url_filter

SF = "/root/testdata/sf0.001"


def _same_as_sql(spark, name):
    import duckdb
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["op3_url_filter", "op7_exact_dedup", "op10_rule_cascade"])
def test_query_equals_sql(spark, name):
    _same_as_sql(spark, name)


def test_dedup_odd_rows(odd_docs):
    got = exact_dedup.content_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].kept and not by[2][0].kept and by[2][0].keep_id == 1 and by[2][0].group_size == 3
    assert by[None][0].keep_id == 1 and not by[None][0].kept
    assert by[3][0].keep_id == 3 and by[4][0].keep_id == 3          # null counts as empty
    assert by[5][0].keep_id == 5                                    # blank becomes one space, which is not empty
    assert sorted(r.kept for r in by[7]) == [False, True]
    assert by[9][0].kept and by[10][0].kept                         # differ only at the end of long texts
    assert by[6][0].kept
    left = exact_dedup.drop_copies(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 5, 6, 7, 8, 9, 10]


def test_dedup_hot_text_is_cut_by_splitters(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 30))
                                    .otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("text"))
    cuts = exact_dedup.choose_splitters(docs.select(F.left("text", F.lit(64)).alias("p"), F.col("doc_id").alias("i")), 16, 3000)
    assert sum(i != exact_dedup.I64_MIN for _, i in cuts) >= 3
    got = exact_dedup.content_groups(docs)
    want = docs.groupBy("text").agg(F.min("doc_id").alias("k"), F.count("*").alias("n"))
    bad = got.join(docs, "doc_id").join(want, "text").filter("keep_id <> k or group_size <> n or kept <> (doc_id = k)")
    assert got.count() == 3000 and bad.count() == 0


def test_empty_tables(spark, no_docs):
    assert exact_dedup.content_groups(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0
    assert rule_cascade.judge(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert mixing.taken_rows(no_docs).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(pages, url_filter.rules_table(spark, queries.URL_RULES)).count() == 0


def _brute_measures(text):
    import re
    from collections import Counter
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover))


def test_cascade_odd_rows(odd_docs):
    got = rule_cascade.judge(odd_docs.withColumn("n_words", F.lit("clash")))
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _brute_measures(r.text)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)


def test_cascade_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = rule_cascade.default_rules()
    measured = rule_cascade.measures(docs)
    a = rule_cascade.cascade(measured, rules, measured)
    b = rule_cascade.cascade(measured, rules[::-1], measured.limit(0))
    keep = lambda d: {r.doc_id for r in d.filter("rejected_by is null").collect()}
    assert keep(a) == keep(b)


def test_url_cases(spark):
    urls = [None, "", "no-scheme/x", "http://a.example.net/en/1", "http://a.example.net/de/1", "http://EXAMPLE.com/de/x#y",
            "http://badexample.com/de/x", "http://org/fr/", "http://x.org/frx", "http://net", "http://a://net/x", "http://net/?q"]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_table(spark, queries.URL_RULES)).collect()}
    assert got == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("example.net/en/", "allow"), 4: ("net/", "block"),
                   5: ("example.com/de/", "block"), 6: (None, "allow"), 7: ("org/fr/", "allow"), 8: (None, "allow"), 9: (None, "allow"),
                   10: (None, "allow"), 11: ("net/", "block")}


def test_url_shuffle_join_gives_the_same(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    table = url_filter.rules_table(spark, queries.URL_RULES)
    a = url_filter.judge_urls(pages, table).select("page_id", "rule", "verdict")
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    b = url_filter.judge_urls(pages, table).select("page_id", "rule", "verdict")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_targets_water_filling():
    assert mixing.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 1000]) == [30.0, 980.0]
    assert mixing.targets([0, 0]) == [0.0, 0.0] and mixing.targets([]) == []
    t = mixing.targets([5, 7, 1000, 3, 0, 80])
    assert abs(sum(t) - 1095) < 1e-6 and all(x <= 3 * s + 1e-9 for x, s in zip(t, [5, 7, 1000, 3, 0, 80]))


def test_split_tree_is_exact():
    rng = random.Random(3)
    quotas = [100, 7, 0, 33, 1]
    rows = mixing.split_tree(quotas, 9, rng)
    assert [sum(c) for c in zip(*rows)] == quotas and len(rows) == 9
    assert max(map(sum, rows)) - min(map(sum, rows)) <= 2
    means = [sum(mixing.hypergeometric_split([30, 10], 20, rng)[0] for _ in range(2000)) / 2000]
    assert abs(means[0] - 15) < 0.2


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") < 120, "hot")
                                                                   .when(F.col("doc_id") < 180, F.col("source")))
    a, b = mixing.mix(docs), mixing.mix(docs.repartition(3))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    for r in a.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"),
                                     F.max("source_size").alias("said"), F.count("*").alias("n")).collect():
        assert r.size == r.said and r.target <= 3 * r.size + 1e-6
        if r.n > 20:
            assert abs(r.taken - r.target) < 0.02 * r.target
    assert a.filter("taken > 3 * size").count() == 0
    assert mixing.taken_rows(docs).count() == a.selectExpr("sum(size(draws))").first()[0]


def test_taken_rows_follow_the_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500)
    docs = spark.createDataFrame([(i, f"word {i} " * 20, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    draws = [(d.shard, d.place, r.doc_id) for r in mixing.mix(docs).collect() for d in r.draws]
    assert len({d[0] for d in draws}) > 2
    got = mixing.taken_rows(docs)
    assert got.columns == docs.columns
    assert [r.doc_id for r in got.collect()] == [d[2] for d in sorted(draws)]


def test_mix_odd_rows(odd_docs):
    got = mixing.mix(odd_docs)
    assert got.count() == odd_docs.count() and got.filter("size is null or taken is null or target is null").count() == 0
