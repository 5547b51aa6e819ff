"""Removal of repeated passages against brute force over every window."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from txrisk.llm import queries, repeated_passages

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, ord int, words int"


def test_query_equals_sql(spark):
    import duckdb
    got = queries.op11_repeated_passages(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE["op11_repeated_passages"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def brute(docs, size=20):
    """docs: (doc_id, text, order); rows of equal order are one document."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in docs]
    first = {}
    for (_, _, o), w in zip(docs, words, strict=True):
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            first[k] = min(first.get(k, (o, i)), (o, i))
    out = []
    for (d, _, o), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (o, i):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append(repr((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())))
    return sorted(out)


def check(spark, docs, size=20):
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA).repartition(3)
    keys = {(r.doc_id, r.text): r.k for r in frame.withColumn("k", F.xxhash64("doc_id", "text")).collect()}
    ordered = [(d, t, (0, d) if d is not None else (1, keys[d, t])) for d, t in docs]
    got = repeated_passages.remove_repeats(frame, size=size)
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute(ordered, size)
    rest = got.filter("kept_text IS NOT NULL").select("kept_text", "kept_sha256").collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rest)


def passages(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["ü", "漢字", "a b", "x\x1cy"]
    fresh = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    shared = [fresh(k) for k in (19, 20, 21, 55, 300)]
    docs = []
    for i in range(n):
        words = fresh(rnd.randrange(0, 60))
        for _ in range(rnd.randrange(0, 4)):
            p = rnd.choice(shared)
            a = rnd.randrange(0, len(p))
            words += (p[a:a + rnd.randrange(10, 80)] if rnd.random() < 0.5 else p) + fresh(rnd.randrange(0, 30))
        docs.append((i, rnd.choice([" ", "  ", "\n", "\t"]).join(words)))
    return docs, shared, fresh


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, seed):
    docs, *_ = passages(seed)
    check(spark, docs)


def test_odd_rows(spark):
    docs, shared, fresh = passages(7, 20)
    text = " ".join(shared[4])
    docs += [(100, None), (101, ""), (102, " \t\n"), (None, None), (103, " ".join(shared[1])), (104, " ".join(shared[1])), (-5, "\n" + text + " tail")]
    docs += [(105, "a b c " * 60), (106, "a " * 500), (107, "b c a " * 40), (108, " ".join(shared[3] * 3))]      # repeats in itself
    docs += [(109, text)] * 3 + [(110, text + " " + " ".join(fresh(10))), (110, " ".join(fresh(30)) + " " + text)]       # repeated ids
    docs += [(None, text + " one"), (None, "two " + text), (None, "two " + text)]
    docs += [(2**62, text), (111, " ".join(fresh(70_000)) + " " + text)]
    check(spark, docs)


def test_many_small_shards(spark, monkeypatch):
    monkeypatch.setattr(repeated_passages, "SHARD_ANCHORS", 3)
    monkeypatch.setattr(repeated_passages, "STREAM_BYTES", 2000)
    docs, shared, _ = passages(3, 60)
    check(spark, docs + [(1000 + i, " ".join(shared[4])) for i in range(100)])


@pytest.mark.parametrize("size", [1, 2, 5, 33])
def test_other_sizes(spark, size):
    docs, *_ = passages(4, 25)
    check(spark, docs + [(500, "a b"), (501, "b a b")], size)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = repeated_passages.remove_repeats(none)
    assert got.count() == 0 and got.columns == ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"]


def test_equal_windows_have_equal_anchors():
    docs, *_ = passages(9, 40)
    hashes, begin = repeated_passages.word_hashes(pa.array([t for _, t in docs]))
    w = repeated_passages.Windows(hashes, begin, 20)
    by = {}
    for h, a in zip(w.hash.tolist(), w.anchor.tolist(), strict=True):
        assert by.setdefault(h, a) == a
    text, shingle, n = w.anchors()
    assert set(zip(w.text.tolist(), w.anchor.tolist(), strict=True)) == set(zip(text.tolist(), shingle.tolist(), strict=True))
    assert n.sum() < 0.4 * len(hashes)


def test_large_shards_get_several_automata(monkeypatch):
    monkeypatch.setattr(repeated_passages, "BOOK_WORDS", 50)
    rnd = random.Random(1)
    parts = [(str(i), i, " ".join(f"v{rnd.randrange(90)}" for _ in range(25))) for i in range(8)]
    compiled = repeated_passages.books(parts, 20)
    assert len(compiled) == 4
    runs = [("99", 7, "x y " + parts[3][2] + " z"), ("3", 3, parts[3][2]), ("4", 9, parts[4][2])]
    found = sorted(x for book in compiled for x in book.repeats(runs))
    assert found == [(0, 9, 34), (2, 9, 34)]
    assert np.all([book.hash[1:] >= book.hash[:-1] for book in compiled if len(book.hash) > 1] or [True])
