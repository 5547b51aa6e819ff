"""Filter audit and vector codes against brute force, and their defined results on odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.llm import filter_audit, queries, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_filter_audit"])
def test_query_equals_sql(spark, name):
    import duckdb
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


# 13. filter interaction audit

def brute_audit(docs, labels):
    """docs: (doc_id, text, lang); every order worked off document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    by_part = {}
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = {k for k, f in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                                             bool(re.search(r"[#$%&*|]", text)), earlier), strict=True) if f}
        by_part.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, rows in by_part.items():
        shapley = dict.fromkeys("ABCDE", 0)
        mine = {}
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, k in enumerate(order, 1):
                gone = [r for r in left if k in r[0]]
                left = [r for r in left if k not in r[0]]
                shapley[k] += len(gone)
                mine["".join(order), step] = [len(left), len(gone), sum(k in r[0] for r in rows) - len(gone), sum(r[0] == {k} for r in rows),
                                              sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (order, step), x in mine.items():
            out[part, order, step] = (*x, shapley[order[step - 1]])
    return out


def as_dict(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def odd_texts(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    pool = [None, "", "  ", "#", "ABC DEF", " ".join(words[:120]), " ".join(words[:120]) + " $", " ".join(words[:30] * 5),
            "X" * 40 + " " + " ".join(words[:130]), "long " + " ".join(rnd.choice(words) for _ in range(60_000))]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(pool), rnd.choice(["en", "de", "", None])) for _ in range(150)]
    docs += docs[:5] + [(i, "same same", "en") for i in range(100, 160)]
    labels = [(rnd.choice([None, *range(170)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(150)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    docs, labels = odd_texts(seed)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, digest string")
    marks = spark.createDataFrame([(*x, 3) for x in labels], "doc_id long, quality int, toxic int, n int")
    assert as_dict(filter_audit.audit_filters(frame, marks)) == brute_audit(docs, labels)


def test_audit_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    got = as_dict(filter_audit.audit_filters(one, labels))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_potential_shares_are_shapley_values(spark):
    m = 4
    rnd = random.Random(5)
    counts = spark.createDataFrame([("p", mask, rnd.randrange(1, 50), 0, 0) for mask in range(2**m)], "part string, mask int, n long, good long, toxic long")
    game = filter_audit.removal_games(counts, m)
    v, p = game.select("removed", filter_audit.potentials(F.col("removed"), m)).first()
    for i in range(m):
        marginal = sum(v[before | 1 << i] - v[before] for order in itertools.permutations(range(m))
                       for before in [sum(1 << j for j in order[:order.index(i)])])
        assert p[2**m - 1] - p[2**m - 1 - (1 << i)] == marginal
    assert sum(p[2**m - 1] - p[2**m - 1 - (1 << i)] for i in range(m)) == 24 * v[2**m - 1]      # nothing is lost


# 12. vector codes

def brute_codes(rows, parts=8, k=16, rounds=6, scale=4096):
    kept = [(i, lab, [int(np.floor(float(x) * scale)) for x in v]) for i, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in kept])
    x = x.reshape(len(x), parts, -1)
    book = x[:k].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        d = ((x[:, :, None] - book[None]) ** 2).sum(-1)
        code, error = d.argmin(-1), d.min(-1).sum(1)
        for p, e in itertools.product(range(parts), range(book.shape[1])):
            mine = x[code[:, p] == e, p]
            if len(mine) and step < rounds:
                book[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    by_label = {}
    for r, e in zip(kept, error, strict=True):
        by_label[r[1]] = by_label.get(r[1], 0) + int(e)
    sha = hashlib.sha256(",".join(str(n) for n in book.ravel().tolist()).encode()).hexdigest()
    return sorted((repr((r[0], c.astype(np.uint8).tobytes().hex(), int(e), by_label[r[1]], sha)) for r, c, e in zip(kept, code, error, strict=True)))


def coded(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, near int")
    return sorted(repr(tuple(r)) for r in vector_codes.compress(frame.repartition(3), **how)
                  .select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def vectors(n, dim, seed, grid=None):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim)) + rnd.integers(0, 4, size=(n, 1)) * 1.5
    x = np.round(x / grid) * grid if grid else x
    return [(int(i), [float(np.float32(c)) for c in v], int(i) % 3 if i % 7 else None) for i, v in enumerate(x)]


@pytest.mark.parametrize("grid", [None, 1.0])       # the coarse grid is full of ties
def test_codes_equal_brute_force(spark, grid):
    rows = vectors(700, 16, 3, grid)
    rows += [(2000, None, 1), (2001, [1.0] * 15 + [None], 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] * 16, 2),
             (None, rows[0][1], 1), (5, rows[5][1], 1), (5, rows[9][1], 1)] + [(3000 + i, rows[1][1], None) for i in range(300)]
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_few_rows_and_none(spark):
    rows = vectors(5, 8, 4)
    assert coded(spark, rows) == brute_codes(rows)
    assert coded(spark, rows[:1]) == brute_codes(rows[:1])
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    assert coded(spark, rows, entries=4, rounds=2, parts=2) == brute_codes(rows, parts=2, k=4, rounds=2)


def test_codes_refuse_what_they_cannot_hold(spark):
    with pytest.raises(Exception, match="length"):
        coded(spark, [(1, [1.0] * 7, 1)])
    with pytest.raises(Exception, match="components"):
        coded(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1), *[(i, [1.0] * 8, 1) for i in range(3, 30)], (99, [1.0] * 16, 1)], entries=1)
    with pytest.raises(Exception, match="too large"):
        coded(spark, [(i, [3e38] * 8, 1) if i == 50 else (i, [1.0] * 8, 1) for i in range(60)])


def test_bounds_spare_distances_and_lists_shrink(spark):
    rows = vectors(3000, 16, 8)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    _, books, listed, _ = vector_codes.train(vector_codes.quantised(frame, "vec_id", "embedding", "label"))
    first, last = books.history[0], books.history[-1]
    assert first["by_all"] == 3000 * 8 and last["by_bounds"] + last["by_some"] + last["by_all"] == 3000 * 8
    assert last["by_all"] < first["by_all"] / 2 and (listed <= first["listed"]).all()
