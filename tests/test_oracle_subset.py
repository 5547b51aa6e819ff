"""A few registered queries against their DuckDB oracle at sf0.001 (exact values)."""

import duckdb
import pytest

import __spark_entry__ as E

from sf_paths import SF_SMALL

NAMES = ["transfer_features", "rolling_30d", "validate_requests", "average_precision", "stratified_split",
         "topk_categories"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(cur.fetchall(), ocols)
