"""Queries against their SQL twins at the smallest size."""

import os

import duckdb
import pytest

from helixframe.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [n for i, n in enumerate(sorted(catalog.ORACLE_SQL)) if i % 5 == 0 or n.startswith(("mart_", "jn_1", "ag_2"))]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(row, names):
    pairs = sorted(zip(names, row, strict=True))
    return tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for _, v in pairs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(plain(r, names) for r in found.fetchall()) == sorted(plain(r, df.columns) for r in df.collect())
