"""Queries on files that they write first: what they read, and their SQL twins."""

import os

import pytest

from helixframe.plans import catalog

from .test_oracle import DATA, con, plain  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(("name", "part"), [("src_07", "/chrom="), ("src_08", "/chrom="), ("snk_07", ".json")])
def test_reads_what_it_wrote(spark, con, name, part):  # noqa: F811
    df = catalog.QUERIES[name](spark, DATA)
    written = [f for f in df.inputFiles() if DATA not in f]  # src_08 joins with the calls themselves
    assert written and all(part in f for f in written)
    if name == "src_08":
        assert "dynamicpruning" in df._jdf.queryExecution().toString()
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(plain(r, names) for r in found.fetchall()) == sorted(plain(r, df.columns) for r in df.collect())
