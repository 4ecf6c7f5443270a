"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillbank.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    run = oracle.execute(registry.ORACLES[name])
    names = [c[0] for c in run.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in run.fetchall())
    assert got == want
