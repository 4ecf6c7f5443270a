"""Queries whose SQL runs on whole tables, against it on the smallest tables."""

import duckdb
import pytest

from quillbank.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_passage_dedup", "op7_embedding_dedup", "op8_chat_format"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    run = con.execute(queries.ORACLES[name])
    names = [c[0] for c in run.description]
    want = sorted(run.fetchall())
    df = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == want and want
