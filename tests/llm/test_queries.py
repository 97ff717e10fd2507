"""Registered queries against their SQL, and the pipeline against its stages' rules."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from folioscan.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(map(tuple, df[sorted(got.columns)].astype(object).where(df.notna(), None).itertuples(index=False)), key=repr)
    assert plain(got) == plain(want) and len(got)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r[0] for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        assert {r[0] for r in kept.select("doc_id").collect()} <= before
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in kept.select("doc_id").collect())
