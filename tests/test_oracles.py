"""Every query that has SQL gives the SQL's rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from folioscan import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)), key=repr)


def duck(sql: str, sf: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for name in os.listdir(sf):
        at = f"{sf}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf}/{name}") else "")
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{at}'")
    return con.sql(sql).df()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name.startswith("anchor")


@pytest.mark.parametrize("name", ["page_objects", "page_operators", "page_text", "page_text_mapped"])
def test_documents_without_text(spark, name, tmp_path):
    """Empty lines are shown too, and documents without any text have files."""
    texts = [(0, ""), (1, None), (2, "a\n\nb"), (3, "\n"), (4, "\nc\U0001f600\n\n")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), duck(registry.ORACLES[name], str(tmp_path))
    assert rows(got) == rows(want)
    assert len(got)
