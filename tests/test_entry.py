"""The driver's contract."""

from __future__ import annotations

import importlib.util

import __spark_entry__


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_library_stands_without_its_optional_parts(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("folioscan.llm", "corpus_pipeline") else found(name, *a))
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "anchor_exact" in queries and not any(q.startswith("op") for q in queries)
    assert set(sql) <= set(queries)
