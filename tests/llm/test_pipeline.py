"""The pipeline's stages on nulls, repeated ids, ties, empty tables and columns whose names clash with the operators' own."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from folioscan.llm import surrogates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _size long, _e string, _gone long, _entities long, row string, draw double, digest long, keep boolean"
STAGES = dict(corpus_pipeline.STAGES)


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, prose(900, 40))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark):
    edited = prose(5).split(" ")
    edited[60] = "edited"
    rows = [(None, "too short"), (None, prose(1)), (None, prose(2)), (8, prose(3)), (8, prose(4)), (9, prose(3)), (10, prose(5)), (10, " ".join(edited)), (11, prose(6)), (11, prose(6)), (12, None), (13, ""), (14, f"{prose(7)} {prose(900, 40)}"), (None, prose(4))]
    full = [(i, x, "en", ["a", None][k % 2], len(x or ""), k, "own", k, k, "own", 0.5, k, False) for k, (i, x) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def held(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["text"], r["_size"]) for r in df.collect()), key=repr)


def test_rows_are_judged_one_by_one(spark, docs, folder):
    every = held(docs)
    good = STAGES["quality rules"](spark, docs, folder)
    assert good.columns == docs.columns and held(good) == [r for r in every if r[1] and r[1] != "too short"]
    once = STAGES["near-duplicates"](spark, good, folder)
    assert once.columns == docs.columns
    left = [(r[0], r[1]) for r in held(once)]
    assert sorted(left, key=repr)[:-1] != [] and left.count((11, prose(6))) == 1
    # copies of prose(3) are under 8 and 9, of prose(4) under 8 and no id; of the near copies under 10 one stays
    want = {(None, prose(1)), (None, prose(2)), (8, prose(3)), (8, prose(4)), (11, prose(6)), (14, f"{prose(7)} {prose(900, 40)}")}
    assert want < set(left) and len(left) == len(want) + 1 and sum(r[0] == 10 for r in left) == 1
    clean = STAGES["benchmark leaks"](spark, once, folder)
    assert clean.columns == docs.columns and {r[0] for r in held(clean)} == {None, 8, 10, 11}
    mixed = STAGES["mixing"](spark, clean, folder)
    assert mixed.columns == docs.columns and set(held(mixed)) <= set(held(clean))
    files = STAGES["token files"](spark, mixed, folder)
    assert files.count() == mixed.count()


def test_empty_tables_pass_every_stage(spark, folder):
    df = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, folder)
        assert out.count() == 0
        df = out if "text" in out.columns else df


def test_own_columns_come_through_protection(spark, docs):
    rows = docs.limit(1).selectExpr("doc_id", "'Mrs. Jane Doe' AS text", "_e", "_entities", "row", "digest", "'x' AS found", "'y' AS units", "'z' AS gaps")
    out = surrogates.protect(rows).first()
    assert out["_e"] == "own" and out["found"] == "x" and out["units"] == "y" and out["gaps"] == "z" and out["n_entities"] == 1 and "Doe" not in out["text"]
