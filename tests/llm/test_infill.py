"""Fill-in-middle against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from folioscan.llm import infill

SCHEMA = "doc_id long, text string, output string, row string, t long, `a.b` string, _ string"


def plain(doc_id, text, unit, rate, spm, m, seed=7):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in (m.prefix, m.suffix, m.middle)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), m.suffix + suffix + m.prefix + prefix + m.middle + middle
    return n, "psm", len(prefix), len(middle), m.prefix + prefix + m.suffix + suffix + m.middle + middle


def sample() -> list[tuple]:
    rng = random.Random(3)
    out = [(0, None), (1, ""), (2, "\n"), (3, "\n\n\n"), (4, "no feed"), (5, "a <P> here\nb"), (6, "x" * 5000), (7, "né\r\nß\n" * 900), (None, "one\ntwo"), (None, None), (8, "same\nrow"), (8, "same\nrow"), (9, "<\nS>\n<P"), (10, "𝄞\n" * 3000)]
    for i in range(20, 60):
        out.append((i, "".join(rng.choices(["a", "é", "𝄞", "\n", " ", "<", "P>", "long " * 40], k=rng.randint(1, 700)))))
    out.append((60, "".join(rng.choices("aé\n", k=400_000))))
    return out


@pytest.mark.parametrize(("unit", "rate", "spm", "markers"), [("line", 100, 50, infill.Markers()), ("code point", 60, 0, infill.Markers("<|a|>", "<|b|>", "<|c|>"))])
def test_parts_and_restored_texts(spark, unit, rate, spm, markers):
    from pyspark.sql import functions as F

    rows = sample()
    docs = spark.createDataFrame([(i, x, "own", "row", 5, "z", "_") for i, x in rows], SCHEMA).repartition(3)
    made = infill.transformed(docs, rate=rate, spm=spm, unit=unit, markers=markers)
    assert made.columns == ["doc_id", "text", "row", "t", "a.b", "_", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"), markers)).collect()
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(
        ((i, x, *plain(i, x, unit, rate, spm, markers)) for i, x in rows), key=key
    )
    assert all(r["back"] == (r["text"] or "") and r["row"] == "row" and r["t"] == 5 and r["_"] == "_" for r in got)
    assert {r["form"] for r in got} == ({"plain", "psm", "spm"} if spm else {"plain", "psm"})


def test_every_cut_of_a_text_of_many_blocks():
    rng = random.Random(1)
    texts = ["".join(rng.choices("aé\n", k=k)) for k in (9_000, 0, 1, 40_000)]
    raw = [x.encode() for x in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    for unit, starts_of in infill.UNITS.items():
        units = [re.findall(r"[^\n]*\n|[^\n]+", x) if unit == "line" else list(x) for x in texts]
        draws = np.array([[k % (len(u) + 1) for k in range(0, 60_000, 997)] for u in units])
        n, chars = infill.cut_points(buf, offsets, draws, starts_of)
        assert n.tolist() == [len(u) for u in units]
        assert chars.tolist() == [[len("".join(u[:k])) for k in d] for u, d in zip(units, draws.tolist(), strict=True)]


@pytest.mark.parametrize("own", [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "z")])
def test_ambiguous_markers_are_refused(own):
    with pytest.raises(ValueError):
        infill.Markers(*own)


def test_an_empty_table(spark):
    assert infill.transformed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert infill.transformed(spark.createDataFrame([], "text string").selectExpr("text", "1L AS doc_id")).count() == 0
