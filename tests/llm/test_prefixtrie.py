"""The trie of conversations against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from folioscan.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, n long, p string, own string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def sequences(rows) -> dict[int, list[tuple]]:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    return out


def brute(whole: dict[int, list[tuple]]) -> set[tuple]:
    members = defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += cost
    out = set()
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choices(["a", "b", "né", "\n", "\x0b"], k=rng.randint(0, 3)))
    rows: list[tuple] = []
    for c in [*range(-25, 0), *range(0, 130), 10**12, 10**12 + 1]:
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), text()))
    rows += [(200, None, None, None), (200, None, "", ""), (200, 3, "user", "x"), (201, 3, "user", "x"), (201, 3, "user", "x"), (201, 3, "user", "w"), (None, 1, "user", "y"), (None, None, None, None)]
    # a path with a branch at each of its depths, strings that are others' beginnings, and copies
    for i in range(40):
        rows += [(2000 + 20 * i + 1, t, "u", f"w{t} w" if t < i else "own") for t in range(i + 1)]
    for i in range(60):
        rows += [(4000 + i, t, "u", f"w{t} w") for t in range(33)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_a_trie_is_the_plain_one(spark, seed):
    rows = conversations(seed)
    rng = random.Random(seed)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "p", "o", "d") for r in rows], SCHEMA).repartition(3)
    want = brute(sequences(rows))
    got = prefixtrie.trie(prefixtrie.rebuilt(df))
    assert got.columns == COLUMNS
    assert rows_of(got) == sorted(want, key=repr)


def test_compacted_nodes_are_where_strings_branch_or_end(spark):
    from folioscan.session import materialize

    words = ["", "a", "ab", "abcdefghijklmnopq", "abcdefghijklmnopqrstuvwxyz", "abx", "abxyz", "b" * 70, "b" * 69 + "c", "b" * 40]
    df = spark.createDataFrame([(k, [(x.encode().ljust(16), 1) for x in w]) for k, w in enumerate(words)], "conv_id long, turns array<struct<sym: binary, words: bigint>>")
    strings = materialize(prefixtrie.strings_of(prefixtrie.named(df)), "strings")
    nodes = prefixtrie.build(strings)
    explicit = {"", *words} | {"b" * 69}
    names = {}
    for w in words:
        name = prefixtrie.ROOT
        names[""] = name
        for d, x in enumerate(w):
            name = hashlib.sha256(name + x.encode().ljust(16)).digest()[:16]
            names[w[: d + 1]] = name
    got = {bytes(r["id"]): r for r in nodes.collect()}
    assert set(got) == {names[w] for w in explicit}
    for w in explicit - {""}:
        r = got[names[w]]
        up = max((x for x in explicit if x != w and w.startswith(x)), key=len)
        depth = max(range(len(up) + 1, len(w) + 1), key=lambda d: d & -d)
        assert (r["depth"], bytes(r["parent"]), r["above"]) == (len(w), names[up], len(up))
        assert bytes(r["name"]) == names[w[: len(up) + 1]] and bytes(r["handle"]) == names[w[:depth]]


def test_an_empty_table(spark):
    assert prefixtrie.trie(prefixtrie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


def test_ids_of_a_sequence_are_hashed_in_blocks(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("id * 7 % 20000 - 5 AS conv_id", "CAST(array() AS array<struct<sym: binary, words: bigint>>) AS turns").repartition(5)
    got = prefixtrie.end_digests(prefixtrie.named(df)).collect()
    assert [r["ends"] for r in got] == [hashlib.sha256(",".join(str(c) for c in range(-5, 19_995)).encode()).hexdigest()]
