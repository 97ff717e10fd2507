"""Operators against plain Python, on a small fixture with nulls, empty, short, long and repeated texts."""

from __future__ import annotations

import difflib
import hashlib
import hmac
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from folioscan.llm import chains, common, decontaminate, latticelm, minhash, mixing, quality, substrings, surrogates, tokenfile, tokens

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, name string, key string, word string"


def lower(x: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def words(x: str | None) -> list[str]:
    return WORD.findall(lower(x or ""))


@pytest.fixture(scope="module")
def texts() -> dict[int, str | None]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices(["th", "er", "on", "né", "sch", "la"], k=rng.randint(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    out: dict[int, str | None] = {0: None, 1: "", 2: " \n\t ", 3: "one two", 4: "One  two", 5: "x" * 5000, 6: "der " * 400}
    base, passage = prose(200), prose(70)
    for i in range(7, 60):
        out[i] = prose(rng.randint(1, 300))
    for i in range(60, 70):
        own = base.split(" ")
        for _ in range(i - 60):
            own[rng.randrange(len(own))] = "edited"
        out[i] = " ".join(own)
    for i in range(70, 76):
        out[i] = prose(60) + " " + passage + "\n" + prose(30)
    for i in range(76, 80):
        out[i] = base
    out[80] = prose(30_000)
    out[81] = "Mrs. Jane Doe wrote to jane.doe@mail.example.com from 12.34.56.78, +1 (555) 010-9999. Mrs. Jane Doe!"
    out[82] = "jane.doe@mail.example.com paid with 4111 1111 1111 1111 (4111-1111-1111-1111)\ntoken = \"" + "ab12" * 10 + '"'
    out[83] = "\n".join(["same line here"] * 30)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, x, "en", ["a", "b", None][i % 3], 0, 1, "n", "k", "w") for i, x in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts_and_files(docs, texts):
    tokenizer = Tokenizer.from_file(tokens.VOCABULARY)
    counts = by_id(tokens.token_counts(docs, huge=2000, chunk=700, overlap=16))
    files = by_id(tokenfile.checksums(tokenfile.write(docs, length=64, rows=4)))
    start = 0
    for i in sorted(texts):
        ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids
        assert counts[i]["n_tokens"] == len(ids) and counts[i]["n_bytes"] == len((texts[i] or "").encode())
        assert counts[i]["over_limit"] == (len(ids) > 2048)
        ids.append(1)
        assert (files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_sequences_are_read_without_a_copy(tmp_path):
    out = tokenfile.TokenFileWriter(f"file://{tmp_path}/x.arrows", 8, 3)
    ids = np.arange(1, 100, dtype=np.uint16)
    out.append(ids[:40])
    out.append(ids[40:])
    out.close()
    file = tokenfile.TokenFile(f"file://{tmp_path}/x.arrows")
    got, mask = file.sequence(12)
    assert got.tolist() == [97, 98, 99, 0, 0, 0, 0, 0] and mask.to_pylist() == [True] * 3 + [False] * 5
    batch = file.batch(4)
    inside = lambda at, column: any(b and b.address <= at < b.address + b.size for b in batch.column(column).buffers())
    assert not got.flags.owndata and inside(got.ctypes.data, 0) and inside(mask.buffers()[1].address, 1)
    assert all(file.span(a, n).tolist() == ids[a : a + n].tolist() for a in range(0, 99, 7) for n in range(100 - a))


@pytest.mark.parametrize("text", ["a<|endoftext|>b, it's", "T̈ é,x", "<|ENDOFTEXT|> Don't!!", "naïve…,, 12abc", "\x85  x"])
def test_pieces_are_the_librarys_tokens(text):
    import pyarrow as pa

    from folioscan.llm import textbytes

    want = Tokenizer.from_file(tokens.VOCABULARY).encode(text, add_special_tokens=False).ids
    ids, n = tokens.Pieces.of(tokens.VOCABULARY).encoded(*textbytes.text_bytes(pa.array([None, text])))
    assert ids.tolist() == want and n.tolist() == [0, len(want)]


@pytest.mark.parametrize("alphabet", ["abcdeinorst", "a", "ab'. ", "xy1,;é漢 ", "the'll<|endoftext|> "])
def test_chunks_join_without_white_space(alphabet):
    rng = random.Random(19)
    tokenizer = Tokenizer.from_file(tokens.VOCABULARY)
    for n in (900, 5000):
        for k in range(6):
            text = "".join(rng.choices([alphabet] if k > 4 else alphabet, k=n // (len(alphabet) if k > 4 else 1)))
            assert tokens.resynchronised(tokenizer, text, 300, 8) == tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_take_linear_time():
    class Counting:
        seen = 0

        def encode(self, text, add_special_tokens):
            self.seen += len(text)
            return own.encode(text, add_special_tokens=add_special_tokens)

    own, rng = Tokenizer.from_file(tokens.VOCABULARY), random.Random(3)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "a"):
        counting, text = Counting(), "".join(rng.choices(alphabet, k=200_000))
        ids = tokens.resynchronised(counting, text)
        assert ids == own.encode(text, add_special_tokens=False).ids and counting.seen < 8 * len(text)


@pytest.mark.parametrize("hot, bits, limit", [(20_000, 29, 1 << 26), (2, 29, 1 << 26), (20_000, 16, 0)])
def test_repeated_bytes(docs, texts, monkeypatch, hot, bits, limit):
    for module, name, value in ((substrings, "CHUNK", 40), (substrings, "HELD_ROWS", 90), (common, "HELD_NAMES", 900), (substrings, "HOT", hot), (common, "MOST_BITS", bits), (substrings, "BROADCAST_BYTES", limit)):
        monkeypatch.setattr(module, name, value)
    got, seen = by_id(substrings.repeated_bytes(docs)), set()
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            window = data[k : k + 100]
            if window in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_near_duplicates(docs, texts):
    sets = {}
    for i, x in texts.items():
        w = words(x)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    got = by_id(minhash.near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


def test_links_between_components_are_found_in_blocks(spark, docs, monkeypatch):
    """With stars that find nothing, the comparison block by block must find every link."""
    want = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    confirmed = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, sets: confirmed(pairs, sets).limit(0))
    monkeypatch.setattr(minhash, "BLOCK", 300)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == want


def test_lattice_scores(docs, texts):
    got = by_id(latticelm.lattice_scores(docs, hot_words=20))
    spelt = {i: [*words(x), "</end>"] for i, x in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, ws in spelt.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in spelt.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base)
    # expectation maximisation over all segmentations, and the documents' scores, word by word in plain Python
    pieces = latticelm.vocabulary(latticelm.VOCABULARY)
    weights = dict(enumerate(latticelm.first_weights(latticelm.VOCABULARY, pieces)))
    longest, end = max(map(len, pieces)), 0.0

    def edges(x: str):
        for e in range(1, len(x) + 1):
            for b in range(max(0, e - longest), e):
                if x[b:e] in pieces:
                    yield b, e, [pieces[x[b:e]]]
            if x[e - 1] not in pieces:
                yield e - 1, e, [pieces[f"<0x{c:02X}>"] for c in x[e - 1].encode()]

    def forward(word: str) -> tuple[list, list[float]]:
        x = latticelm.MARK + word
        found, alpha = list(edges(x)), [0.0] + [-math.inf] * len(x)
        for b, e, ids in found:
            alpha[e] = np.logaddexp(alpha[e], alpha[b] + sum(weights[i] for i in ids))
        return found, alpha

    for _ in range(latticelm.ROUNDS):
        expected = {i: latticelm.PRIOR for i in pieces.values()}
        for word, c in counts.items():
            if word != "</end>" or c != sum(not h for h in held.values()):
                found, alpha = forward(word)
                share = [0.0] * len(alpha)
                share[-1] = c
                for b, e, ids in reversed(found):
                    part = share[e] * math.exp(alpha[b] + sum(weights[i] for i in ids) - alpha[e])
                    share[b] += part
                    for i in ids:
                        expected[i] += part
        ends = counts["</end>"] + latticelm.PRIOR
        whole = sum(expected.values()) + ends
        weights = {i: math.log(x / whole) for i, x in expected.items()}
        end = math.log(ends / whole)
    path = {w: forward(w)[1][-1] for w in {w for ws in spelt.values() for w in ws[:-1]}}
    for i, ws in spelt.items():
        assert got[i]["score"] == pytest.approx((sum(path[w] for w in ws[:-1]) + end) / math.log(10), rel=1e-6)
    every = {(r["doc_id"], round(r["score"], 6)) for r in latticelm.lattice_scores(docs).collect()}
    assert every == {(i, round(r["score"], 6)) for i, r in got.items()}


def test_a_words_lattice_sums_all_segmentations():
    pieces = latticelm.vocabulary(latticelm.VOCABULARY)
    weights = latticelm.first_weights(latticelm.VOCABULARY, pieces)

    def every(text: str) -> list[tuple[float, list[int]]]:
        if not text:
            return [(0.0, [])]
        out = [(weights[pieces[text[:e]]] + w, [pieces[text[:e]], *ids]) for e in range(1, len(text) + 1) if text[:e] in pieces for w, ids in every(text[e:])]
        if text[0] not in pieces:
            own = [pieces[f"<0x{b:02X}>"] for b in text[0].encode()]
            out += [(sum(weights[i] for i in own) + w, own + ids) for w, ids in every(text[1:])]
        return out

    lattice = latticelm.Lattice(pieces, weights)
    some = ["the", "thtion", "é漢x", "***", "ciónes"]
    total, into = np.zeros(len(weights)), np.zeros(len(weights))
    lattice.expect(some, np.ones(len(some)), into)
    for word, found in zip(some, lattice.log_probabilities(some), strict=True):
        paths = every(latticelm.MARK + word)
        whole = np.logaddexp.reduce([w for w, _ in paths])
        assert found == pytest.approx(whole)
        for w, ids in paths:
            np.add.at(total, ids, math.exp(w - whole))
    assert np.allclose(total, into)


def test_tiles_take_the_longest_first_and_in_any_order():
    rng = random.Random(2)
    for _ in range(50):
        item = [rng.randrange(9) for _ in range(30)]
        text = item[15:] + [99] + item[:15]
        pairs = [(i, j) for i in range(len(item) - 4) for j in range(len(text) - 4) if item[i : i + 5] == text[j : j + 5]]
        found = decontaminate.tiles(pairs)
        assert sum(n for _, _, n in found) >= 25
        assert all(item[i : i + n] == text[j : j + n] for i, j, n in found)
        for k in (0, 1):
            taken = [t for x in found for t in range(x[k], x[k] + x[2])]
            assert len(taken) == len(set(taken))


def test_tiles_are_those_of_plain_tiling():
    """The longest match of free tokens again and again, the first of equals, until none has five."""
    rng = random.Random(3)
    for size in (2, 3, 9, 9, 30) * 12:
        item, text = ([rng.randrange(size) for _ in range(rng.randint(0, 40))] for _ in range(2))
        if rng.random() < 0.5:
            cut = rng.randint(0, len(item))
            text[5:5] = item[cut:] + [-1] * rng.randint(0, 2) + item[:cut]
        left, right, want = [True] * len(item), [True] * len(text), []
        while True:
            best = (0, 0, 0)
            for i in range(len(item)):
                for j in range(len(text)):
                    n = 0
                    while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and left[i + n] and right[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < decontaminate.SEED:
                break
            want.append((i, j, n))
            left[i : i + n], right[j : j + n] = [False] * n, [False] * n
        k = decontaminate.SEED
        pairs = [(i, j) for i in range(len(item) - k + 1) for j in range(len(text) - k + 1) if item[i : i + k] == text[j : j + k]]
        rng.shuffle(pairs)
        assert (decontaminate.tiles(pairs) if pairs else []) == sorted(want)


def test_leaks_are_those_of_plain_tiling(spark):
    rng = random.Random(6)
    vocabulary = ["Ab", "cd", "éf", "g1", "h", "x" * 30]
    items = {k: " ".join(rng.choices(vocabulary, k=rng.randint(3, 30))) for k in range(12)}
    held = {k: "; ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + (" " + items[k % 12] if k % 3 else "") for k in range(40)}
    low = lambda x: re.findall(r"[^\W_]+", x.lower())

    def covered(item: list[str], text: list[str]) -> int:
        pairs = [(i, j) for i in range(len(item) - 4) for j in range(len(text) - 4) if item[i : i + 5] == text[j : j + 5]]
        return sum(n for _, _, n in decontaminate.tiles(pairs)) if pairs else 0

    want = {(d, i, n) for d, x in held.items() for i, q in items.items() for n in [covered(low(q), low(x))] if n and 2 * n >= len(low(q))}
    frame = lambda rows, id_: spark.createDataFrame(list(rows.items()), f"{id_} long, text string")
    got = decontaminate.contaminated(frame(held, "doc_id").repartition(3), frame(items, "item_id")).collect()
    assert {(r["doc_id"], r["item_id"], r["n_covered"]) for r in got} == want and len(got) == len(want) > 20
    left = decontaminate.clean(frame(held, "doc_id"), frame(items, "item_id")).collect()
    assert {r["doc_id"] for r in left} == set(held) - {d for d, _, _ in want}


def test_leaks(spark, docs, texts):
    held = " ".join(words(texts[20])[:40])
    moved = held.split(" ")
    items = [(1, held.upper()), (2, " ".join(moved[20:] + moved[:20])), (3, "none of these words is in any document of the fixture at all"), (4, None), (5, "short")]
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(20, 1), (20, 2)}
    kept = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(texts) - {20}


def test_fuzzy_repeats(docs, texts):
    found = defaultdict(list)
    for r in chains.fuzzy_repeats(docs).collect():
        x, y = words(texts[r["doc_id"]])[r["begin"] : r["end"]], words(texts[r["other_id"]])[r["other_begin"] : r["other_end"]]
        same = sum(m.size for m in difflib.SequenceMatcher(None, x, y, False).get_matching_blocks())
        assert chains.SHORTEST <= r["n_same"] <= same and r["n_same"] >= chains.SAME * max(len(x), len(y))
        assert r["other_id"] < r["doc_id"]
        found[r["doc_id"]].append(r["other_id"])
    assert {i for i in found if i < 80} == {*range(61, 70), *range(71, 80)}


def test_a_chain_is_the_best_ordered_one():
    rng = random.Random(3)
    for _ in range(200):
        matches = list({(rng.randrange(20), rng.randrange(20)) for _ in range(8)})
        best = 0.0
        for mask in range(1, 1 << len(matches)):
            own = sorted(m for k, m in enumerate(matches) if mask >> k & 1)
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(own, own[1:], strict=False)):
                best = max(best, sum(6 - (0.05 * (b[0] - a[0] + b[1] - a[1]) if a else 0) for a, b in zip([None, *own[:-1]], own, strict=True)))
        chain = chains.chains(matches)[0]
        score = 6 * len(chain) - sum(0.05 * (b[0] - a[0] + b[1] - a[1]) for a, b in zip(chain, chain[1:], strict=False))
        assert score == pytest.approx(best)


def test_chains_of_distant_passages_do_not_hide_each_other():
    for first, gap, second in ((60, 80, 100), (200, 900, 100), (1000, 3000, 100)):
        one = [(x, x) for x in range(0, first, 7)]
        two = [(x, x) for x in range(first + gap, first + gap + second, 7)]
        assert sorted(chains.chains(one + two)) == [one, two]


def test_a_passage_whose_parts_are_older_is_found_to_its_ends(spark):
    rng = random.Random(17)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    parts = [prose(32) for _ in range(8)]
    rows = [(k, f"{prose(90)} {x} {prose(60)}") for k, x in enumerate(parts)]
    rows += [(20, f"{prose(50)} {parts[0]} {parts[1]} {prose(50)}"), (30, f"{prose(70)} {parts[0]} {parts[1]} {prose(20)}")]
    rows += [(40, f"{prose(50)} {' '.join(parts)} {prose(9)}"), (50, f"{prose(9)} {' '.join(parts)} {prose(50)}")]
    found = chains.fuzzy_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["other_id"]): (r["begin"], r["end"], r["other_begin"], r["other_end"], r["n_same"]) for r in found}
    assert got[30, 20] == (70, 134, 50, 114, 64)
    assert got[50, 40] == (9, 265, 50, 306, 256)


def test_second_copies_are_found(spark):
    rng = random.Random(31)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two = prose(60), prose(60)
    rows = [(1, f"{prose(50)} {one} {prose(50)}"), (2, f"{one} {prose(90)} {one} {prose(9)}"), (3, f"{two} {prose(90)} {two}"), (4, "der " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["other_id"], r["begin"], r["end"], r["other_begin"]) for r in chains.fuzzy_repeats(df).collect()}
    assert got == {(2, 1, 0, 60, 50), (2, 1, 150, 210, 50)}
    own = {(r["doc_id"], r["other_id"], r["begin"], r["end"], r["other_begin"]) for r in chains.fuzzy_repeats(df, within=True).collect()}
    assert {r for r in own if r[0] != 4} == got | {(3, 3, 150, 210, 0)}
    assert all(r[1] == 4 for r in own if r[0] == 4)


def test_altered_passages_are_aligned(spark):
    rng = random.Random(23)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(40):
        passage = prose(60)
        altered = passage[:]
        for at in range(k % 6, 60, 6) if k % 2 else rng.sample(range(60), 9):
            altered[at] = "other"
        rows += [(k, " ".join(prose(50) + passage + prose(30))), (100 + k, " ".join(prose(70) + altered + prose(60)))]
        want.add((100 + k, k))
    found = chains.fuzzy_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["other_id"]) for r in found}
    assert got <= want and len(got) >= 39


def _joined(found, pairs):
    """Of pairs of documents, those without a row and without an earlier document that both have a row with."""
    rows = {(r["doc_id"], r["other_id"]) for r in found}
    others = defaultdict(set)
    for x, y in rows:
        others[x].add(y)
    return {(x, y) for x, y in pairs if (x, y) not in rows and not others[x] & others[y]}


def test_passages_whose_seeds_stand_in_many_earlier_documents_are_found(spark):
    rng = random.Random(37)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one = prose(200)
    two = one[:]
    for at in rng.sample(range(200), 26):
        two[at] = "other"
    rows = [(3 * k + j, " ".join(prose(40) + x[at : at + 24] + prose(40))) for j, x in enumerate((one, two)) for k, at in enumerate(range(0, 200, 12))]
    rows += [(100, " ".join(prose(60) + one + prose(30))), (200, " ".join(prose(20) + two + prose(70)))]
    found = chains.fuzzy_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == {(200, 100)}
    assert max(r["n_same"] for r in found) >= 170


def test_a_change_every_fourth_word_is_found(spark):
    rng = random.Random(41)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(20):
        passage = prose(59)
        altered = [f"x{rng.randrange(10**6)}" if at % 4 == 3 else w for at, w in enumerate(passage)]
        rows += [(k, " ".join(prose(50) + passage + prose(30))), (100 + k, " ".join(prose(70) + altered + prose(60)))]
        want.add((100 + k, k))
    found = chains.fuzzy_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == want


@pytest.mark.parametrize("few", [2, 32])
def test_passages_of_common_lines_are_those_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(chains, "FEW", few)
    rng = random.Random(43)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    lines, own = [prose(rng.randint(16, 24)) for _ in range(5)], [prose(30) for _ in range(6)]
    parts, rows = {}, []
    for i in range(40):
        parts[i] = [rng.choice(lines + own) for _ in range(3)]
        rows.append((i, " ".join(sum((x + prose(3) for x in parts[i]), prose(90)) + prose(90))))
    # two parts in a row, 40 words or more that agree and three that don't
    pairs = {(i, j) for i in parts for j in range(i) for a, b in zip(parts[i], parts[i][1:], strict=False) for c, d in zip(parts[j], parts[j][1:], strict=False) if a is c and b is d and len(a + b) >= 40}
    found = chains.fuzzy_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(pairs) > 20 and not _joined(found, pairs)


def test_copies_are_rows_of_the_first(spark):
    rng = random.Random(47)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    x = prose(50)
    rows = [(1, f"{x} {prose(30)}"), (2, y := f"{prose(9)}\n\t{x}  "), (3, y), (4, y), (5, "few words"), (6, "few words"), (7, y), (7, prose(60))]
    found = {tuple(r) for r in chains.fuzzy_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(2, 9, 59, 1, 0, 50, 50), (3, 0, 59, 2, 0, 59, 59), (4, 0, 59, 2, 0, 59, 59), (7, 0, 59, 2, 0, 59, 59)} <= found
    assert {r[0] for r in found} == {2, 3, 4, 7}


@pytest.mark.parametrize("around", [24, None])
def test_words_of_many_spans_come_in_batches_of_bounded_size(around):
    rng = random.Random(53)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (20_000, 0, 30_000, 9)]
    spans = []
    for k, text in enumerate(texts):
        n = len(text.split())
        lows = [rng.randrange(n - 6) for _ in range(3 if n < 10 else 500)] if n else []
        spans.append([{"chain": 1000 * k + i, "side": i % 2, "lo": lo, "hi": lo + 6} for i, lo in enumerate(lows)])
    kind = pa.list_(pa.struct([("chain", pa.int64()), ("side", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]))
    batch = pa.record_batch([pa.array(range(5)), pa.array(["", *texts]), pa.array([[], *spans], kind)], names=["doc_id", "text", "spans"]).slice(1)
    cut = list(chains._cut(iter([batch]), around))
    assert max(sum(map(len, b["words"].to_pylist())) for b in cut) <= 4 * chains.CUT_WORDS
    got = {r["chain"]: r for b in cut for r in b.to_pylist()}
    whole = {k: hashes for k, text in enumerate(texts) for _, _, hashes, _ in chains._word_slices(pa.record_batch([pa.array([k]), pa.array([text])], names=["doc_id", "text"]))}
    for k, own in enumerate(spans):
        for x in own:
            begin, end = (0, len(whole[k])) if around is None else (max(0, x["lo"] - around), x["hi"] + around)
            words = (whole[k] >> np.uint64(32)).astype(np.uint32)[begin:end].tobytes()
            assert got[x["chain"]] == {"chain": x["chain"], "side": x["side"], "begin": begin, "last": end >= len(whole[k]), "words": words}


def test_common_words_are_counted():
    rng = random.Random(29)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert chains.common(np.array(a, int), np.array(b, int)) == best[-1][-1]


def test_surrogates(docs, texts):
    got = by_id(surrogates.protect(docs))
    first, second = got[81]["text"], got[82]["text"]
    for secret in ("jane.doe@mail", "12.34.56.78", "010-9999", "4111", "ab12ab12", "Jane", "Doe"):
        assert secret not in first + second
    mail = re.search(r"\S+@\S+\w", first)[0]
    assert mail in second and got[81]["n_entities"] == 5 and got[82]["n_entities"] == 4
    names = re.findall(r"Mrs\. (\w+ \w+)", first)
    assert names[0] == names[1] and names[0].split(" ")[0] in surrogates.GIVEN["woman", "latin"]
    card = re.search(r"(\d{4}) (\d{4}) (\d{4}) (\d{4}) \((\d{4})-(\d{4})-(\d{4})-(\d{4})\)", second)
    assert card.groups()[:4] == card.groups()[4:]
    digits = [int(c) for c in "".join(card.groups()[:4])]
    assert sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    assert {i: r["text"] for i, r in got.items() if i not in (81, 82)} == {i: x for i, x in texts.items() if i not in (81, 82)}


def test_each_kind_alone_in_a_text_is_replaced(spark):
    alone = ["8.8.8.8", "1.1.1.1", "a1b2c3d4" * 4, "abcdefab" * 4, "A1B2C3D4" * 8, "x@y.example", "4111-1111-1111-1111", "123-45-6789"]
    alone += ["(555) 010-9999", "+4 555 010 9999", "DE12 ABCD EFGH JKLM", "Mrs. Doe", "Herr Doe", "Κύριος Πέτρος"]
    df = spark.createDataFrame([(k, f"it is {x} here") for k, x in enumerate(alone)], "doc_id long, text string")
    for k, r in by_id(surrogates.protect(df)).items():
        assert r["n_entities"] == 1 and alone[k] not in r["text"]


def test_a_person_stays_one_person(spark):
    rows = [(1, "Mrs. Jane Doe met us. Jane Doe left; Mrs. Doe wrote, and JANE too. Doeskin is none."), (2, "Mr. John Doe and Mrs. Jane Roe; GB29 NWBK 6016 1331 9268 19")]
    got = by_id(surrogates.protect(spark.createDataFrame(rows, "doc_id long, text string"), key="it's"))
    one, two = got[1]["text"], got[2]["text"]
    given, last = re.match(r"Mrs\. (\w+) (\w+) met us", one).groups()
    assert one == f"Mrs. {given} {last} met us. {given} {last} left; Mrs. {last} wrote, and {given.upper()} too. Doeskin is none."
    him, same, her, other, iban = re.match(r"Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+); (.*)", two).groups()
    assert same == last and her == given and other != last and him in surrogates.GIVEN["man", "latin"]
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", iban) and iban != "GB29 NWBK 6016 1331 9268 19"
    packed = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def test_surrogates_by_plain_python(spark, docs, texts):
    """Kinds, units, keyed digests, attempts and formats, written once more without Spark."""
    s, key = surrogates, "k'€"
    extra = {200 + k: x for k, x in enumerate(("8.8.8.8 and 8.8.8.8, call +49 30 1234 5678 or (555) 010-9999", "Frau Vera Müller, DE89 3704 0044 0532 0130 00, Vera", "Госпожа Анна Иванова; Анна", "SSN 123-45-6789 " + "aB3f" * 8, "Mr. Doe, Ms. DOE", "MRS. ANNA-MARIA O'BRIEN and Dr. J. R. Will; I Will, Will and O'Brien, who Will see Mr. Jean-Luc de Roe."))}
    every = texts | extra
    kinds = [("ip", s.IP), ("card", s.CARD), ("ssn", s.SSN), ("secret", s.SECRET), ("iban", s.IBAN), ("person", s.TITLE[1:] + ".*"), ("name", r"\p{L}[\p{L}'’-]*")]

    def units(e: str, roles: dict) -> list[tuple[str, str, str]]:
        kind = "email" if "@" in e else next((k for k, p in kinds if regex.fullmatch(p, e)), "phone")
        if kind == "person":
            words = regex.sub(s.TITLE, "", e).split(" ")
            return [(w, "surname" if k == len(words) - 1 else "woman" if regex.match(s.WOMEN, e) else "man" if regex.match(s.MEN, e) else "given", w.lower()) for k, w in enumerate(words)]
        canon = re.sub("[^0-9]", "", e) if kind in ("card", "ssn", "phone") else e.replace(" ", "") if kind == "iban" else e.lower()
        return [(e, roles[e.lower()] if kind == "name" else kind, canon)]

    def found(text: str) -> tuple[str, dict]:
        roles: dict[str, str] = {}
        spelt: list[str] = []
        for m in regex.finditer(s.ENTITY, text):
            if regex.match(s.TITLE, m[0]):
                for w, kind, _ in units(m[0], {}):
                    roles.setdefault(w.lower(), kind)
                    spelt += [] if w.endswith(".") else [w, w.upper()]
        return (s.ENTITY + (r"|(?<![\p{L}\p{N}])" + s.BEFORE + "(?:" + "|".join(dict.fromkeys(spelt)) + r")(?![\p{L}\p{N}])" if spelt else "")), roles

    def core(kind: str, canon: str, attempt: int) -> str:
        d = hmac.new(key.encode(), f"{kind}|{attempt}|{canon}".encode(), hashlib.sha256).hexdigest()
        d += hashlib.sha256(d.encode()).hexdigest()
        at = [0, *bytes.fromhex(d)]
        digits = lambda a, b: "".join(str(at[i] % 10) for i in range(a, b + 1))
        script = "cyrillic" if regex.search(r"\p{IsCyrillic}", canon) else "greek" if regex.search(r"\p{IsGreek}", canon) else "latin"
        syllables = lambda n: "".join(s.SYLLABLES[script][(256 * at[1 + 2 * i] + at[2 + 2 * i]) % len(s.SYLLABLES[script])] for i in range(1, n + 1))
        if kind == "email":
            return f"user.{d[:12]}@example.net"
        if kind == "ip":
            return ".".join(map(str, (240 + at[1] % 15, *at[2:5])))
        if kind == "card":
            body = canon[0] + digits(1, 14)
            return body + str(-sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(body)) % 10)
        if kind == "ssn":
            return "9" + digits(1, 8)
        if kind == "phone":
            return digits(1, len(canon)) if len(canon) < 10 else canon[:-10] + digits(1, 3) + str(at[4] % 2) + digits(5, 10)
        if kind == "secret":
            return d[: len(canon)]
        if kind == "iban":
            account = "".join(str(at[i] % 10) if c.isdigit() else chr(65 + at[i] % 26) for i, c in enumerate(canon[4:], 1))
            return f"{canon[:2]}{98 - int(''.join(str(int(c, 36)) for c in account + canon[:2] + '00')) % 97:02d}{account}"
        if kind == "surname":
            return syllables(4 + attempt)
        names = s.GIVEN[kind, script]
        return names[at[1] % len(names)].lower() + syllables(attempt)

    matched = {i: (x, *found(x)) for i, x in every.items() if x}
    real = sorted({u[1:] for x, pattern, roles in matched.values() for m in regex.finditer(pattern, x) for u in units(m[0], roles)})
    attempts = dict.fromkeys(real, 0)
    while True:
        drawn = defaultdict(list)
        for kind, canon in real:
            drawn[kind, core(kind, canon, attempts[kind, canon])].append(canon)
        again = [(kind, c) for (kind, x), own in drawn.items() for k, c in enumerate(own) if k or (kind, x) in attempts]
        if not again:
            break
        for u in again:
            attempts[u] += 1

    def new(m, roles) -> str:
        out = []
        for e, kind, canon in units(m[0], roles):
            x = core(kind, canon, attempts[kind, canon])
            if kind in ("card", "ssn", "phone", "iban"):
                letters = iter(x)
                out.append("".join(next(letters) if regex.match(r"[\p{L}\p{N}]", c) else c for c in e))
            else:
                named = kind in ("woman", "man", "given", "surname")
                out.append(x.upper() if e == e.upper() and not (named and len(e) < 3) else x.capitalize() if named else x)
        before = regex.match(s.TITLE, m[0])
        return (before[0] if before else "") + " ".join(out)

    got = by_id(s.protect(docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string")), key=key))
    for i, x in every.items():
        want = regex.sub(matched[i][1], lambda m: new(m, matched[i][2]), x) if x else x
        assert got[i]["text"] == want


def test_names_with_hyphens_apostrophes_and_more_words(spark):
    hidden = {
        "Mrs. Anna-Maria Schmidt": "Anna Maria Schmidt", "Mr. Sean O'Brien": "Sean Brien", "Mrs. Jane Mary Doe": "Jane Mary Doe", "Ms. Ann Doe-Smith": "Doe Smith", "MRS. JANE DOE": "JANE DOE",
        "Dr. Jane Doe": "Jane Doe", "Mr. J. Smith": "Smith", "Prof Zoë D’Arcy": "Zoë Arcy", "HERR KARL MEIER": "KARL MEIER", "Mr. A. B. C. Dent": "Dent",
    }
    df = spark.createDataFrame([(k, f"then {x} came") for k, x in enumerate(hidden)], "doc_id long, text string")
    got = by_id(surrogates.protect(df))
    for k, words_ in enumerate(hidden.values()):
        assert not any(w in got[k]["text"] for w in words_.split(" ")) and got[k]["text"].startswith("then ") and got[k]["text"].endswith(" came")
    kept = ["Mrs. Ann Will said: I Will go, and they Will too", "MS Word and MR Imaging", "x@" + "a." * 50_000 + "com", "x@" + "a-" * 50_000]
    out = by_id(surrogates.protect(spark.createDataFrame(list(enumerate(kept)), "doc_id long, text string")))
    assert "I Will go, and they Will too" in out[0]["text"] and "Ann" not in out[0]["text"]
    assert [out[k]["text"] for k in (1, 2, 3)] == kept[1:]


def test_clashing_surrogates_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "CORE", "concat(substring(x.d, 1, 1), '@example.net')")
    rows = [(k, f"to user{k}@mail.example.com and user{k + 1}@mail.example.com") for k in range(9)]
    out = by_id(surrogates.protect(spark.createDataFrame(rows, "doc_id long, text string")))
    drawn = [re.findall(r"\S+@\S+", out[k]["text"]) for k in range(9)]
    assert all(drawn[k][1] == drawn[k + 1][0] for k in range(8))
    assert len({x for pair in drawn for x in pair}) == 10
    with pytest.raises(ValueError):
        surrogates.protect(spark.createDataFrame([(k, f"user{k}@mail.example.com") for k in range(17)], "doc_id long, text string"))


def test_mix(docs, texts):
    rated = [r.asDict(True) for r in mixing.rated(docs.select("doc_id", "text", "source")).collect()]
    size = {i: len(WORD.findall(x or "")) for i, x in texts.items()}
    total = sum(size.values())
    of = {s: sum(size[i] for i in texts if ["a", "b", None][i % 3] == s) for s in ("a", "b", None)}
    target, weight = dict.fromkeys(of, 0.0), {"a": 1, "b": 2, None: 3}
    open_, left = set(of), float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * of[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * of[s]
            left -= target[s]
        open_ -= full
    for r in rated:
        assert r["size"] == size[r["row"]["doc_id"]] and r["target"] == pytest.approx(target[r["row"]["source"]])
        assert r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) and r["copies"] <= 3
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rated)


def test_documents_without_ids_come_near_the_target(spark):
    rows = [(None, f"{'word ' * 9}{k}", "a" if k < 400 else "b") for k in range(700)] + [(5, f"{'word ' * 9}{k}", "b") for k in range(100)]
    taken = {s: 0 for s in "ab"}
    rated = mixing.rated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for r in rated:
        taken[r["row"]["source"]] += r["size"] * r["copies"]
    target = {r["row"]["source"]: r["target"] for r in rated}
    assert 0.8 < taken["a"] / target["a"] < 1.2 and 0.8 < taken["b"] / target["b"] < 1.2 and len({r["copies"] for r in rated if r["row"]["doc_id"] == 5}) == 2


def test_ablations(docs):
    entries = [r.asDict() for r in quality.ledger(docs).collect()]
    for r in quality.ablations(quality.ledger(docs)).collect():
        mask, bit = quality.POLICIES[r["policy"]].mask, next(1 << x.bit for x in quality.RULES if x.name == r["rule"])
        assert r["n_rejected"] == sum(e["failed"] & mask != 0 for e in entries)
        assert r["n_only_this"] == sum(e["failed"] & mask == bit for e in entries)


def test_empty_tables(spark, empty):
    no_items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        quality.apply_policy(quality.ledger(empty)),
        tokens.token_counts(empty),
        tokenfile.checksums(tokenfile.write(empty)),
        substrings.repeated_bytes(empty),
        minhash.near_duplicates(empty),
        decontaminate.contaminated(empty, no_items),
        decontaminate.clean(empty, no_items),
        chains.fuzzy_repeats(empty),
        surrogates.protect(empty),
        mixing.mix(empty),
        latticelm.lattice_scores(empty),
    ):
        assert out.count() == 0


def test_null_ids_and_repeated_rows(spark, texts):
    long = " ".join(words(texts[60]))
    rows = [(None, long), (None, "a few words"), (7, long), (7, long), (9, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out, n in (
        (quality.ledger(df), 6),
        (tokens.token_counts(df), 6),
        (tokenfile.checksums(tokenfile.write(df)), 6),
        (substrings.repeated_bytes(df), 6),
        (minhash.near_duplicates(df), 6),
        (decontaminate.clean(df, spark.createDataFrame([(1, "nothing like it in there at all")], "item_id long, text string")), 6),
        (chains.fuzzy_repeats(df), 0),
        (surrogates.protect(df), 6),
        (mixing.rated(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS source")), 6),
        (latticelm.lattice_scores(df), 6),
    ):
        assert len(out.collect()) == n


def test_components_of_random_links(spark, monkeypatch):
    from folioscan.llm import components

    monkeypatch.setattr(components, "NEIGHBOURS", 3)
    rng = random.Random(37)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 430)] + [(500, k) for k in range(501, 540)]
    links = [(a, b) for a, b in links if a != b]

    def lowest(own: list) -> dict:
        low = {x: x for pair in own for x in pair}
        for _ in range(100):
            for a, b in own:
                low[a] = low[b] = min(low[a], low[b])
        return low

    table = lambda own: spark.createDataFrame(own, "a long, b long")
    first = components.connected(table(links[::2]))
    assert {r["node"]: r["label"] for r in first.collect()} == lowest(links[::2])
    assert {r["node"]: r["label"] for r in components.joined(first, table(links[1::2])).collect()} == lowest(links)
