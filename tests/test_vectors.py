"""Single values whose results are known, and structures that the tables do not hold."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioscan.functions import codecs, fonts
from folioscan.functions import text as T
from folioscan.operators import anchors, annotations, geometry, graph
from folioscan.sources import files, pdf


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a, b, want", [("night", "nacht", 0.25), ("x", "x", 1.0), ("a", "b", 0.0), ("", "x", 0.0), ("aaaa", "aa", 0.5)])
def test_dice(spark, a, b, want):
    assert value(spark, T.dice(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize("text, want", [("Foo-  bar", "foobar"), ("‘a’ “b”", "'a' \"b\""), ("so­ft", "soft"), ("ﬁne ﬂow oﬀ", "fine flow off"), (" a  b\t", "a b"), ("a\x01b", "a b"), (None, "")])
def test_normalize(spark, text, want):
    assert value(spark, T.normalize(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("Foo-Bar 1!", "foobar1"), ("Привет", ""), (None, "")])
def test_compact(spark, text, want):
    assert value(spark, T.compact(F.lit(text).cast("string"))) == want


def test_match_score(spark):
    score = lambda a, b: value(spark, T.match_score(F.lit(a), F.lit(b)))
    assert (score("ab", "ab"), score("abcd", "ab"), score("", "a")) == (1.0, 0.5, 0.0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Hel\nlo W\n\norld"), (2, None), (3, "")], "doc_id long, text string")


def test_exact_anchor_over_items(spark, docs):
    quotes = spark.createDataFrame([(5, "low"), (6, "absent"), (7, "Привет"), (8, None)], "item_id long, text string")
    found = anchors.exact(docs, quotes)
    assert [tuple(r) for r in found.collect()] == [(1, 5, 1, 0, 1, 4)]
    assert [r["text"] for r in anchors.range_text(docs, found).collect()] == ["lo W"]


def test_resolve_falls_back_to_normalized_and_fuzzy(spark):
    docs = spark.createDataFrame([(1, "Привет мир\nи ещё"), (2, "alpha beta gamma delta\nsecond line of the quote text\nend")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "привет  мир"), (2, "alpha beta gammo delta\nsecond line of the quote text")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["start_item"], r["end_item"], r["how"]) for r in anchors.resolve(docs, quotes).collect()} == {(1, 1, 0, 0, "normalized"), (2, 2, 0, 1, "fuzzy")}


def test_fuzzy_finds_what_shares_no_line(spark):
    text = "the quick brown fox jumps over\nthe lazy dog and runs away\ninto the deep dark wood"
    docs = spark.createDataFrame([(1, text), (2, "x\n" * 400 + text.replace("quick", "quack")), (3, None), (4, ""), (5, "nothing of the sort is to be found here")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "the quick brawn fox jumped over the lazy dog and runs away"), (2, "a"), (3, None), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start_item"], r["end_item"]) for r in anchors.fuzzy(docs, quotes).collect()}
    assert {(d, i, a % 400, z % 400) for d, i, a, z in got} == {(1, 1, 0, 1), (2, 1, 0, 1)}


def test_fuzzy_windows_against_brute_force():
    import random
    from collections import Counter

    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abc1") for _ in range(n))
    for _ in range(60):
        items = [word(draw.randint(1, 9)) for _ in range(draw.choice((3, 20, 420)))]
        quotes = [(i, word(draw.randint(2, 40))) for i in range(4)] + [(9, "".join(items[2:6]) or "ab")]
        want = {}
        for item, quote in quotes:
            for a in range(len(items)):
                for z in range(a, min(len(items), a + anchors.SPAN)):
                    window = "".join(items[a : z + 1])
                    if len(window) >= max(12, 0.45 * len(quote)):
                        pairs = [Counter(x[i : i + 2] for i in range(len(x) - 1)) for x in (window, quote)]
                        score = 2.0 * sum((pairs[0] & pairs[1]).values()) / max(len(window) + len(quote) - 2, 1)
                        if score > want.get(item, (0, 0, 0.0))[2]:
                            want[item] = (a, z, score)
                    if len(window) > len(quote) * 1.65 + 24:
                        break
        got = {item: (a, z, score) for group in anchors._grouped(quotes) for item, a, z, score in group.best(items)}
        assert got == {k: v for k, v in want.items() if v[2] >= anchors.ACCEPT}


def test_reanchor(spark):
    current = spark.createDataFrame([(1, 1, 0.95, True), (2, 1, 0.8, True), (3, 1, 0.8, True), (4, 1, 0.5, False)], "doc_id long, item_id long, score double, has_rects boolean")
    new = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.82), (3, 1, 0.9), (4, 1, 0.1), (5, 1, 0.9)], "doc_id long, item_id long, score double")
    assert {r["doc_id"]: r["stands"] for r in anchors.reanchor(current, new).collect()} == {1: "current", 2: "current", 3: "recovered", 4: "recovered", 5: "recovered"}


def test_clip(spark):
    item = spark.createDataFrame([("abcd", 10.0, 5.0, 40.0, 12.0)], "text string, x double, y double, width double, height double")
    assert tuple(item.select(*geometry.clip(F.lit(1), F.lit(3)).values()).first()) == (20.0, 5.0, 20.0, 12.0)
    assert item.select(geometry.clip(F.lit(3), F.lit(3))["x"]).first()[0] is None


def test_intersection_is_strict(spark):
    shape = "g int, i int, x double, y double, width double, height double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0)], shape)
    b = spark.createDataFrame([(1, 7, 17.0, 0.0, 5.0, 10.0), (1, 8, 18.0, 0.0, 5.0, 10.0), (1, 9, 9.0, 500.0, 1.0, 1.0)], shape)
    assert [r["b_id"] for r in geometry.intersecting(a, b, ["g"], ("i", "i")).collect()] == [7]


def test_merge(spark):
    rects = [(1, 0.0, 0.0, 10.0, 12.0), (1, 15.0, 0.0, 10.0, 12.0), (1, 100.0, 0.0, 5.0, 12.0)]
    out = geometry.merge(spark.createDataFrame(rects, "g int, x double, y double, width double, height double"), ["g"])
    assert sorted((r["x"], r["width"]) for r in out.collect()) == [(0.0, 25.0), (100.0, 5.0)]


def test_smoothing_counts(spark):
    points = spark.createDataFrame([(1, k, float(k), float(k * k)) for k in range(4)] + [(2, k, 0.0, 0.0) for k in range(2)], "g int, k int, x double, y double")
    got = geometry.smooth(points, ["g"], "k").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {1: 5 * 4 - 4, 2: 2}


def test_update_ignores_absent_ids(spark):
    rows, changed = (spark.createDataFrame(x, "id string, v int") for x in ([("a", 1), ("b", 2)], [("b", 3), ("z", 4)]))
    assert sorted(map(tuple, annotations.update(rows, changed).collect())) == [("a", 1), ("b", 3)]


def test_cycles_in_trees_end(spark):
    nodes = [("r", None, 0, "k", "A"), ("x", "r", 1, "k", None), ("y", "x", 0, "k", "B"), ("z", "y", 0, "k", None), ("x", "z", 0, "k", None)]
    flat = graph.flatten(spark.createDataFrame(nodes, "id string, parent string, ord long, kind string, attr string")).orderBy("path").collect()
    assert [(r["id"], r["inherited"]) for r in flat] == [("r", "A"), ("x", "A"), ("y", "B"), ("z", "B")]


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "h", "type": "highlight", "pageIndex": 0, "text": "q", "anchorRange": {"start": {"itemIndex": 3, "offset": 2}, "end": {"itemIndex": 4, "offset": 7}}, "rects": [{"x": 1}]},'
        ' {"id": "n", "type": "note", "x": 5, "y": 6, "textAnchor": {"itemIndex": 0.5, "offset": 0}}]')  # fmt: skip
    rows = files.annotations(spark, str(tmp_path / "a.json"))
    got = {r["id"]: r for r in rows.collect()}
    assert got["h"]["anchorRange"]["start"]["itemIndex"] == 3 and got["n"]["textAnchor"] is None and got["n"]["x"] is None
    files.write_annotations(rows, str(tmp_path / "out"))
    back = {r["id"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back["n"]["y"] == 6 and "rects" not in back["h"].asDict()


def test_codecs():
    assert codecs.rle_decode(b"\x02abc\xfez\x80") == b"abczzz"
    assert codecs.a85_decode(b"z~>") == bytes(4)
    assert codecs.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    assert codecs.flate_decode(zlib.compress(b"x" * 99)) == b"x" * 99
    rng = random.Random(4)
    for _ in range(60):
        data = bytes(rng.choices(range(rng.choice([2, 256])), k=rng.choice([0, 1, 300, 9000])))
        assert codecs.lzw_decode(codecs.lzw_encode(data)) == codecs.rle_decode(codecs.rle_encode(data)) == data
        assert codecs.png_decode(codecs.png_encode(data, 7), 7)[: len(data)] == data


def test_hex_pads_right(spark):
    assert bytes(value(spark, codecs.hex_decode(F.lit(b"A B C>")))) == b"\xab\xc0"


@pytest.mark.parametrize("token, want", [("(a(b)c)", "a(b)c"), (r"(\053)", "+"), (r"(\q\))", "q)"), ("<FEFF00410042>", "AB"), ("<80>", "€"), ("(\\\nx)", "x")])
def test_strings(token, want):
    assert pdf.string(token) == want


FONT = {"two_byte": False, "encoding": None, "differences": {}, "unicode": None}


@pytest.mark.parametrize(
    "token, font, want",
    [
        ("<80>", {"encoding": "WinAnsiEncoding"}, "€"), ("<80>", {}, "\x80"), ("<FEFF0041>", {"unicode": {65: "no"}}, "A"),
        ("<0041>", {}, "A"), ("<0102>", {"unicode": {0x102: "ffi"}}, "ffi"), ("<0102>", {"unicode": {1: "x"}}, "x\x02"),
        ("<0102>", {"unicode": {1: "x"}, "two_byte": True}, "\u0102"), ("(ab)", {"differences": {97: "fi"}}, "fib"), ("()", {}, ""),
        ("(a\\\r\nb)", {}, "ab"),
    ],
)
def test_strings_in_fonts(token, font, want):
    assert pdf.string(token, {**FONT, **font}) == want


def test_font_maps():
    chars = b"2 beginbfchar\n<01> <0041>\n<0002> <00660069>\nendbfchar 3 beginbfrange <10> <12> <0061> <20><21>[<0078> <D83DDE00>]\nendbfrange"
    assert fonts.unicode_map(chars) == {1: "A", 2: "fi", 16: "a", 17: "b", 18: "c", 32: "x", 33: "\U0001f600"}
    assert fonts.unicode_map(b"") == {} == fonts.differences("<<>>")
    names = "<</Differences [39 /quotesingle /A 200/sevenoldstyle /Bsmall /uni20AC /fi /nosuchname]>>"
    assert fonts.differences(names) == {39: "'", 40: "A", 200: "7", 201: "b", 202: "€", 203: "fi", 204: "?"}


def test_replay(spark):
    log = [("a", 1, "update", 0.0), ("a", 2, "add", 1.0), ("a", 3, "add", 9.0), ("a", 4, "update", 2.0), ("b", 5, "add", 1.0), ("b", 6, "remove", None), ("c", 7, "add", 5.0)]
    got = annotations.replay(spark.createDataFrame(log, "id string, seq long, action string, state double"))
    assert {r["id"]: (r["state"], r["n_updates"]) for r in got.collect()} == {"a": (2.0, 1), "c": (5.0, 0)}


def test_first_of_equal_ids(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "id string, seq long, text string")
    changed = spark.createDataFrame([("a", 9, "new"), ("c", 9, "new")], "id string, seq long, text string")
    assert sorted(map(tuple, annotations.update(rows, changed).collect())) == [("a", 1, "new"), ("a", 2, "y"), ("b", 3, "z")]
    assert sorted(map(tuple, annotations.remove(rows, changed).collect())) == [("a", 2, "y"), ("b", 3, "z")]


def test_history_has_what_took_effect(spark):
    log = [("a", 1, "update", 0.0), ("a", 2, "add", 1.0), ("a", 3, "add", 9.0), ("a", 4, "remove", None), ("a", 5, "update", 2.0), ("a", 6, "remove", None), ("a", 7, "add", 3.0), ("a", 8, "update", 4.0), ("b", 1, "remove", None)]
    got = annotations.history_entries(spark.createDataFrame(log, "id string, seq long, action string, state double")).orderBy("seq").collect()
    assert [(r["id"], r["seq"], r["before"], r["after"]) for r in got] == [("a", 2, None, 1.0), ("a", 4, 1.0, None), ("a", 7, None, 3.0), ("a", 8, 3.0, 4.0)]


def test_undo_restores_states(spark):
    steps = [("add", "a", 1), ("add", "b", 2), ("update", "a", 3), ("undo", None, None), ("remove", "a", None), ("undo", None, None), ("redo", None, None), ("undo", None, None), ("update", "z", 1), ("add", "b", 5), ("remove", "b", None), ("undo", None, None)]
    log = [(1, k, *s) for k, s in enumerate(steps)] + [(2, 0, "undo", None, None), (3, 0, "add", "a", 1), (3, 1, "undo", None, None), (3, 2, "redo", None, None)]
    got = annotations.restored(spark.createDataFrame(log, "doc long, seq long, action string, id string, state long").repartition(3)).orderBy("doc", "place").collect()
    # a comes back behind b; of the two rows of b the first is removed and comes back at the end
    assert [tuple(r) for r in got] == [(1, 1, "a", 1), (1, 2, "b", 5), (1, 3, "b", 2), (3, 1, "a", 1)]


def test_offsets_in_items_without_a_width(spark):
    items = spark.createDataFrame([("abc", 5.0, 0.0), ("abc", 0.0, 30.0), ("", 0.0, 0.0)], "text string, x double, width double")
    got = items.select(geometry.offset_at(F.lit(12.0), True).alias("a"), geometry.offset_at(F.lit(12.0), False).alias("b")).collect()
    assert [tuple(r) for r in got] == [(0, 3), (1, 2), (0, 0)]


def test_lines(spark):
    got = [value(spark, T.lines(F.lit(x))) for x in ("", "a", "a\n", "a\r\nb\rc\n\nd", "\n", None)]
    assert got == [[], ["a"], ["a"], ["a", "b", "c", "", "d"], [""], []]


def test_failing_filters_are_told(spark):
    rows = spark.createDataFrame([(1, bytearray(b"never deflated")), (2, bytearray(zlib.compress(b"x"))), (3, None)], "id long, data binary")
    got = {r["id"]: r for r in codecs.apply(rows, "data", [codecs.flate_decode], "error").collect()}
    assert bytes(got[1]["data"]) == b"never deflated" and got[1]["error"].startswith("flate_decode") and bytes(got[2]["data"]) == b"x" and got[2]["error"] is None and got[3]["data"] is None


def test_document_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7\n")
    (tmp_path / "b.PDF").write_bytes(b"no")
    (tmp_path / "c.txt").write_bytes(b"%PDF-1.7\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e.pdf").write_bytes(b"%PDF")
    got = {r["path"].rpartition("/")[2]: (r["version"], r["is_valid"]) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("1.7", True), "b.PDF": (None, False), "e.pdf": (None, False)}


def test_only_newer_models_are_anchored_again(spark, tmp_path):
    from folioscan.streaming import refresh

    seen = []

    def recover(docs, quotes):
        seen.append(sorted(r["doc_id"] for r in docs.collect()))
        return anchors.exact(docs, quotes)

    quotes = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    shape, folder = "doc_id long, version int, text string", f"{tmp_path}/anchors"
    for models in ([(1, 1, "The quick\nbrown fox"), (2, 1, "x\nthe quick brown fox"), (3, 1, "none")], [(1, 2, "\nThe quick\nbrown fox"), (1, 1, "gone"), (2, 1, "gone")]):
        spark.createDataFrame(models, shape).write.mode("append").parquet(f"{tmp_path}/models")
        refresh.follow(spark.readStream.schema(shape).parquet(f"{tmp_path}/models"), quotes, folder, recover)
    assert seen == [[1, 2, 3], [1]]
    got = sorted(tuple(r[c] for c in ("doc_id", "version", "start_item", "end_item")) for r in refresh.stored(spark, folder).collect())
    assert got == [(1, 2, 1, 2), (2, 1, 1, 1)]


def test_lzw_codes(spark):
    """Codes as built-in functions make them, at the ends of the blocks that begin with a clear code; the expression writes its bits once."""
    from folioscan.plans import encodings

    texts = [b"", b"a", bytes(range(256)), b"\xff" * 199, b"\x00" * 200, b"ab" * 201, bytes(7 * k % 256 for k in range(1401))]
    rows = spark.createDataFrame([(k, x.hex().upper()) for k, x in enumerate(texts)], "k int, h string").selectExpr("k", f"unhex({encodings.ENCODED['lzw']}) AS data").orderBy("k").collect()
    for text, row in zip(texts, rows, strict=True):
        bits = "".join(("100000000" if k % 200 == 0 else "") + f"{b:09b}" for k, b in enumerate(text)) + "100000001"
        bits += "0" * (-len(bits) % 8)
        assert bytes(row["data"]) == int(bits, 2).to_bytes(len(bits) // 8)
        assert codecs.lzw_decode(bytes(row["data"])) == text
        assert codecs.lzw_decode(bytes(row["data"])[:-2])[: len(text) - 2] == text[: max(0, len(text) - 2)]
    assert encodings.ENCODED["lzw"].count("regexp_extract_all(h") == 1
