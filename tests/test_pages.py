"""Page files written by hand, all read at once: objects, reference sections, page trees, contents, forms, fonts, paths, images."""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.functions import fonts
from folioscan.operators import graph
from folioscan.session import materialize
from folioscan.sources import content, images, pdf, values, xref


def page_file(*objects, contents=b"4 0 R"):
    return b"%PDF-1.5\n1 0 obj <</Type /Pages /Kids [2 0 R]>> endobj\n2 0 obj <</Type /Page /Parent 1 0 R /Contents " + contents + b">> endobj\n" + b"\n".join(objects)


def stream(number, data, more=b"", length=True):
    size = b"/Length %d" % len(data) if length else b"/Length 99 0 R"
    return b"%d 0 obj <<%s %s>> stream\n%s\nendstream endobj" % (number, size, more, data)


def revision(objects, base=b"%PDF-1.4\n", prev=None, shift=0, ends=b"\n", free=(), root=1):
    """A file, or a further revision of one, with a table; and where the table is."""
    out, at = base, {}
    for n, body in objects:
        at[n] = len(out)
        out += b"%d 0 obj %s endobj\n" % (n, body)
    table = len(out)
    out += b"xref" + ends
    for n in sorted({*at, *free}):
        out += b"%d 1" % n + ends + (b"%010d 00000 n" % (at[n] + shift) if n in at else b"0000000000 00001 f") + (b"\r\n" if ends == b"\r\n" else b" \n")
    return out + b"trailer <</Root %d 0 R%s>>\nstartxref\n%d\n%%%%EOF\n" % (root, b" /Prev %d" % prev if prev is not None else b"", table), table


def reference_stream(base, number, objects, held=(), holder=None, prev=None, widths=(1, 3, 1), wrong=0):
    """A further revision with a reference stream, deflated with a predictor."""
    out, at = base, {}
    for n, body in objects:
        at[n] = len(out)
        out += b"%d 0 obj %s endobj\n" % (n, body)
    start = len(out)
    field = lambda v, w: v.to_bytes(w, "big")
    rows = [field(1, widths[0]) + field(at[n], widths[1]) + field(0, widths[2]) for n in sorted(at)]
    rows += [field(2, widths[0]) + field(holder, widths[1]) + field(k, widths[2]) for k, _ in enumerate(held)]
    size = sum(widths)
    table = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, size)
    up = b"".join(b"\x02" + bytes(r) for r in np.diff(table, axis=0, prepend=np.zeros((1, size), np.uint8)))
    index = " ".join(f"{n} 1" for n in [*sorted(at), *held]).encode()
    data = zlib.compress(up)
    more = b"/Prev %d " % prev if prev is not None else b""
    told = b"/Type /XRef /W [%s] /Index [%s] /Size 99 /Root 1 0 R %s/Filter /FlateDecode /DecodeParms <</Predictor 12 /Columns %d>>" % (" ".join(map(str, widths)).encode(), index, more, size)
    return out + stream(number, data, told) + b"\nstartxref\n%d\n%%%%EOF\n" % (start + wrong), start


TREE = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]/Count 1>>"), (3, b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>"), (4, b"<</Length 15>> stream\nBT (old) Tj ET \nendstream")]
NEW = (4, b"<</Length 15>> stream\nBT (new) Tj ET \nendstream")
OLD_FILE, OLD_AT = revision(TREE)
NEW_FILE, NEW_AT = revision([NEW], OLD_FILE, OLD_AT)
MEMBERS = [b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 5 5]>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/MediaBox[0 0 7 7]>>"]
HELD = b"2 0 3 %d " % (len(MEMBERS[0]) + 1)
PACKED = b"<</Type/ObjStm/N 2/First %d/Length %d>> stream\n" % (len(HELD), len(HELD + b" ".join(MEMBERS))) + HELD + b" ".join(MEMBERS) + b"\nendstream"
DEEP = b"(" * 3000 + b"x" + b")" * 3000
PREDICTED = b"BT (predicted) Tj ET".ljust(24)
GRID = np.frombuffer(PREDICTED, np.uint8).reshape(-1, 6)
UP = b"".join(b"\x02" + bytes(r) for r in np.diff(GRID, axis=0, prepend=np.zeros((1, 6), np.uint8)))
LEFT = np.concatenate([GRID[:, :2], GRID[:, 2:] - GRID[:, :-2]], axis=1).tobytes()
PARTS = [stream(4, b"BT (a) T"), stream(5, b"j ET"), stream(6, b"BT (b) Tj"), stream(7, b"(c) Tj ET")]
FLATE = zlib.compress(b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 5 7 Td (up) Tj 0 -3 TD [(a) -100 <62>] TJ T* (n) ' ET Q BT 1 1 Td (end) Tj ET")
FONTS = b"%PDF-1.5\n1 0 obj <</Type /Pages /Kids [2 0 R 3 0 R] /Resources 8 0 R>> endobj\n2 0 obj <</Type /Page /Contents 4 0 R>> endobj\n"
FONTS += b"3 0 obj <</Type /Page /Resources <</Font <</F1 6 0 R>>>> /Contents 4 0 R>> endobj\n8 0 obj <</Font 9 0 R>> endobj\n9 0 obj <</F1 5 0 R>> endobj\n"
FONTS += b"5 0 obj <</Type /Font /ToUnicode 7 0 R>> endobj\n6 0 obj <</Type /Font /Encoding 10 0 R>> endobj\n10 0 obj <</Differences [97 /bullet]>> endobj\n"
FONTS += stream(4, b"BT /F1 1 Tf (abc) Tj /F2 1 Tf (abc) Tj ET") + b"\n" + stream(7, b"beginbfchar <61> <0078> endbfchar")
NESTED = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 100 0 R/Outlines 90 0 R>> endobj\n90 0 obj <</First 91 0 R/Count 1>> endobj\n91 0 obj <</Title (x)/Parent 90 0 R>> endobj\n"
NESTED += b"92 0 obj <</T (field)/Parent 93 0 R/Kids [94 0 R]>> endobj\n94 0 obj <</Parent 92 0 R>> endobj\n95 0 obj <</Type/Pages/Parent 100 0 R/Kids []>> endobj\n"
NESTED += b"100 0 obj <</Kids [101 0 R 95 0 R]/MediaBox [0 0 10 20]/Rotate 90>> endobj\n"
NESTED += b"".join(b"%d 0 obj <</Type/Pages/Parent %d 0 R/Kids [%d 0 R]%s>> endobj\n" % (100 + k, 99 + k, 101 + k, b"/CropBox [1 2 4 8]" if k == 30 else b"") for k in range(1, 80))
NESTED += b"180 0 obj <</Parent 179 0 R/Rotate -180/Contents []>> endobj\n"
SCANNED = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids []/MediaBox 8 0 R>> endobj\n7 0 obj <</Type/Page/Parent 6 0 R>> endobj\n"
SCANNED += b"5 0 obj <</Type/Page/Parent 6 0 R/MediaBox [0 0 1 1]>> endobj\n6 0 obj <</Type/Pages/Parent 2 0 R/CropBox [0 0 2 3]/Kids [2 0 R]>> endobj\n8 0 obj [0 0 9 9] endobj\n"
CYCLE = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids [3 0 R 4 0 R 4 0 R]>> endobj\n3 0 obj <</Type/Pages/Kids [2 0 R 4 0 R]>> endobj\n4 0 obj <</Type/Page>> endobj\n"
FORMS = page_file(
    stream(4, b"BT /F1 10 Tf (AB) Tj ET q 1 0 0 1 100 0 cm /Fa Do Q BT (C) Tj ET"),
    stream(5, b"BT (in) Tj ET /Fb Do", b"/Subtype /Form /Matrix [2 0 0 2 0 0] /Resources <</XObject <</Fb 6 0 R>> /Font <</F1 8 0 R>>>>"),
    stream(6, b"BT /F1 5 Tf 1 1 Td (ABx) Tj (y) Tj ET /Fb Do /Fa Do", b"/Subtype /Form"),
    b"7 0 obj <</Type /Font /FirstChar 65 /Widths [500 9 0 R]>> endobj",
    b"8 0 obj <</Type /Font /FirstChar 65 /Widths 9 0 R /FontDescriptor <</MissingWidth 100>>>> endobj",
    b"9 0 obj [1000 2000] endobj",
).replace(b"/Kids [2 0 R]", b"/Kids [2 0 R] /Resources <</XObject <</Fa 5 0 R>> /Font <</F1 7 0 R>>>>")
CID = page_file(
    stream(4, b"BT /F1 10 Tf <000100020009> Tj (z) Tj /F2 10 Tf (ab) Tj (c) Tj ET"),
    b"5 0 obj <</Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R]>> endobj\n6 0 obj <</DW 300 /W [1 [100 200] 5 8 700]>> endobj",
).replace(b"/Kids [2 0 R]", b"/Kids [2 0 R] /Resources <</Font <</F1 5 0 R /F2 <</FirstChar 97 /Widths [1000]>>>>>>")
DRAWN = page_file(stream(4, b"2 0 0 2 1 1 cm 0 0 m 4 0 l 4 3 l s 1 0 0 rg 5 5 m 5 9 9 9 9 5 c 1 1 1 1 re W n 0 0 0 1 K q 7 w 0 0 2 2 re 5 5 1 1 re B* Q 1 0 m 2 2 3 0 v S 1 0 m 2 2 3 0 y f 3 l h f"))
PIXELS = [
    stream(20, bytes([0, 100, 255, 7]), b"/Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceGray"),
    stream(21, bytes(range(12)), b"/Subtype /Image /Width 2 /Height 2"),
    stream(22, bytes([0, 0, 0, 0, 255, 51, 0, 128]), b"/Subtype /Image /Width 2 /Height 1 /ColorSpace [/ICCBased 23 0 R]"),
    stream(23, b"profile", b"/N 4"),
    stream(24, bytes([1, 0, 2, 3]), b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace [/Indexed /DeviceRGB 2 <010203 040506>]"),
    stream(25, bytes([1, 0]), b"/Subtype /Image /Width 2 /Height 1 /ColorSpace [/Indexed [/ICCBased 26 0 R] 1 27 0 R]"),
    stream(26, b"gray", b"/N 1"),
    stream(27, zlib.compress(bytes([9, 8])), b"/Filter /FlateDecode"),
    stream(28, b"\xff\xd8jpeg", b"/Subtype /Image /Width 2 /Height 1 /Filter [/DCTDecode]"),
    stream(29, bytes(3), b"/Subtype /Image /Width 2 /Height 1"),
    stream(30, bytes(9), b"/Subtype /Image /Width 2 /Height 1 /BitsPerComponent 1 /ColorSpace /DeviceGray"),
    stream(31, b"not deflated", b"/Subtype /Image /Width 2 /Height 2 /Filter /FlateDecode"),
]
FILES = {
    "tree": b"%PDF-1.5\n9 0 obj <</Type /Pages /Kids [8 0 R 7 0 R] /MediaBox [0 0 10 20]>> endobj\n8 0 obj <</Type /Pages /Parent 9 0 R /Kids [6 0 R]>> endobj\n"
    b"6 0 obj <</Type /Page /Parent 8 0 R /Contents 5 0 R>> endobj\n7 0 obj <</Type /Page /Parent 9 0 R /MediaBox [0 0 1 1] /Contents 4 0 R>> endobj\n"
    b"4 0 obj <<>> stream\nBT (old) Tj ET\nendstream endobj\n4 0 obj <<>> stream\nBT (new) Tj ET\nendstream endobj\n"
    b"5 0 obj <</Filter [/FlateDecode]>> stream\n" + FLATE + b"\nendstream endobj\n",
    "two parts": page_file(*PARTS, contents=b"[6 0 R 7 0 R]"),
    "array of parts": page_file(*PARTS, b"8 0 obj [7 0 R 6 0 R] endobj", contents=b"8 0 R"),
    "cut token": page_file(*PARTS, contents=b"[4 0 R 5 0 R]"),
    "absent part": page_file(*PARTS, contents=b"[40 0 R 6 0 R]"),
    "strings": page_file(stream(4, b"BT (a(b(c)d(e)f)g) Tj % (comment) Tj\n(\\)\\() Tj " + DEEP + b" Tj (" + b"y" * 50000 + b") Tj ET")),
    "inline image": page_file(stream(4, b"BI /W 1 /H 1 ID (no) Tj EI BT 1.2.3 2-3 Td (in) Tj (open")),
    "told length": page_file(stream(4, b"BT (endstream endobj 9 0 obj) Tj ET")),
    "length by reference": page_file(stream(4, b"BT (n) Tj ET", length=False)),
    "length in an object": page_file(b"4 0 obj <</Length 9 0 R>> stream\nBT (endstream endobj 9 0 obj) Tj ET\nendstream endobj\n9 0 obj 35 endobj"),
    "wrong length": page_file(b"4 0 obj <</Length 3>> stream\r\nBT (wrong length) Tj ET\r\nendstream"),
    "empty": b"",
    "no objects": b"no objects",
    "png": page_file(stream(4, zlib.compress(UP), b"/Filter /FlateDecode /DecodeParms <</Predictor 12 /Columns 6>>")),
    "tiff": page_file(stream(4, zlib.compress(LEFT).hex().encode() + b">", b"/Filter [/AHx /Fl] /DecodeParms [null <</Predictor 2 /Columns 3 /Colors 2>>]")),
    "bad filter": page_file(stream(4, b"BT (as it is) Tj ET", b"/Filter /FlateDecode")),
    "object stream": b"%PDF-1.5\n" + stream(3, zlib.compress(HELD.replace(b"2 0 3", b"1 0 2") + b" ".join(MEMBERS).replace(b"2 0 R", b"1 0 R").replace(b"3 0 R", b"2 0 R")), b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % len(HELD)) + b"\n" + stream(4, b"BT (held) Tj ET"),
    "fonts": FONTS,
    "revised": NEW_FILE,
    "old after new": NEW_FILE + b"4 0 obj <<>> stream\nBT (stray) Tj ET\nendstream endobj\n" + b"startxref\n%d\n%%%%EOF" % NEW_AT,
    "shifted table": revision(TREE, shift=5)[0],
    "table lines": revision(TREE, ends=b"\r\n")[0],
    "near offset": OLD_FILE.replace(b"startxref\n%d" % OLD_AT, b"startxref\n%d" % (OLD_AT + 60)),
    "far offset": OLD_FILE.replace(b"startxref\n%d" % OLD_AT, b"startxref\n%d" % (OLD_AT - 300)),
    "circle": revision([NEW], OLD_FILE, len(revision([NEW], OLD_FILE, 0)[0]) and revision([NEW], OLD_FILE, 0)[1])[0],
    "no trailer": OLD_FILE.replace(b"trailer <<", b"trail <<"),
    "streamed": reference_stream(NEW_FILE, 50, [(10, PACKED)], held=(2, 3), holder=10, prev=NEW_AT, wrong=-3)[0],
    "wide fields": reference_stream(OLD_FILE, 50, [NEW], prev=OLD_AT, widths=(1, 8, 2))[0],
    "wrong member": reference_stream(NEW_FILE, 50, [(10, PACKED)], held=(3, 2), holder=10, prev=NEW_AT)[0],
    "freed": revision([(9, b"<<>>")], OLD_FILE, OLD_AT, free=(3,))[0],
    "nested": NESTED,
    "scanned": SCANNED,
    "cycle": CYCLE,
    "forms": FORMS,
    "composite": CID,
    "drawn": DRAWN,
    "images": page_file(stream(4, b"q 3 0 0 4 1 2 cm /Im Do Q /No Do"), *PIXELS).replace(b"/Kids [2 0 R]", b"/Kids [2 0 R] /Resources <</XObject <</Im 21 0 R>>>>"),
    "values": b"%PDF-1.7\n1 0 obj <</A[1 2 3 0 R(x)]/B<</C/N#20m/D 1.50/C /last>>/E true/F null/G -/Ref 5 0 R/S(s\\051)>> endobj 2 0 obj " + b"[" * 500 + b" endobj 3 0 obj <</Open [1 2 endobj 4 0 obj 7 endobj",
}


@pytest.fixture(scope="module")
def survey(spark):
    return materialize(xref.survey(spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()] + [("null", None)], "path string, content binary").repartition(4)), "survey")


@pytest.fixture(scope="module")
def found(survey):
    return materialize(xref.objects(survey), "objects")


@pytest.fixture(scope="module")
def pages(survey, found):
    return materialize(pdf.pages(found, xref.trailers(survey)), "pages")


@pytest.fixture(scope="module")
def rows(found, pages):
    return pdf.page_rows(found, pages).orderBy("path", "page_index", "kind", "seq", "subpath").collect()


@pytest.fixture(scope="module")
def texts(rows):
    out: dict[str, list[str]] = {k: [] for k in FILES}
    for r in rows:
        if r["kind"] == "text":
            out[r["path"]].append(r["text"])
    return out


@pytest.fixture(scope="module")
def tree(pages):
    out: dict[str, list] = {k: [] for k in FILES}
    for r in pages.orderBy("path", "page_index").collect():
        out[r["path"]].append(r)
    return out


@pytest.mark.parametrize(
    "name, want",
    [
        ("tree", ["up", "a", "b", "n", "end", "new"]), ("two parts", ["b", "c"]), ("array of parts", ["c", "b"]), ("cut token", []), ("absent part", ["b"]),
        ("strings", ["a(b(c)d(e)f)g", ")(", DEEP[1:-1].decode(), "y" * 50000]), ("inline image", ["in"]), ("told length", ["endstream endobj 9 0 obj"]),
        ("length by reference", ["n"]), ("length in an object", ["endstream endobj 9 0 obj"]), ("wrong length", ["wrong length"]), ("empty", []), ("no objects", []), ("png", ["predicted"]), ("tiff", ["predicted"]),
        ("bad filter", ["as it is"]), ("object stream", ["held"]), ("fonts", ["xbc", "abc", "•bc", "abc"]), ("revised", ["new"]), ("old after new", ["new"]),
        ("shifted table", ["old"]), ("table lines", ["old"]), ("near offset", ["old"]), ("far offset", ["old"]), ("circle", ["new"]), ("no trailer", ["old"]),
        ("streamed", ["new"]), ("wide fields", ["new"]), ("wrong member", ["new"]), ("freed", ["old"]), ("scanned", []),
    ],
)
def test_texts(texts, name, want):
    assert texts[name] == want


def test_places_of_texts(rows):
    got = [(r["page_index"], r["text"], round(r["x"], 3), round(r["y"], 3)) for r in rows if r["path"] == "tree"]
    assert got == [(0, "up", 10.0, 14.0), (0, "a", 10.0, 8.0), (0, "b", 24.0, 8.0), (0, "n", 10.0, -4.0), (0, "end", 1.0, 1.0), (1, "new", 0.0, 0.0)]


def test_sections_are_followed_to_the_oldest(survey):
    at = {}
    for r in xref.chain(survey).orderBy("path", "rank").collect():
        at.setdefault(r["path"], []).append(r["at"])
    assert at["revised"] == [NEW_AT, OLD_AT] and at["near offset"] == [OLD_AT] and "far offset" not in at and "empty" not in at and "tree" not in at
    assert len(at["circle"]) == 1 and len(at["streamed"]) == 3 and at["streamed"][1:] == [NEW_AT, OLD_AT]


def test_objects_say_how_they_were_found(found):
    how: dict[str, dict[int, str]] = {}
    for r in found.select("path", "obj", "how").collect():
        how.setdefault(r["path"], {})[r["obj"]] = r["how"]
    assert set(how["revised"].values()) == {"table"} and how["old after new"][4] == "table" and set(how["shifted table"].values()) == {"scan"}
    assert how["streamed"] == {1: "table", 2: "member", 3: "member", 4: "table", 10: "table", 50: "scan"}
    assert how["wrong member"][2] == "table" or how["wrong member"][2] == "scan"
    assert how["freed"][3] == "scan" and set(how["table lines"].values()) == {"table"}


def test_members_replace_older_objects(tree):
    assert [(r["obj"], r["media_box"]) for r in tree["streamed"]] == [(3, "0 0 7 7")]
    assert [(r["obj"], r["media_box"]) for r in tree["tree"]] == [(6, "0 0 10 20"), (7, "0 0 1 1")]


def test_entries(survey):
    rows = {(r["path"], r["obj"]): r for r in xref.entries(survey).collect()}
    assert rows["wide fields", 4]["offset"] == len(OLD_FILE) and rows["streamed", 3]["holder"] == 10 and rows["streamed", 3]["index"] == 1
    assert not rows["freed", 3]["in_use"] and rows["freed", 3]["gen"] == 1 and rows["revised", 4]["offset"] > OLD_AT


def test_page_trees(tree):
    assert [(r["obj"], r["media_box"], r["crop_box"], r["rotate"], r["width"], r["height"]) for r in tree["nested"]] == [(180, "0 0 10 20", "1 2 4 8", 180, 3.0, 6.0)]
    assert [(r["obj"], r["width"], r["height"]) for r in tree["scanned"]] == [(5, 2.0, 3.0), (7, 2.0, 3.0)]
    assert [r["media_box"] for r in tree["scanned"]] == ["0 0 1 1", "0 0 9 9"]
    assert [r["obj"] for r in tree["cycle"]] == [4, 4, 4]


def test_a_deep_tree_takes_few_rounds(spark, monkeypatch):
    written = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: (written.append(label), plain(df, label))[1])
    nodes = [("n0", None, 0, "k", "A")] + [(f"n{k}", f"n{k - 1}", 0, "k", "B" if k == 7 else None) for k in range(1, 300)]
    flat = {r["id"]: r for r in graph.flatten(spark.createDataFrame(nodes, "id string, parent string, ord long, kind string, attr string")).collect()}
    assert len(flat) == 300 and len(flat["n299"]["path"]) == 300 and flat["n299"]["inherited"] == "B" and flat["n6"]["inherited"] == "A" and len(written) <= 11


def test_forms_stand_where_they_are_painted(rows):
    got = [(r["text"], round(r["x"], 3), round(r["y"], 3), round(r["width"], 3)) for r in rows if r["path"] == "forms" and r["kind"] == "text"]
    # the page's A is 500 wide, its B a reference that isn't followed; in the form A is 1000, B 2000 and others 100
    assert [g[0] for g in got] == ["AB", "in", "ABx", "y", "C"]
    assert got[1][1:3] == (100.0, 0.0) and got[2][1:3] == (102.0, 2.0) and got[2][3] == 31.0 and got[3][1] == 133.0 and got[4][1:3] == (0.0, 0.0)


def test_widths_of_composite_and_inline_fonts(rows):
    got = [round(r["x"], 3) for r in rows if r["path"] == "composite" and r["kind"] == "text"]
    assert got == [0.0, 6.0, 9.0, 19.0]


def test_subpaths(rows):
    got = [r for r in rows if r["path"] == "drawn" and r["kind"] == "path"]
    box = lambda r: tuple(round(r[c], 3) for c in ("x", "y", "width", "height"))
    assert [(r["seq"], r["subpath"], r["segments"], r["closed"], r["fill"], r["stroke"]) for r in got] == [
        (0, 0, 2, True, None, True), (1, 0, 3, True, "evenodd", True), (1, 1, 3, True, "evenodd", True), (2, 0, 1, False, None, True), (3, 0, 1, False, "nonzero", False),
    ]
    assert box(got[0]) == (1.0, 1.0, 8.0, 6.0) and box(got[1]) == (1.0, 1.0, 4.0, 4.0) and got[1]["line_width"] == 7.0 and got[3]["line_width"] == 1.0
    assert got[1]["fill_color"] == [1.0, 0.0, 0.0] and got[1]["stroke_color"] == [0.0, 0.0, 0.0, 1.0]
    curve = [(0, 0), (1, 5), (-2, 3), (4, 1)]
    want = [(1 - t) ** 3 * curve[0][0] + 3 * (1 - t) ** 2 * t * curve[1][0] + 3 * (1 - t) * t * t * curve[2][0] + t**3 * curve[3][0] for t in np.linspace(0, 1, 20001)]
    assert np.allclose(content.curve_range([p[0] for p in curve]), (min(want), max(want)), atol=1e-6)


def test_images(found, pages, spark):
    told = materialize(images.described(found), "images")
    about = {r["obj"]: r for r in told.where("path = 'images'").collect()}
    got = {r["obj"]: r for r in images.pixels(told).where("path = 'images'").collect()}
    rgba = lambda k: list(bytes(got[k]["rgba"]))
    assert rgba(20) == [v for g in (0, 100, 255, 7) for v in (g, g, g, 255)]
    assert rgba(21) == [v for k in range(4) for v in (3 * k, 3 * k + 1, 3 * k + 2, 255)]
    k = 1 - 128 / 255
    assert rgba(22) == [255, 255, 255, 255, math.floor(0.5), math.floor(255 * (1 - 51 / 255) * k + 0.5), math.floor(255 * k + 0.5), 255]
    assert rgba(24) == [4, 5, 6, 255, 1, 2, 3, 255, 0, 0, 0, 255, 0, 0, 0, 255]
    assert rgba(25) == [8, 8, 8, 255, 9, 9, 9, 255]
    assert {n: got[n]["problem"] for n in (28, 29, 30)} == {28: "encoded as image/jpeg", 29: "too short", 30: "1 bits"} and got[31]["problem"].startswith("FlateDecode")
    assert about[25]["mode"] == "indexed" and about[25]["base"] == "gray" and about[22]["mode"] == "cmyk" and about[28]["filters"] == ["DCTDecode"]


def test_placed_images(rows, found, pages, spark):
    placed = spark.createDataFrame([r for r in rows if r["path"] == "images" and r["kind"] == "placed"], content.OUT)
    assert [(r["obj"], r["x"], r["y"], r["width"], r["height"]) for r in images.placed(placed, pages, found).collect()] == [(21, 1.0, 2.0, 3.0, 4.0)]


def test_values_and_accessors(found):
    v = F.col("value")
    get = [
        values.number(v, "$.A[0]").alias("n"), values.number(v, "$.A[3]", -1.0).alias("not_n"), values.number(v, "$.E", -1.0).alias("bool"), values.ref(v, "$.A[2]").alias("ref"), values.ref(v, "$.A[3]").alias("no_ref"),
        values.string(v, "$.A[3]").alias("string"), values.name(v, "$.B.C").alias("name"), values.string(v, "$.B.C").alias("name_too"), values.name(v, "$.S", "-").alias("no_name"), values.string(v, "$.S").alias("escaped"),
        F.size(values.array(v, "$.A")).alias("items"), F.size(values.array(v, "$.B")).alias("no_items"), F.map_keys(values.dictionary(v, "$.B")).alias("keys"), values.has(v, "$.F").alias("null"), values.has(v, "$.E").alias("there"), values.has(v, "$.Z").alias("absent"),
    ]
    rows = {r["obj"]: r for r in found.where("path = 'values'").select("obj", "error", F.to_json("value").alias("json"), *get).collect()}
    r = rows[1]
    assert (r["n"], r["not_n"], r["bool"], r["ref"], r["no_ref"], r["string"], r["name"], r["name_too"], r["no_name"], r["escaped"]) == (1.0, -1.0, -1.0, 3, None, "x", "last", "last", "-", "s)")
    assert (r["items"], r["no_items"], sorted(r["keys"]), r["null"], r["there"], r["absent"]) == (4, 0, ["C", "D"], False, True, False)
    assert json.loads(rows[1]["json"])["G"] is None and rows[2]["json"] is None and "deeper" in rows[2]["error"]
    assert json.loads(rows[3]["json"]) == {"Open": [1, 2]} and rows[3]["error"] == "a value is not closed" and rows[4]["json"] == "7"


@pytest.mark.parametrize(
    "data, want",
    [
        (b"<</A 1/B[1 0 R 2 3 4 0 R 5]/F true>> x", {"A": 1, "B": ["1 0 R", 2, 3, "4 0 R", 5], "F": True}), (b"12 0 R", "12 0 R"), (b"5 6 7", 5), (b"[1 2 3 R]", [1, "2 3 R"]), (b"(open", "(open"),
        (b"[- 1.2.3 .5 +7 word]", [None, 1.2, 0.5, 7, "!word"]), (b"<< 5 /A 6 0 R /B >>", {"A": "6 0 R", "B": None}), (b"<4G>", "(@"), (b"<abc>", "(\xab\xc0"), (b"(\\053\\q\\\n)", "(+q"), (b"% c\n/N", "/N"),
    ],
)
def test_values(data, want):
    text, _, error = values.value(data)
    assert json.loads(text) == want and error is None


def test_ways_along_references(spark):
    edges = spark.createDataFrame([("a", "x", "b"), ("b", "y", "c"), ("c", "up", "a"), ("a", "z", "c")], "src string, label string, dst string")
    roots = spark.createDataFrame([("a", "a")], "root string, node string")
    got = sorted(("/".join(r["trail"]), r["node"], r["again"]) for r in graph.reachable(edges, roots).collect())
    assert got == [("", "a", False), ("x", "b", False), ("x/y", "c", False), ("x/y/up", "a", True), ("z", "c", False), ("z/up", "a", True)]
    assert {len(r["trail"]) for r in graph.reachable(edges, roots, 1).collect()} == {0, 1}


def test_content_lexing():
    assert list(pdf._lexed(b"/A#20B 1.2.3 1-2 -.5 gs [(x)-3 true]TJ")) == [("gs", ["/A B", "1.2", "1", "-.5"]), ("TJ", ["[", "(x)", "-3", "true", "]"])]
    assert list(pdf._lexed(b"")) == list(pdf._lexed(b"(")) == list(pdf._lexed(b") > % x")) == []


def test_width_runs():
    assert fonts.width_runs([1, [100, 200], 5, 8, 700, "/x", 9]) == [(1, 2, [100.0, 200.0]), (5, 8, [700.0])]
    font = {"widths": [{"lo": 1, "hi": 2, "w": [100.0, 200.0]}, {"lo": 5, "hi": 8, "w": [700.0]}], "missing": 50.0}
    assert [fonts.width(c, dict(font)) for c in (1, 2, 3, 5, 8, 9)] == [100.0, 200.0, 50.0, 700.0, 700.0, 50.0]


def test_summary(survey, found):
    got = {r["path"]: r for r in pdf.summary(survey, found, xref.trailers(survey)).collect()}
    assert got["revised"]["version"] == "1.4" and got["revised"]["page_count"] == 1 and got["revised"]["catalog"] == 1 and got["revised"]["error"] is None
    assert got["empty"]["error"] == "no header" and got["tree"]["error"] == "no catalog"


@pytest.mark.parametrize("kind", content.KINDS)
def test_kinds(found, pages, rows, kind):
    """The rows of one kind are those that all operators give, and come of this kind's operators alone."""
    got = pdf.page_rows(found, pages, (kind,)).orderBy("path", "page_index", "kind", "seq", "subpath").collect()
    assert got == [r for r in rows if r["kind"] == kind] and got
    assert not content.operators_of(("placed",)) & {"Tj", "re"}


def test_survey_without_streams(spark):
    """Where contents aren't asked for they stay in the files, and objects are the same but for them; no survey is left."""
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary")
    data = {(r["path"], r["at"]): bytes(r["data"]) for r in xref.survey(files, streams=False).where("kind = 'object' AND data IS NOT NULL").collect()}
    whole = {(r["path"], r["at"]): r for r in xref.survey(files).where("kind = 'object' AND data IS NOT NULL").withColumn("type", values.name(F.col("value"), "$.Type", None)).collect()}
    assert data == {k: bytes(r["data"]) if r["type"] in ("XRef", "ObjStm") else b"" for k, r in whole.items()} and b"" in data.values()
    told = lambda df: {(r["path"], r["obj"], r["how"], r["value"], r["there"]) for r in df.select("path", "obj", "how", F.to_json("value").alias("value"), F.col("stream").isNotNull().alias("there")).collect()}
    slim, trailers = xref.tables(files, streams=False)
    assert told(slim) == told(pdf.objects(files)) and trailers.count()


def test_plain_numbers():
    """Arrays of plain whole numbers are read at once, and others as before."""
    assert list(values.tokens(b"[1 02]3", 0, True)) == [("numbers", "[1,2]", 6), ("number", 3, 7)]
    for data, want in ((b"[1 02\n3]", "[1,2,3]"), (b"[ ]", "[]"), (b"[1 2 0 R]", '[1,"2 0 R"]'), (b"[1.5 2]", "[1.5,2]"), (b"<</W [1 4 2] /X 5>>", '{"W":[1,4,2],"X":5}'), (b"[1 [2 3] 4]", "[1,[2,3],4]"), (b"[1234567890123456789]", "[1.2345678901234568e+18]")):
        assert values.value(data)[0] == want
