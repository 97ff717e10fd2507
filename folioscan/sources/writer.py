"""Page files of several forms, built by Spark alone from documents' lines, for queries that read them back.

A file has a page for each `LINES` lines, four pages to a node of the page tree. Its objects are numbered without gaps:
1 catalog, 2 root of the pages, 3 font, 4 outlines, 5 one of them, 6 form field, 7 empty node, 8 and 10 forms, 9 information,
11 font descriptor, 12 image, 13 its palette, then page and contents by turns from `FIRST` on, then the nodes.

The form goes by the number of the document (null as 0) modulo 4: 0 a table and a later section that replaces object 9;
1 a reference stream, with plain objects in an object stream; 2 a table whose offsets are all wrong; 3 no table at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES, FIRST = 40, 14
#: Widths of the codes 32 to 126.
WIDTHS = " ".join(str(400 + c % 7 * 50) for c in range(32, 127))
HELD = (1, 2, 4, 5, 6, 7, 9, 11, 13)
HEAD = "%PDF-1.5\n"
DRAWN = "q 2 0 0 2 0 0 cm 1 0 0 RG 0.5 g 10 20 30 40 re f 3 w 0 0 m 10 0 l 10 10 l h 5 5 m 6 9 8 9 9 5 c B Q"
FORM = "BT /F9 8 Tf 3 4 Td (form) Tj (!) Tj ET /Fm2 Do"
INNER = "BT /F9 1 Tf 1 1 Td (inner) Tj ET /Fm2 Do"
#: A picture of two by two palette indexes, and the palette's colours.
PICTURE, PALETTE = "00 01 02 01>", "<0A141E 28323C 46505A>"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _stream(entries: str, data: str) -> str:
    return f"<<{entries} /Length {len(data)}>> stream\n{data}\nendstream"


def _object(number: Column, body: Column) -> Column:
    return _text(number, " 0 obj ", body, " endobj\n")


def _offsets(texts: str, start: str) -> str:
    """Where each of an array's texts begins, the first at `start`, and where the last ends."""
    return f"aggregate({texts}, named_struct('at', CAST({start} AS int), 'out', CAST(array() AS array<int>)), (a, x) -> named_struct('at', a.at + length(x), 'out', concat(a.out, array(a.at))), a -> concat(a.out, array(a.at)))"


def files(docs: DataFrame) -> DataFrame:
    """(path, content) of a file for each row of docs (doc_id, text); the path is the document's number."""
    number = F.coalesce(F.col("doc_id"), F.lit(0))
    lines = docs.select(number.alias("doc_id"), (number % 4).alias("form"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    n_pages = F.ceil(F.size("lines") / LINES).cast("int")
    sized = lines.withColumn("pages", n_pages).withColumn("nodes", F.ceil(F.col("pages") / 4).cast("int"))
    shown = F.expr(f"transform(sequence(0, pages - 1), p -> array_join(transform(slice(lines, p * {LINES} + 1, {LINES}), (l, i) -> concat('1 0 0 1 0 ', i * 14, ' Tm <FEFF', hex(encode(l, 'UTF-16BE')), '> Tj (*) Tj')), '\\n'))")
    made = sized.withColumn("shown", shown)
    more = f"CASE p % 3 WHEN 0 THEN ' q 2 0 0 2 10 20 cm /Fm1 Do Q' WHEN 1 THEN ' q 20 0 0 10 5 6 cm /Im1 Do Q' ELSE '' END"
    contents = F.expr(f"transform(shown, (s, p) -> concat('BT /F1 10 Tf\\n', s, '\\nET\\n{DRAWN}', {more}))")
    page = F.expr(f"transform(sequence(0, pages - 1), p -> concat('<</Type /Page /Parent ', {FIRST} + 2 * pages + p DIV 4, ' 0 R', CASE p % 4 WHEN 1 THEN ' /Rotate 90' WHEN 3 THEN ' /Rotate -90' ELSE '' END, ' /Contents ', {FIRST + 1} + 2 * p, ' 0 R>>'))")
    stream = F.expr("transform(contents, c -> concat('<</Length ', length(c), '>> stream\\n', c, '\\nendstream'))")
    node = F.expr(f"transform(sequence(0, nodes - 1), g -> concat('<</Type /Pages /Parent 2 0 R', CASE g % 2 WHEN 0 THEN ' /CropBox [10 20 310 420]' ELSE '' END, ' /Kids [', array_join(transform(sequence(4 * g, least(4 * g + 3, pages - 1)), p -> concat({FIRST} + 2 * p, ' 0 R')), ' '), ']>>'))")
    kids = F.expr(f"array_join(transform(sequence(0, nodes - 1), g -> concat({FIRST} + 2 * pages + g, ' 0 R')), ' ')")
    fixed = [
        F.lit("<</Type /Catalog /Pages 2 0 R /Outlines 4 0 R /AcroForm <</Fields [6 0 R]>>>>"),
        _text("<</Type /Pages /MediaBox [0 0 612 792] /Resources <</Font <</F1 3 0 R>> /XObject <</Fm1 8 0 R /Im1 12 0 R>>>> /Count ", F.col("pages"), " /Kids [", kids, " 7 0 R]>>"),
        F.lit(f"<</Type /Font /Subtype /TrueType /BaseFont /Times-BoldItalic /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 126 /Widths [{WIDTHS}] /FontDescriptor 11 0 R>>"),
        F.lit("<</Type /Outlines /First 5 0 R /Last 5 0 R /Count 1>>"),
        F.lit("<</Title (a \\(nested \\051 title) /Parent 4 0 R /Dest [0 /Fit]>>"),
        F.lit("<</T <6669656C64> /Parent 4 0 R /Kids [] /V null /Ff 0.50>>"),
        F.lit("<</Type /Pages /Parent 2 0 R /Kids []>>"),
        F.lit(_stream("/Type /XObject /Subtype /Form /BBox [0 0 90 90] /Matrix [1 0 0 1 5 5] /Resources <</Font <</F9 3 0 R>> /XObject <</Fm2 10 0 R>>>>", FORM)),
        _text("<</Title (old ", F.col("doc_id"), ")>>"),
        F.lit(_stream("/Subtype /Form /BBox [0 0 9 9] /Matrix [2 0 0 2 0 0]", INNER)),
        F.lit("<</Type /FontDescriptor /MissingWidth 500>>"),
        F.lit(_stream("/Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace [/Indexed /DeviceRGB 2 13 0 R] /Filter /ASCIIHexDecode", PICTURE)),
        F.lit(PALETTE),
    ]
    turns = F.expr("flatten(transform(page, (x, p) -> array(x, stream[p])))")
    bodies = made.withColumns({"contents": contents, "page": page}).withColumn("stream", stream).withColumn("bodies", F.concat(F.array(*fixed), turns, node)).select("doc_id", "form", "bodies")
    objects = bodies.withColumn("texts", F.expr("transform(bodies, (b, k) -> concat(k + 1, ' 0 obj ', b, ' endobj\\n'))"))
    # as a generated row, so that what follows does not repeat the texts
    at = objects.select("doc_id", "form", F.inline(F.array(F.struct("bodies", "texts", F.expr(_offsets("texts", str(len(HEAD)))).alias("at")))))
    plain = F.concat(F.lit(HEAD), F.array_join("texts", ""))
    rows = "array_join(transform(slice(at, 1, size(texts)), o -> concat(lpad(CAST(o + {shift} AS string), 10, '0'), ' 00000 n ')), '\\n')"
    table = lambda shift: _text("xref\n0 ", F.size("texts") + 1, "\n0000000000 65535 f \n", F.expr(rows.format(shift=shift)), "\n")
    end = lambda more, start: _text("trailer\n<</Size ", F.size("texts") + 1, f" /Root 1 0 R /Info 9 0 R{more}", start[0], ">>\nstartxref\n", start[1], "\n%%EOF\n")
    last = F.element_at("at", -1)
    new = _text("9 0 obj <</Title (new ", F.col("doc_id"), ")>> endobj\n")
    whole = F.concat(plain, table(0), end("", ("", last)))
    # the later section's table is where the update's object ends
    first_len = F.length(whole)
    update = F.concat(new, _text("xref\n9 1\n", F.lpad(first_len.cast("string"), 10, "0"), " 00000 n \n"), end(" /Prev ", (last, first_len + F.length(new))))
    held = F.array(*[F.get("bodies", F.lit(k - 1)) for k in HELD])
    packed = at.withColumn("held", held).withColumn("inner", F.expr(_offsets("transform(held, x -> concat(x, ' '))", "0")))
    pairs = F.expr(f"array_join(transform(array({', '.join(map(str, HELD))}), (k, i) -> concat(k, ' ', inner[i])), ' ')")
    told = packed.withColumn("pairs", _text(pairs, " ")).withColumn("inside", F.concat("pairs", F.array_join("held", " ")))
    n = F.size("bodies")
    holder = _text(n + 1, f" 0 obj <</Type /ObjStm /N {len(HELD)} /First ", F.length("pairs"), " /Length ", F.length("inside"), ">> stream\n", F.col("inside"), "\nendstream endobj\n")
    kept = F.expr(f"filter(transform(bodies, (b, k) -> IF(array_contains(array({', '.join(map(str, HELD))}), k + 1), NULL, named_struct('k', k + 1, 't', concat(k + 1, ' 0 obj ', b, ' endobj\\n')))), x -> x IS NOT NULL)")
    streams = told.where("form = 1").withColumn("kept", F.concat(kept, F.array(F.struct((n + 1).alias("k"), holder.alias("t"))))).withColumn("place", F.expr(_offsets("transform(kept, x -> x.t)", str(len(HEAD)))))
    hexed = lambda x, w: f"lpad(hex({x}), {w}, '0')"
    known = F.expr(f"array_join(transform(kept, (x, i) -> concat('01', {hexed('place[i]', 8)}, '0000')), '')")
    within = F.expr(f"array_join(transform(array({', '.join(map(str, HELD))}), (k, i) -> concat('02', {hexed('size(bodies) + 1', 8)}, {hexed('i', 4)})), '')")
    index = F.expr(f"concat('0 1 ', array_join(transform(kept, x -> concat(x.k, ' 1')), ' '), ' ', array_join(transform(array({', '.join(map(str, HELD))}), k -> concat(k, ' 1')), ' '))")
    data = F.concat(F.lit("0000000000FFFF"), known, within, F.lit(">"))
    stream_ref = _text(n + 2, " 0 obj <</Type /XRef /W [1 4 2] /Root 1 0 R /Info 9 0 R /Filter /ASCIIHexDecode /Size ", n + 3, " /Index [", index, "] /Length ", F.length(data), ">> stream\n", data, "\nendstream endobj\nstartxref\n", F.element_at("place", -1) - 3, "\n%%EOF\n")
    compact = streams.select("doc_id", F.concat(F.lit(HEAD), F.array_join(F.expr("transform(kept, x -> x.t)"), ""), stream_ref).alias("file"))
    others = at.where("form <> 1").select("doc_id", F.when(F.col("form") == 0, F.concat(whole, update)).when(F.col("form") == 2, F.concat(plain, new, table(7), end("", ("", last + F.length(new))))).otherwise(F.concat(plain, new)).alias("file"))
    return compact.unionByName(others).select(F.col("doc_id").cast("string").alias("path"), F.encode("file", "ISO-8859-1").alias("content"))
