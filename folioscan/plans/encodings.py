"""Queries of stream filters on data that built-in functions encoded, so that a filter that does nothing is told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import codecs
from folioscan.session import table

# Each is SQL over `h`, the data's hexadecimal digits, and gives the digits of the encoded data.
_BYTES = "regexp_extract_all(h, '..', 0)"
_A85 = "transform(regexp_extract_all(h, '.{1,8}', 0), g -> named_struct('n', length(g) DIV 2, 'v', CAST(conv(rpad(g, 8, '0'), 16, 10) AS bigint)))"
_DIGITS = ", ".join(f"hex(33 + g.v DIV {85 ** (4 - k)} % 85)" for k in range(5))
_ADLER = f"aggregate({_BYTES}, named_struct('a', 1L, 'b', 0L), (s, x) -> named_struct('a', (s.a + CAST(conv(x, 16, 10) AS bigint)) % 65521, 'b', (s.b + s.a + CAST(conv(x, 16, 10) AS bigint)) % 65521), s -> s.b * 65536 + s.a)"
_TURNED = lambda x: f"concat(substring(lpad(hex({x}), 4, '0'), 3, 2), substring(lpad(hex({x}), 4, '0'), 1, 2))"
_STORED = f"array_join(transform(blocks, (b, k) -> concat(IF(k + 1 = size(blocks), '01', '00'), {_TURNED('length(b) DIV 2')}, {_TURNED('65535 - length(b) DIV 2')}, b)), '')"
# bits, seven bytes at a time; then 9 of them for each byte, and a clear code before every 200
_BITS = "array_join(transform(regexp_extract_all(h, '.{1,14}', 0), x -> lpad(conv(x, 16, 2), 4 * length(x), '0')), '')"
_LZW = f"concat(regexp_replace(regexp_replace({_BITS}, '.{{8}}', '0$0'), '.{{1,1800}}', '100000000$0'), '100000001')"
_LZW_BITS = "CAST(8 * ceil(9 * (length(h) DIV 2 + ceil(length(h) / 400) + 1) / 8) AS int)"
_LEFT = "array_join(transform(regexp_extract_all(r, '..', 0), (x, i) -> lpad(hex(pmod(CAST(conv(x, 16, 10) AS int) - IF(i = 0, 0, CAST(conv(substring(r, 2 * i - 1, 2), 16, 10) AS int)), 256)), 2, '0')), '')"
ENCODED = {
    "literal": "concat(array_join(transform(regexp_extract_all(h, '.{1,256}', 0), g -> concat(lpad(hex(length(g) DIV 2 - 1), 2, '0'), g)), ''), '80')",
    "runs": f"concat(array_join(transform({_BYTES}, x -> concat('FF', x)), ''), '80')",
    "ascii85": f"concat(array_join(transform({_A85}, g -> IF(g.n = 4 AND g.v = 0, '7A', array_join(slice(array({_DIGITS}), 1, g.n + 1), ''))), ''), '7E3E')",
    "lzw": f"array_join(transform(regexp_extract_all(rpad({_LZW}, {_LZW_BITS}, '0'), '.{{1,60}}', 0), x -> lpad(conv(x, 2, 16), length(x) DIV 4, '0')), '')",
    # rows of 64 bytes, the last filled up with 0: each byte less the one before it, after a filter's tag or without one
    "png_left": f"array_join(transform(regexp_extract_all(full, '.{{128}}', 0), r -> concat('01', {_LEFT})), '')",
    "tiff": f"array_join(transform(regexp_extract_all(full, '.{{128}}', 0), r -> {_LEFT}), '')",
    "flate": f"concat('7801', {_STORED}, lpad(hex({_ADLER}), 8, '0'))",
}
DECODERS: dict[str, Callable[[bytes], bytes]] = {"literal": codecs.rle_decode, "runs": codecs.rle_decode, "ascii85": codecs.a85_decode, "lzw": codecs.lzw_decode, "flate": codecs.flate_decode, "png_left": lambda x: codecs.png_decode(x, 64), "tiff": lambda x: codecs.tiff_decode(x, 64)}


def _decoded(codec: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        texts = table(spark, sf, "documents").select("doc_id", F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("h"))
        blocks = F.expr("IF(h = '', array(''), regexp_extract_all(h, '.{1,131070}', 0))")
        full = F.expr("rpad(h, CAST(128 * ceil(length(h) / 128) AS int), '0')")
        rows = texts.select("doc_id", "h", blocks.alias("blocks"), full.alias("full")).select("doc_id", F.unhex(F.expr(ENCODED[codec])).alias("data"))
        sized = rows.withColumn("n_encoded", F.octet_length("data").cast("long"))
        back = codecs.apply(sized, "data", [DECODERS[codec]], "error")
        return back.select("doc_id", "n_encoded", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"), "error")

    return query


QUERIES = {f"decoded_{codec}": _decoded(codec) for codec in ENCODED}

_N = "strlen(coalesce(text, ''))"
_LENGTHS = {
    "literal": f"{_N} + (({_N} + 127) // 128) + 1",
    "runs": f"2 * {_N} + 1",
    "ascii85": f"({_N} // 4) * 5 + CASE WHEN {_N} % 4 > 0 THEN {_N} % 4 + 1 ELSE 0 END + 2",
    "lzw": f"(9 * ({_N} + ({_N} + 199) // 200 + 1) + 7) // 8",
    "png_left": f"65 * (({_N} + 63) // 64)",
    "tiff": f"64 * (({_N} + 63) // 64)",
    "flate": f"{_N} + 5 * greatest(1, ({_N} + 65534) // 65535) + 6",
}
_HEX = "hex(coalesce(text, ''))"
_FULL = f"rpad({_HEX}, (128 * (({_N} + 63) // 64))::INTEGER, '0')"
#: The bytes that come back, where they aren't the text's.
_BACK = {"runs": (f"2 * {_N}", f"unhex(regexp_replace({_HEX}, '(..)', '\\1\\1', 'g'))"), **dict.fromkeys(("png_left", "tiff"), (f"64 * (({_N} + 63) // 64)", f"unhex({_FULL})"))}


def _oracle(codec: str) -> str:
    size, back = _BACK.get(codec, (_N, "coalesce(text, '')"))
    return f"SELECT doc_id, ({_LENGTHS[codec]})::BIGINT AS n_encoded, ({size})::BIGINT AS n_bytes, sha256({back}) AS digest, NULL::VARCHAR AS error FROM documents"


ORACLES = {f"decoded_{codec}": _oracle(codec) for codec in ENCODED}
