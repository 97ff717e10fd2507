"""Text functions of quote search as Column expressions: normalization, compaction, similarity.

Offsets and lengths count code points. White space is spelled out, since engines disagree on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space and control characters of quote search, and its replacements.
SPACE = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CONTROL = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}]"
QUOTES = ("‘’“”", "''\"\"")
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"))
SOFT_HYPHEN = "­"


def _respelled(c: Column) -> Column:
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize(text: Column) -> Column:
    """Control characters to spaces, plain quotes, no soft hyphens, broken words joined, ligatures spelled, single spaces, lower case. Null becomes ''."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, " ")
    c = F.replace(F.translate(c, *QUOTES), F.lit(SOFT_HYPHEN), F.lit(""))
    c = _respelled(F.regexp_replace(c, f"-{SPACE}+", ""))
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), "^ | $", ""))


def compact(text: Column) -> Column:
    """normalize(text) without anything but a-z and 0-9."""
    return F.regexp_replace(normalize(text), "[^a-z0-9]+", "")


def compact_chars(text: Column) -> Column:
    """The same for text whose characters are compacted one by one, so that hyphens join nothing."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, "")
    return F.regexp_replace(F.lower(_respelled(c)), "[^a-z0-9]+", "")


def offset_of(text: Column, k: Column) -> Column:
    """Offset in text of the character that gives the k-th (from 0) character of compact_chars(text); null if there is none."""
    sizes = F.transform(F.split(text, ""), lambda c: F.length(compact_chars(c)))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("at"))
    step = lambda a, s: F.struct(
        (a["i"] + 1).alias("i"), (a["n"] + s).alias("n"), F.coalesce(a["at"], F.when(a["n"] + s > k, a["i"])).alias("at")
    )
    return F.aggregate(sizes, start, step, lambda a: a["at"])


def bigrams(c: Column) -> Column:
    """The bigrams of c in order; none below two characters."""
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def _numbered(grams: Column) -> Column:
    """Each bigram with how often it came before, so that common elements of two such arrays are the multiset's."""
    ordered = F.array_sort(grams)
    start = F.struct(F.lit("").alias("g"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, g: Column) -> Column:
        n = F.when(a["g"] == g, a["n"] + 1).otherwise(F.lit(0))
        return F.struct(g.alias("g"), n.alias("n"), F.concat(a["out"], F.array(F.concat(g, n.cast("string")))).alias("out"))

    return F.aggregate(ordered, start, step, lambda a: a["out"])


def dice(a: Column, b: Column) -> Column:
    """2 * common bigrams / all bigrams, with repeats; 0 if either is empty, 1 if they are equal, 0 if either has one character."""
    common = F.size(F.array_intersect(_numbered(bigrams(a)), _numbered(bigrams(b))))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * common / F.greatest(F.length(a) + F.length(b) - 2, F.lit(1)))


def match_score(actual: Column, expected: Column) -> Column:
    """Score of two compact texts: 1 if equal, the ratio of lengths if one holds the other, else Dice; 0 if either is empty."""
    small, large = F.least(F.length(actual), F.length(expected)), F.greatest(F.length(actual), F.length(expected))
    held = F.contains(actual, expected) | F.contains(expected, actual)
    return F.when((actual == "") | (expected == ""), 0.0).when(actual == expected, 1.0).when(held, small / large).otherwise(dice(actual, expected))


def lines(text: Column) -> Column:
    """The lines of a text, which end at a carriage return, a line feed or both; nothing follows the last line's end."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
