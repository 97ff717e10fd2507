"""Colours as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(share: Column) -> Column:
    """Halves go up, as far as a byte."""
    return F.floor(share * 255 + 0.5).cast("int")


def css(parts: Column) -> Column:
    """rgb(...) of one (gray), three (RGB) or four (CMYK) components from 0 to 1; black for any other number."""
    at = lambda k: F.get(parts, F.lit(k - 1))
    rgb = lambda *c: F.concat(F.lit("rgb("), F.concat_ws(", ", *[x.cast("string") for x in c]), F.lit(")"))
    ink = [F.floor(255 * (1 - at(k)) * (1 - at(4)) + 0.5).cast("int") for k in (1, 2, 3)]
    return F.when(F.size(parts) == 1, rgb(*[_byte(at(1))] * 3)).when(F.size(parts) == 3, rgb(*[_byte(at(k)) for k in (1, 2, 3)])).when(F.size(parts) == 4, rgb(*ink)).otherwise("black")


def _number(color: Column) -> Column:
    digits = F.replace(color, F.lit("#"), F.lit(""))
    six = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(F.rpad(digits, 6, "0"))
    return F.when(six.rlike("^[0-9A-Fa-f]{6}$"), F.conv(six, 16, 10).cast("int"))


def channels(color: Column) -> list[Column]:
    """Red, green and blue of #rgb or #rrggbb (short values are filled up with 0); null if it isn't one."""
    n = _number(color)
    return [F.shiftright(n, k).bitwiseAND(F.lit(255)) for k in (16, 8, 0)]


def rgba(color: Column, alpha: float, default: str = "#fbbf24") -> Column:
    parts = [F.coalesce(c, d).cast("string") for c, d in zip(channels(color), channels(F.lit(default)), strict=True)]
    return F.concat(F.lit("rgba("), F.concat_ws(", ", *parts, F.lit(f"{alpha:g}")), F.lit(")"))


def brightened(color: Column, amount: int) -> Column:
    """The colour with amount added to each channel, from 0 to 255."""
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c + amount))), 2, "0")) for c in channels(color)])
