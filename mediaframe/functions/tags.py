"""Four-character codes, as little-endian numbers and as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PLAIN = "[A-Za-z0-9 ._-]"


def number(tag: Column) -> Column:
    """The number of a code of four ASCII characters; NULL for other lengths."""
    places = [F.ascii(F.substring(tag, i, 1)).cast("long") * (1 << 8 * (i - 1)) for i in range(1, 5)]
    return F.when(F.char_length(tag) == 4, places[0] + places[1] + places[2] + places[3])


def text(tag: Column) -> Column:
    """The characters of a code; any other than letters, digits, space, dot, dash and underscore as its number in brackets."""
    byte = lambda i: F.shiftright(tag, 8 * i).bitwiseAND(255)
    shown = lambda c: F.when(F.chr(c).rlike(f"^{PLAIN}$"), F.chr(c)).otherwise(F.concat(F.lit("["), c.cast("string"), F.lit("]")))
    return F.concat(*[shown(byte(i)) for i in range(4)])
