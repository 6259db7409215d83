"""Sample formats and the casts between them, as columns.

Samples are SMALLINT (u8, s16), INT (s32), BIGINT (s64), FLOAT (flt) or DOUBLE (dbl). A float is rounded with halves to even;
to 8 and 16 bits it first wraps to 32 bits, so that overdriven values wrap before they clip.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bytes of a sample.
SIZES = {"u8": 1, "s16": 2, "s32": 4, "s64": 8, "flt": 4, "dbl": 8}
BITS = {"u8": 8, "s16": 16, "s32": 32, "s64": 64}
TYPES = {"u8": "int", "s16": "int", "s32": "int", "s64": "bigint", "flt": "float", "dbl": "double"}
PLANAR = {f: f"{f}p" for f in SIZES}


def packed(name: str) -> str:
    base = name[:-1] if name.endswith("p") and name[:-1] in SIZES else name
    if base not in SIZES:
        raise ValueError(f"unknown sample format {name!r}")
    return base


def silence(name: str) -> int:
    return 0x80 if packed(name) == "u8" else 0


def cast(v: Column, source: str, target: str) -> Column:
    """The sample in another format."""
    source, target = packed(source), packed(target)
    if source == target:
        return v.cast(TYPES[target])
    if source in BITS and target in BITS:
        wide = v.cast("bigint") - (128 if source == "u8" else 0)
        shift = BITS[target] - BITS[source]
        moved = F.shiftleft(wide, shift) if shift >= 0 else F.shiftright(wide, -shift)
        return (moved + (128 if target == "u8" else 0)).cast(TYPES[target])
    if source in BITS:
        centred = v.cast("bigint") - (128 if source == "u8" else 0)
        scale = F.lit(2.0 ** -(BITS[source] - 1))
        if target == "dbl":
            return centred.cast("double") * scale
        return centred.cast("float") * scale.cast("float")
    if target in ("flt", "dbl"):
        return v.cast(TYPES[target])
    scale = F.lit(2.0 ** (BITS[target] - 1))
    scaled = v.cast("float") * scale.cast("float") if source == "flt" else v.cast("double") * scale
    r = F.rint(scaled.cast("double"))
    if target in ("u8", "s16"):
        # whole numbers of 64 bits, of which the low 32 stay
        whole = _saturated(r)
        low = F.pmod(whole, F.lit(1 << 32))
        low = F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)
        if target == "u8":
            low = low + 128
            low = F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)
            return F.greatest(F.lit(0), F.least(F.lit(255), low)).cast("int")
        return F.greatest(F.lit(-32768), F.least(F.lit(32767), low)).cast("int")
    if target == "s32":
        return F.greatest(F.lit(-(1 << 31)), F.least(F.lit((1 << 31) - 1), _saturated(r))).cast("int")
    return _saturated(r)


def _saturated(r: Column) -> Column:
    """A whole DOUBLE as BIGINT, clipped to its range; NaN is 0."""
    inside = F.when((r < 2.0**63) & (r >= -(2.0**63)), r).otherwise(F.lit(0.0))
    return F.when(F.isnan(r), F.lit(0).cast("bigint")).when(r >= 2.0**63, F.lit((1 << 63) - 1)).when(r < -(2.0**63), F.lit(-(1 << 63))).otherwise(inside.cast("bigint"))
