"""The relational form of picture operators: rows (stream_id, n, p, y, x, v), one for each component sample.

Geometry is a projection; resampling is a broadcast join with a tap table and a sum, along x, then along y. Tap tables have
at most (output size x 256) rows, so they are small whatever the number of frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediaframe.functions import colour
from mediaframe.functions.kernels import ONE_H, ONE_V, tap_table
from mediaframe.functions.picture import Video

KEYS = ("n", "p")


def _sizes(v: Video, what: str) -> Column:
    """Width or height of the row's plane."""
    f = v.format
    sizes = [(-(-v.width >> (f.chroma[0] if p in (1, 2) else 0)) if what == "w" else f.rows(v.height, p)) for p in range(f.planes)]
    return F.element_at(F.array(*map(F.lit, sizes)), F.col("p") + 1) if len(set(sizes)) > 1 else F.lit(sizes[0])


def hflip(px: DataFrame, v: Video) -> DataFrame:
    return px.withColumn("x", _sizes(v, "w") - 1 - F.col("x"))


def vflip(px: DataFrame, v: Video) -> DataFrame:
    return px.withColumn("y", _sizes(v, "h") - 1 - F.col("y"))


def transpose(px: DataFrame, v: Video, direction: int) -> tuple[DataFrame, Video]:
    w, h = _sizes(v, "w"), _sizes(v, "h")
    x = h - 1 - F.col("y") if direction & 1 else F.col("y")
    y = w - 1 - F.col("x") if direction & 2 else F.col("x")
    return px.withColumns({"x": x, "y": y}), v.with_(width=v.height, height=v.width)


def crop(px: DataFrame, v: Video, x: int, y: int, width: int, height: int) -> tuple[DataFrame, Video]:
    cw, ch = v.format.chroma
    chroma = F.col("p").isin(1, 2)
    x0, y0 = F.when(chroma, x >> cw).otherwise(x), F.when(chroma, y >> ch).otherwise(y)
    out = v.with_(width=width, height=height)
    px = px.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    return px.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < _sizes(out, "w")) & (F.col("y") < _sizes(out, "h"))), out


def _taps(px: DataFrame, v: Video, axis: str, target: Video, kernel: str) -> DataFrame:
    one = ONE_H if axis == "x" else ONE_V
    rows = []
    for p in range(v.format.planes):
        sub = v.format.chroma[0 if axis == "x" else 1] if p in (1, 2) else 0
        source, wanted = ((v.width, target.width) if axis == "x" else (v.height, target.height))
        rows += [(p, *r) for r in tap_table(kernel, -(-source >> sub), -(-wanted >> sub), one).rows()]
    return px.sparkSession.createDataFrame(rows, f"p int, to int, {axis} int, c int")


def scale(px: DataFrame, v: Video, width: int, height: int, kernel: str) -> tuple[DataFrame, Video]:
    """Table-kernel scaling of 8-bit planes without changing the format."""
    out = v.with_(width=width, height=height)
    h = F.broadcast(_taps(px, v, "x", out, kernel))
    lines = px.join(h, ["p", "x"]).groupBy("n", "p", "y", "to").agg(F.least(F.shiftright(F.sum(F.col("v").cast("long") * F.col("c")), 7), F.lit(32767)).alias("v"))
    lines = lines.withColumnRenamed("to", "x")
    w = F.broadcast(_taps(px, v, "y", out, kernel))
    total = F.shiftright(F.sum(F.col("v") * F.col("c")) + (64 << 12), 19)
    done = lines.join(w, ["p", "y"]).groupBy("n", "p", "to", "x").agg(F.greatest(F.lit(0), F.least(F.lit(255), total)).cast("int").alias("v"))
    return done.select("n", "p", F.col("to").alias("y"), "x", "v"), out


def to_rgb(px: DataFrame, v: Video) -> DataFrame:
    """Same-size YUV 4:2:0 to (n, y, x, r, g, b): luma joined with the chroma sample of its block."""
    luma = px.where("p = 0").select("n", "y", "x", F.col("v").alias("luma"), F.shiftright("y", 1).alias("cy"), F.shiftright("x", 1).alias("cx"))
    chroma = px.where("p > 0").groupBy("n", F.col("y").alias("cy"), F.col("x").alias("cx")).agg(F.max(F.when(F.col("p") == 1, F.col("v"))).alias("u"), F.max(F.when(F.col("p") == 2, F.col("v"))).alias("w"))
    r, g, b = colour.rgb_columns(F.col("luma"), F.col("u"), F.col("w"), v.color_range in ("pc", "jpeg", "full"))
    return luma.join(chroma, ["n", "cy", "cx"]).select("n", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


def checksum(px: DataFrame) -> DataFrame:
    """(n, pixels, checksum) for each frame: a weighted sum of the samples, independent of order."""
    weight = (F.col("p").cast("long") * 31 + F.col("y")) * 1009 + F.col("x") + 1
    return px.groupBy("n").agg(F.count("*").alias("pixels"), F.sum(weight * F.col("v")).alias("checksum"))


def difference(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """Per frame of two PIXEL tables: the largest difference of a value, and how many differ by more than the tolerance."""
    both = a.join(b.withColumnRenamed("v", "w"), ["n", "p", "y", "x"])
    away = F.abs(F.col("v") - F.col("w"))
    return both.groupBy("n").agg(F.max(away).alias("max_diff"), F.sum((away > tolerance).cast("long")).alias("over"), F.count("*").alias("pixels"))


def padded_rows(data: Column, line: int, rows: int, align: int) -> Column:
    """A plane's bytes with every row of `line` bytes filled up with zeros to a multiple of `align`."""
    stride = -(-line // align) * align
    return F.concat(*[F.rpad(F.substring(data, 1 + r * line, line), F.lit(stride), F.lit(b"\0")) for r in range(rows)])


def packed_rows(data: Column, line: int, rows: int, stride: int) -> Column:
    """The rows' first `line` bytes, without what fills them up."""
    return F.concat(*[F.substring(data, 1 + r * stride, line) for r in range(rows)])
