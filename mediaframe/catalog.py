"""The registered queries over the driver's tables and their SQL counterparts.

The tables hold no media, so media tables are derived from them by integer arithmetic: 8x8 gray or 4:2:0 pictures from the
embeddings, mono and interleaved sound from the events, packets from the line items, raw bytes from the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mediaframe.functions import layouts, samples
from mediaframe.functions.fir import bank
from mediaframe.functions.kernels import ONE_H, ONE_V, TABLE_KERNELS
from mediaframe.functions.picture import Video
from mediaframe.functions.rational import MODES, rescale_column
from mediaframe.operators import audio, mpeg, pixels
from mediaframe.plans.graph import filter_video
from mediaframe.sources import nal
from mediaframe.sources.containers import BIT_RATES

GRAY, YUV = Video("gray", 8, 8), Video("yuv420p", 8, 8)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def img_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.posexplode("embedding").alias("i", "e"))
    v = F.floor(F.least(F.greatest((F.col("e").cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("int")
    return e.where("i < 64").select("n", F.lit(0).alias("p"), F.expr("cast(i div 8 AS int)").alias("y"), (F.col("i") % 8).alias("x"), v.alias("v"))


def img_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = img_gray(spark, sf_dir)
    half = lambda p, rest: g.where((F.col("y") % 2 == rest) & (F.col("x") % 2 == rest)).select("n", F.lit(p).alias("p"), F.expr("cast(y div 2 AS int)").alias("y"), F.expr("cast(x div 2 AS int)").alias("x"), "v")
    return g.unionByName(half(1, 0)).unionByName(half(2, 1))


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("k"), F.lit(0).alias("ch"), (F.rint(F.col("value") * 8) - 4096).cast("int").alias("v"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    den = F.element_at(F.array(F.lit(48000), F.lit(44100), F.lit(90000), F.lit(1000)), (F.col("l_orderkey") % 4 + 1).cast("int"))
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("l_quantity").cast("bigint").alias("duration"), den.alias("den"))
    return audio.packet_times(rows)


GRAY_SQL = """img AS (SELECT vec_id AS n, 0 AS p, cast((i - 1) // 8 AS int) AS y, cast((i - 1) % 8 AS int) AS x,
    cast(floor(least(greatest((cast(embedding[i] AS double) + 1) * 127.5, 0), 255)) AS int) AS v
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings))"""
YUV_SQL = (
    GRAY_SQL
    + """, yuv AS (SELECT * FROM img UNION ALL SELECT n, 1, y // 2, x // 2, v FROM img WHERE y % 2 = 0 AND x % 2 = 0
    UNION ALL SELECT n, 2, y // 2, x // 2, v FROM img WHERE y % 2 = 1 AND x % 2 = 1)"""
)
PCM_SQL = """pcm AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, 0 AS ch,
    cast(round_even(value * 8, 0) - 4096 AS int) AS v FROM events)"""
PACKETS_SQL = """pk AS (SELECT l_orderkey AS stream_id, row_number() OVER w - 1 AS seq, cast(l_quantity AS bigint) AS duration,
    [48000, 44100, 90000, 1000][cast(l_orderkey % 4 + 1 AS int)] AS den FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
  packets AS (SELECT *, cast(coalesce(sum(duration) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS pts FROM pk)"""


def _sum(of: str) -> str:
    return f"SELECT n, count(*) AS pixels, cast(sum(((cast(p AS bigint) * 31 + y) * 1009 + x + 1) * v) AS bigint) AS checksum FROM {of} GROUP BY n"


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("image_histogram", f"WITH {GRAY_SQL} SELECT v, count(*) AS n_pixels FROM img GROUP BY v")
def image_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return img_gray(spark, sf_dir).groupBy("v").agg(F.count("*").alias("n_pixels"))


@query("hflip_yuv", f"WITH {YUV_SQL}, o AS (SELECT n, p, y, CASE WHEN p = 0 THEN 7 ELSE 3 END - x AS x, v FROM yuv) {_sum('o')}")
def hflip_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.checksum(pixels.hflip(img_yuv(spark, sf_dir), YUV))


@query("vflip_yuv", f"WITH {YUV_SQL}, o AS (SELECT n, p, CASE WHEN p = 0 THEN 7 ELSE 3 END - y AS y, x, v FROM yuv) {_sum('o')}")
def vflip_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.checksum(pixels.vflip(img_yuv(spark, sf_dir), YUV))


def _transpose(direction: int) -> None:
    m = "CASE WHEN p = 0 THEN 7 ELSE 3 END"
    x = f"{m} - y" if direction & 1 else "y"
    y = f"{m} - x" if direction & 2 else "x"

    @query(f"transpose_{direction}", f"WITH {YUV_SQL}, o AS (SELECT n, p, {y} AS y, {x} AS x, v FROM yuv) {_sum('o')}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pixels.checksum(pixels.transpose(img_yuv(spark, sf_dir), YUV, direction)[0])


for _d in range(4):
    _transpose(_d)


@query("crop_yuv", f"WITH {YUV_SQL}, o AS (SELECT n, p, y - CASE WHEN p = 0 THEN 4 ELSE 2 END AS y, x - CASE WHEN p = 0 THEN 2 ELSE 1 END AS x, v FROM yuv WHERE CASE WHEN p = 0 THEN y BETWEEN 4 AND 7 AND x BETWEEN 2 AND 5 ELSE y BETWEEN 2 AND 3 AND x BETWEEN 1 AND 2 END) {_sum('o')}")
def crop_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.checksum(pixels.crop(img_yuv(spark, sf_dir), YUV, 2, 4, 4, 4)[0])


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(map(str, r))})" for r in rows) + ")"


#: Kernels over the distance x in source pixels, as SQL.
CURVE_SQL = {
    "gauss": "pow(2, -3 * x * x)",
    "sinc": "CASE WHEN x = 0 THEN 1.0 ELSE sin(pi() * x) / (pi() * x) END",
    "lanczos": "CASE WHEN x > 3 THEN 0.0 WHEN x = 0 THEN 1.0 ELSE sin(pi() * x) * sin(pi() * x / 3) / (pi() * pi() * x * x / 3) END",
    "spline": "(SELECT a + (x - k) * (b + (x - k) * (c + (x - k) * d)) FROM piece WHERE k = greatest(cast(ceil(x) AS int) - 1, 0))",
}
#: Pieces of the spline: each from the one before, by the conditions at the joint.
PIECES_SQL = """piece(k, a, b, c, d) AS (SELECT 0, cast(1 AS double), cast(0 AS double), cast(-2.196152422706632 AS double), cast(1.196152422706632 AS double)
  UNION ALL SELECT k + 1, 0.0, b + 2 * c + 3 * d, c + 3 * d, -b - 3 * c - 6 * d FROM piece WHERE k < 20)"""


def taps_sql(name: str, kernel: str, source: int, target: int, one: int) -> str:
    """CTEs up to {name}(o, i, c): the integer taps by the kernel's formula, cut, folded and rounded in SQL."""
    step = ((source << 16) + target // 2) // target
    if kernel == "area" and step <= 65536:
        size, centre, first = 2, f"{step // 2 - 32768} + {step} * o", "cast(floor(centre / 65536.0) AS bigint)"
        curve, away = "greatest(1 - x, 0.0)", "abs((first + j) * 65536 - centre) / 65536.0"
    else:
        extent = {"area": 1, "gauss": 8, "sinc": 20, "lanczos": 6, "spline": 20}[kernel]
        size = max(1, min(1 + (extent if step <= 65536 else -(-extent * source // target)), source - 2))
        centre, first = f"{step - 65536} + {2 * step} * o", f"cast(trunc((centre - {(size - 2) << 16}) / 131072.0) AS bigint)"
        away = "abs((first + j) * 131072 - centre) / 131072.0" + (f" * {target} / {source}" if step > 65536 else "")
        edge = f"(x - 0.5) * {step / 65536!r}"
        curve = f"CASE WHEN {edge} < -0.5 THEN 1.0 WHEN {edge} < 0.5 THEN 1 - ({edge}) ELSE 0.0 END" if kernel == "area" else CURVE_SQL[kernel]
    return f"""{name}_at AS (SELECT o, centre, {first} AS first FROM (SELECT o, {centre} AS centre FROM (SELECT unnest(generate_series(0, {target - 1})) AS o))),
      {name}_x AS (SELECT o, first, j, {away} AS x FROM {name}_at, (SELECT unnest(generate_series(0, {size - 1})) AS j)),
      {name}_raw AS (SELECT o, first, j, {curve} AS c FROM {name}_x),
      {name}_cum AS (SELECT *, sum(abs(c)) OVER (PARTITION BY o ORDER BY j) AS below, sum(abs(c)) OVER (PARTITION BY o ORDER BY j DESC) AS above FROM {name}_raw),
      {name}_cut AS (SELECT o, any_value(first) AS first, any_value(first) + count(*) FILTER (below <= 0.002) AS begins, any_value(first) + max(j) FILTER (above > 0.002) AS ends FROM {name}_cum GROUP BY o),
      {name}_start AS (SELECT o, min(begins) OVER (ORDER BY o DESC) AS begins, ends FROM {name}_cut),
      {name}_size AS (SELECT max(greatest(ends - begins + 1, 1)) AS size FROM {name}_start),
      {name}_in AS (SELECT o, least(greatest(first + j, 0), {source - 1}) AS i, sum(c) AS c FROM {name}_raw JOIN {name}_start USING (o), {name}_size WHERE first + j >= begins AND first + j < begins + size GROUP BY 1, 2),
      {name}_sum AS (SELECT o, i, sum(c) OVER (PARTITION BY o ORDER BY i) / sum(c) OVER (PARTITION BY o) * {one} AS upto FROM {name}_in),
      {name} AS (SELECT o, i, cast(round(upto) - coalesce(lag(round(upto)) OVER (PARTITION BY o ORDER BY i), 0) AS bigint) AS c FROM {name}_sum)"""


def _scale(kernel: str, width: int, height: int) -> None:
    sql = f"""WITH RECURSIVE {PIECES_SQL}, {GRAY_SQL}, {taps_sql('th', kernel, 8, width, ONE_H)}, {taps_sql('tv', kernel, 8, height, ONE_V)},
      lines AS (SELECT n, p, y, o AS x, least(cast(sum(cast(v AS bigint) * c) AS bigint) >> 7, 32767) AS v FROM img JOIN th ON img.x = th.i GROUP BY n, p, y, o),
      o AS (SELECT n, p, o AS y, x, greatest(0, least(255, (cast(sum(v * c) AS bigint) + 262144) >> 19)) AS v FROM lines JOIN tv ON lines.y = tv.i GROUP BY n, p, o, x) {_sum('o')}"""

    @query(f"scale_{kernel}_{width}x{height}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pixels.checksum(pixels.scale(img_gray(spark, sf_dir), GRAY, width, height, kernel)[0])


for _k in TABLE_KERNELS:
    _scale(_k, 4, 4)
_scale("area", 16, 12)
_scale("lanczos", 16, 12)


@query(
    "yuv_to_rgb",
    f"""WITH {YUV_SQL}, j AS (SELECT a.n, a.y, a.x, cast(a.v AS float) AS l, cast(u.v AS float) - cast(128 AS float) AS u, cast(w.v AS float) - cast(128 AS float) AS w
      FROM yuv a JOIN yuv u ON u.n = a.n AND u.p = 1 AND u.y = a.y // 2 AND u.x = a.x // 2 JOIN yuv w ON w.n = a.n AND w.p = 2 AND w.y = a.y // 2 AND w.x = a.x // 2 WHERE a.p = 0),
      f AS (SELECT *, (l - cast(16 AS float)) * cast(1.1643835616438356 AS float) AS e FROM j)
      SELECT n, cast(sum((y * 8 + x + 1) * cast(greatest(0, least(255, round(cast(e + cast(1.59603 AS float) * w AS double), 0))) AS bigint)) AS bigint) AS red,
        cast(sum((y * 8 + x + 1) * cast(greatest(0, least(255, round(cast(e - cast(0.39176 AS float) * u - cast(0.81297 AS float) * w AS double), 0))) AS bigint)) AS bigint) AS green,
        cast(sum((y * 8 + x + 1) * cast(greatest(0, least(255, round(cast(e + cast(2.01723 AS float) * u AS double), 0))) AS bigint)) AS bigint) AS blue FROM f GROUP BY n""",
)
def yuv_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("y") * 8 + F.col("x") + 1
    return pixels.to_rgb(img_yuv(spark, sf_dir), YUV).groupBy("n").agg(*[F.sum(w * F.col(c)).cast("bigint").alias(name) for c, name in (("r", "red"), ("g", "green"), ("b", "blue"))])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gray pictures as FRAME rows, made without a shuffle."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 64).alias("e"))
    v = F.transform("e", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("int"))
    raw = F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return e.select(F.lit(0).cast("long").alias("stream_id"), F.col("vec_id").alias("n"), F.col("vec_id").alias("pts"), F.lit(1).cast("long").alias("duration"), F.array(raw).alias("planes"))


def _frame_sums(df: DataFrame) -> DataFrame:
    return df.select("n", F.md5(F.element_at("planes", 1)).alias("md5"))


CHAIN_SQL = """SELECT n, md5(unhex(string_agg(printf('%02X', v), '' ORDER BY y, x))) AS md5 FROM o GROUP BY n"""


@query("filter_chain", f"WITH {GRAY_SQL}, o AS (SELECT n, 3 - (x - 2) AS x, 5 - (y - 1) AS y, v FROM img WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6) {CHAIN_SQL}")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crop, then both flips, from the textual language, on whole frames."""
    return _frame_sums(filter_video(frames(spark, sf_dir), GRAY, "crop=4:6,hflip,vflip")[0])


@query("filter_transpose", f"WITH {GRAY_SQL}, o AS (SELECT n, 7 - y AS x, x AS y, v FROM img) {CHAIN_SQL}")
def filter_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_sums(filter_video(frames(spark, sf_dir), GRAY, "null,transpose=clock")[0])


@query(
    "filter_scale",
    f"""WITH RECURSIVE {GRAY_SQL}, {taps_sql('th', 'lanczos', 8, 4, ONE_H)}, {taps_sql('tv', 'lanczos', 8, 6, ONE_V)},
      lines AS (SELECT n, y, o AS x, least(cast(sum(cast(v AS bigint) * c) AS bigint) >> 7, 32767) AS v FROM img JOIN th ON img.x = th.i GROUP BY n, y, o),
      o AS (SELECT n, o AS y, x, greatest(0, least(255, (cast(sum(v * c) AS bigint) + 262144) >> 19)) AS v FROM lines JOIN tv ON lines.y = tv.i GROUP BY n, o, x) {CHAIN_SQL}""",
)
def filter_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_sums(filter_video(frames(spark, sf_dir), GRAY, "scale=iw/2:6:flags=lanczos")[0])


@query("filter_format_rgb", f"WITH {GRAY_SQL}, g AS (SELECT n, y, x, cast(greatest(0, least(255, round(cast((cast(v AS float) - cast(16 AS float)) * cast(1.1643835616438356 AS float) AS double), 0))) AS int) AS v FROM img) SELECT n, md5(unhex(string_agg(printf('%02X%02X%02X', v, v, v), '' ORDER BY y, x))) AS md5 FROM g GROUP BY n")
def filter_format_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversion that the planner inserts."""
    return _frame_sums(filter_video(frames(spark, sf_dir), GRAY, "format=rgb24")[0])


def _cast(target: str, sql: str) -> None:
    @query(f"cast_s16_{target}", f"WITH {PCM_SQL} SELECT stream_id, k, {sql} AS v FROM pcm")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audio.cast(pcm(spark, sf_dir), "s16", target).select("stream_id", "k", "v")


_cast("u8", "cast((v >> 8) + 128 AS int)")
_cast("s32", "cast(v * 65536 AS int)")
_cast("s64", "cast(v AS bigint) * 281474976710656")
_cast("flt", "cast(v AS float) * cast(0.000030517578125 AS float)")
_cast("dbl", "cast(v AS double) * 0.000030517578125")


#: Samples of each format, made from 16-bit ones.
AS_SQL = {"u8": "cast((v >> 8) + 128 AS bigint)", "s32": "cast(v AS bigint) * 65536 + 12345", "s64": "cast(v AS bigint) * 281474976710656 + 987654321", "flt": "cast(v AS float) * cast(0.000030517578125 AS float)", "dbl": "cast(v AS double) * 0.000030517578125 + 1e-7"}
WIDTH = {"u8": 8, "s16": 16, "s32": 32, "s64": 64}


def _cast_sql(source: str, target: str) -> str:
    if source in WIDTH:
        centred = "(s - 128)" if source == "u8" else "s"
        if target in WIDTH:
            shift = WIDTH[target] - WIDTH[source]
            moved = f"{centred} * {1 << shift}" if shift >= 0 else f"({centred} >> {-shift})"
            return f"cast({moved} + {128 if target == 'u8' else 0} AS bigint)"
        kind = "float" if target == "flt" else "double"
        return f"cast({centred} AS {kind}) * cast({2.0 ** -(WIDTH[source] - 1)!r} AS {kind})"
    if target not in WIDTH:
        return f"cast(s AS {'float' if target == 'flt' else 'double'})"
    kind = "float" if source == "flt" else "double"
    r = f"cast(round_even(cast(s * cast({2.0 ** (WIDTH[target] - 1)!r} AS {kind}) AS double), 0) AS bigint)"
    low, high = (0, 255) if target == "u8" else (-(1 << (WIDTH[target] - 1)), (1 << (WIDTH[target] - 1)) - 1)
    return r if target == "s64" else f"greatest({low}, least({high}, {r} + {128 if target == 'u8' else 0}))"


def _grid(source: str) -> None:
    targets = [t for t in ("u8", "s16", "s32", "s64", "flt", "dbl") if t != source]

    @query(f"cast_grid_{source}", f"WITH {PCM_SQL}, x AS (SELECT stream_id, k, {AS_SQL[source]} AS s FROM pcm) SELECT stream_id, k, {', '.join(f'{_cast_sql(source, t)} AS {t}' for t in targets)} FROM x")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.col("v")
        made = {"u8": F.shiftright(v, 8) + 128, "s32": v.cast("long") * 65536 + 12345, "s64": v.cast("long") * (1 << 48) + 987654321, "flt": samples.cast(v, "s16", "flt"), "dbl": samples.cast(v, "s16", "dbl") + F.lit(1e-7)}[source]
        x = pcm(spark, sf_dir).select("stream_id", "k", made.alias("s"))
        wide = lambda c, t: c.cast("bigint") if t in WIDTH else c
        return x.select("stream_id", "k", *[wide(samples.cast(F.col("s"), source, t), t).alias(t) for t in targets])


for _s in AS_SQL:
    _grid(_s)


@query("cast_round_trip", f"WITH {PCM_SQL} SELECT stream_id, k, v AS through_flt, v AS through_dbl, v AS through_s32, (v >> 8) * 256 AS through_u8 FROM pcm")
def cast_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    through = lambda f: samples.cast(samples.cast(F.col("v"), "s16", f), f, "s16")
    return pcm(spark, sf_dir).select("stream_id", "k", *[through(f).alias(f"through_{f}") for f in ("flt", "dbl", "s32", "u8")])


@query(
    "cast_overdriven",
    f"WITH {PCM_SQL}, o AS (SELECT stream_id, k, cast(v AS bigint) * 48 AS r FROM pcm) SELECT stream_id, k, cast(greatest(-32768, least(32767, r)) AS int) AS s16, cast(greatest(0, least(255, round_even(cast(r AS double) / 256, 0) + 128)) AS int) AS u8 FROM o",
)
def cast_overdriven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of up to 6 times full scale clip."""
    loud = pcm(spark, sf_dir).withColumn("f", F.col("v").cast("double") * 48 / 32768)
    return loud.select("stream_id", "k", samples.cast(F.col("f"), "dbl", "s16").alias("s16"), samples.cast(F.col("f"), "dbl", "u8").alias("u8"))


MATRIX = layouts.quantized([[1.0, 0.0, 0.5, 0.0, 0.25, 0.0], [0.0, 1.0, 0.5, 0.0, 0.0, 0.25]])


@query(
    "mix_fixed",
    f"""WITH {PCM_SQL}, s AS (SELECT stream_id, k // 6 AS k, k % 6 AS ch, v FROM pcm), m(o, ch, c) AS {_values([(o, i, c) for o, r in enumerate(MATRIX) for i, c in enumerate(r) if c])}
      SELECT stream_id, k, o AS ch, greatest(-32768, least(32767, (cast(sum(cast(v AS bigint) * c) AS bigint) + 16384) >> 15)) AS v FROM s JOIN m USING (ch) GROUP BY stream_id, k, o""",
)
def mix_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six interleaved channels to two."""
    return audio.mix_fixed(audio.interleave(pcm(spark, sf_dir), 6), MATRIX).select("stream_id", "k", "ch", "v")


@query("channel_swap", f"WITH {PCM_SQL} SELECT stream_id, k // 2 AS k, cast(1 - k % 2 AS int) AS ch, v FROM pcm")
def channel_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.select_channels(audio.interleave(pcm(spark, sf_dir), 2), [1, 0]).select("stream_id", "k", "ch", "v")


@query("gapless_trim", f"WITH {PCM_SQL} SELECT stream_id, count(*) AS samples, min(k) - 5 AS first, cast(sum((k - 5) * v) AS bigint) AS checksum FROM pcm WHERE k >= 5 AND k < 40 GROUP BY stream_id")
def gapless_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.trim(pcm(spark, sf_dir), 5, 40).groupBy("stream_id").agg(F.count("*").alias("samples"), F.min("k").alias("first"), F.sum(F.col("k") * F.col("v")).alias("checksum"))


@query("packet_times", f"WITH {PACKETS_SQL} SELECT stream_id, seq, pts, duration FROM packets")
def packet_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).select("stream_id", "seq", "pts", "duration")


_ROUNDED = {"zero": "a * 1000000 // den", "inf": "(a * 1000000 + den - 1) // den", "down": "a * 1000000 // den", "up": "(a * 1000000 + den - 1) // den", "near": "(a * 1000000 + den // 2) // den"}


@query("rescale", f"WITH {PACKETS_SQL} SELECT stream_id, seq, {', '.join(f'cast({s.replace("a *", "cast(pts AS hugeint) *")} AS bigint) AS {m}' for m, s in _ROUNDED.items())} FROM packets")
def rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet times in microseconds, in every rounding."""
    return packets(spark, sf_dir).select("stream_id", "seq", *[rescale_column(F.col("pts"), 1_000_000, F.col("den"), m).alias(m) for m in MODES])


@query("gapless_packets", f"WITH {PACKETS_SQL} SELECT stream_id, seq, CASE WHEN pts = 0 THEN 7 ELSE 0 END AS skip_samples, CASE WHEN pts + duration > 60 AND pts < 90 THEN least(pts + duration - 60, duration) ELSE 0 END AS discard_padding FROM packets")
def gapless_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.gapless(packets(spark, sf_dir), 7, 60, 90).select("stream_id", "seq", "skip_samples", "discard_padding")


@query("run_summary", f"WITH {PACKETS_SQL} SELECT stream_id, count(*) AS frames, cast(sum(duration) AS bigint) AS ticks, max(pts) AS last_pts, arg_max(duration, seq) AS last_duration FROM packets GROUP BY stream_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum("duration").alias("ticks"), F.max("pts").alias("last_pts"), F.max_by("duration", "seq").alias("last_duration"))


FIXED = bank(32000, 48000, scale=15)


@query(
    "resample_fixed",
    f"""WITH {PCM_SQL}, taps(ph, i, c) AS {_values([(p, i, int(c)) for p in range(FIXED.phases) for i, c in enumerate(FIXED.taps[p]) if c])},
      size AS (SELECT stream_id, count(*) AS n FROM pcm GROUP BY 1),
      outs AS (SELECT stream_id, n, unnest(generate_series(0, cast(ceil(((1 + n + (least(n, {FIXED.length}) + 1) // 2 - {FIXED.length}) * {FIXED.phases} - {FIXED.start}) * cast({FIXED.source_step} AS double) / {FIXED.target_step}) AS bigint) - 1)) AS o FROM size),
      idx AS (SELECT *, {FIXED.start} + o * {FIXED.target_step} // {FIXED.source_step} AS x FROM outs), ph AS (SELECT *, ((x % {FIXED.phases}) + {FIXED.phases}) % {FIXED.phases} AS ph FROM idx),
      reads AS (SELECT stream_id, o, c, n, (x - ph) // {FIXED.phases} + i AS src FROM ph JOIN taps USING (ph)),
      folded AS (SELECT stream_id, o, c, CASE WHEN src < 0 THEN -src WHEN src >= n THEN 2 * n - 1 - src ELSE src END AS k FROM reads)
      SELECT stream_id, o AS k, greatest(-32768, least(32767, (cast(sum(cast(v AS bigint) * c) AS bigint) + 16384) >> 15)) AS v FROM folded JOIN pcm USING (stream_id, k) GROUP BY stream_id, o""",
)
def resample_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3:2 rate conversion of 16-bit samples with integer coefficients."""
    return audio.resample_rows(pcm(spark, sf_dir), 48000, 32000, scale=15).select("stream_id", "k", "v")


#: Windowed-sinc coefficients of a 3:2 conversion by their closed formula: phase ph of 2, tap i; the window's Bessel function as a series.
TAPS_SQL = """geometry AS (SELECT 2 AS phases, least(32000 * 0.97 / 48000, 1.0) AS f),
  sized AS (SELECT *, cast(ceil(32 / f) AS int) + cast(ceil(32 / f) AS int) % 2 AS len FROM geometry),
  place AS (SELECT *, pi() * f * (i - (len - 1) // 2 - ph / cast(phases AS double)) AS x FROM sized, (SELECT unnest(generate_series(0, 1)) AS ph), (SELECT unnest(generate_series(0, 63)) AS i) WHERE i < len),
  curve AS (SELECT ph, i, len, CASE WHEN x = 0 THEN 1.0 ELSE sin(x) / x END * list_sum([pow(z2 / 4, j) / pow(gamma(j + 1), 2) FOR j IN generate_series(0, 40)]) AS y
    FROM (SELECT *, 81 * greatest(1 - pow(2 * x / (f * len) / pi(), 2), 0) AS z2 FROM place)),
  taps AS (SELECT ph, i, len, y / (SELECT sum(y) FROM curve WHERE ph = 0) AS c FROM curve),
  size AS (SELECT stream_id, count(*) AS n FROM pcm GROUP BY 1),
  outs AS (SELECT stream_id, n, len, unnest(generate_series(0, cast(ceil(((1 + n + (least(n, len) + 1) // 2 - len) * 2 + 2 * ((len - 1) // 2)) / 3.0) AS bigint) - 1)) AS o FROM size, (SELECT DISTINCT len FROM taps)),
  idx AS (SELECT *, o * 3 - 2 * ((len - 1) // 2) AS x FROM outs),
  reads AS (SELECT stream_id, o, c, n, (x - ((x % 2) + 2) % 2) // 2 + i AS src FROM idx JOIN taps ON ph = ((x % 2) + 2) % 2),
  folded AS (SELECT stream_id, o, c, CASE WHEN src < 0 THEN -src WHEN src >= n THEN 2 * n - 1 - src ELSE src END AS k FROM reads)"""
RESAMPLED_SQL = f"WITH {PCM_SQL}, {TAPS_SQL} SELECT stream_id, o AS k, round(sum(v * c), 4) + 0.0 AS v FROM folded JOIN pcm USING (stream_id, k) GROUP BY stream_id, o"


@query("resample_rows", RESAMPLED_SQL)
def resample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3:2 rate conversion as joins, rounded to 1e-4."""
    out = audio.resample_rows(pcm(spark, sf_dir), 48000, 32000)
    return out.select("stream_id", "k", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("resample_signal", RESAMPLED_SQL)
def resample_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a whole signal at a time."""
    return audio.resample(pcm(spark, sf_dir), 48000, 32000).select("stream_id", "k", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query(
    "downmix_51",
    f"""WITH {PCM_SQL}, s AS (SELECT stream_id, k // 6 AS k, k % 6 AS ch, v FROM pcm),
      g(ch, side, c) AS (VALUES (0, 0, 1.0), (1, 1, 1.0), (2, 0, sqrt(0.5)), (2, 1, sqrt(0.5)), (4, 0, sqrt(0.5)), (5, 1, sqrt(0.5))),
      o AS (SELECT stream_id, k, side AS ch, sum(v * c) / (1 + 2 * sqrt(0.5)) AS v FROM s JOIN g USING (ch) GROUP BY stream_id, k, side)
      SELECT stream_id, ch, count(*) AS samples, round(sum(v), 3) AS total FROM o GROUP BY stream_id, ch""",
)
def downmix_51(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.remix(audio.interleave(pcm(spark, sf_dir), 6), "5.1", "stereo")
    return out.groupBy("stream_id", "ch").agg(F.count("*").alias("samples"), F.round(F.sum("v"), 3).alias("total"))


KBITS = "[" + ", ".join("[" + ", ".join(map(str, BIT_RATES[k])) + "]" for k in sorted(BIT_RATES)) + "]"


@query(
    "mpeg_headers",
    f"""WITH w AS (SELECT doc_id, (cast(('0x' || substr(md5(text), 1, 8)) AS bigint) & 2097151) | 4292870144 AS h FROM documents),
      f AS (SELECT doc_id, h, 4 - ((h >> 17) & 3) AS layer, CASE WHEN (h >> 20) & 1 = 0 THEN 1 ELSE 1 - ((h >> 19) & 1) END AS lsf, 1 - ((h >> 20) & 1) AS old, (h >> 12) & 15 AS b, (h >> 10) & 3 AS r FROM w
        WHERE (h >> 19) & 3 <> 1 AND (h >> 17) & 3 <> 0 AND (h >> 12) & 15 NOT IN (0, 15) AND (h >> 10) & 3 <> 3),
      g AS (SELECT *, [44100, 48000, 32000][cast(r + 1 AS int)] >> cast(lsf + old AS int) AS rate, {KBITS}[cast(lsf * 3 + layer AS int)][cast(b + 1 AS int)] AS kbits FROM f)
      SELECT doc_id, cast(layer AS int) AS layer, cast(rate AS int) AS sample_rate, cast(kbits AS int) AS kbits,
        cast(CASE WHEN layer = 1 THEN (kbits * 12000 // rate + ((h >> 9) & 1)) * 4 WHEN layer = 3 THEN kbits * 144000 // (rate << cast(lsf AS int)) + ((h >> 9) & 1) ELSE kbits * 144000 // rate + ((h >> 9) & 1) END AS int) AS frame_bytes,
        CASE WHEN (h >> 6) & 3 = 3 THEN 1 ELSE 2 END AS channels FROM g""",
)
def mpeg_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit words made of document hashes, read as MPEG audio headers; words that are none go."""
    word = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint").bitwiseAND(0x1FFFFF).bitwiseOR(0xFFE00000)
    return mpeg.header_columns(_read(spark, sf_dir, "documents").select("doc_id", word.alias("word")), "word").select("doc_id", "layer", "sample_rate", "kbits", "frame_bytes", "channels")


@query(
    "nal_summary",
    """WITH piece AS (SELECT encode(unnest(string_split(text, ' '))) AS b FROM documents)
      SELECT cast(('0x' || substr(hex(b), 1, 2)) AS int) & 31 AS type, count(*) AS units, cast(sum(octet_length(b) - 1) AS bigint) AS bytes FROM piece WHERE octet_length(b) > 0 GROUP BY 1""",
)
def nal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of documents between made-up start codes, split into units and counted by type."""
    data = F.concat(F.lit(b"\0\0\1"), F.regexp_replace("text", " ", "\0\0\1").cast("binary"))
    return nal.split(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), data.alias("data"))).groupBy("type").agg(F.count("*").alias("units"), F.sum(F.octet_length("payload")).alias("bytes"))


LAYOUTS = [(n, layouts.mask_of(p)) for n, p in layouts.STANDARD.items()]


@query("channel_layouts", f"SELECT name, bit_count(cast(mask AS bigint)) AS channels, cast(mask & 3 = 3 AS int) AS has_front_pair, bit_count(cast(mask & 7 AS bigint)) AS index_of_lfe FROM {_values([(repr(n), m) for n, m in LAYOUTS])} t(name, mask)")
def channel_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard layouts, with counts and places of channels from their masks."""
    t = spark.createDataFrame(LAYOUTS, "name string, mask long")
    return t.select("name", F.bit_count("mask").cast("int").alias("channels"), (F.col("mask").bitwiseAND(3) == 3).cast("int").alias("has_front_pair"), F.bit_count(F.col("mask").bitwiseAND(7)).cast("int").alias("index_of_lfe"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_chain(spark, sf_dir)


def queries() -> dict[str, Query]:
    from mediaframe import catalog_values  # noqa: F401  adds its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from mediaframe import catalog_values  # noqa: F401

    return dict(SQL)
