"""Queries over values, names and container files: expressions, rationals, times, codes, rows of planes, files written and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mediaframe.catalog import GRAY, GRAY_SQL, PACKETS_SQL, PCM_SQL, _frame_sums, _read, frames, img_gray, packets, pcm, query
from mediaframe.functions import blocks, exprlang, layer3, rational, tags
from mediaframe.functions.layouts import Layout
from mediaframe.functions.rational import Rational
from mediaframe.operators import audio, avc, pictures, pixels
from mediaframe.plans.graph import filter_video
from mediaframe.session import map_arrow
from mediaframe.sources import containers as c, nal

# expressions: x is an event's value without its fraction, y its user's number; the SQL is written by hand

EXPRESSIONS = {
    "square": ("-x^2", "-(x * x)"),
    "fold": ("2^3^2+x", "64 + x"),
    "quarter": ("x/4-y", "x / 4 - y"),
    "remainder": ("mod(x,7)", "x - floor(x / 7) * 7"),
    "negative_remainder": ("mod(-x,7)", "-x - floor(-x / 7) * 7"),
    "least": ("min(x,y)", "CASE WHEN x < y THEN x ELSE y END"),
    "most": ("max(x,y)", "CASE WHEN x > y THEN x ELSE y END"),
    "clipped": ("clip(x,10,100)", "greatest(10.0, least(100.0, x))"),
    "floored": ("floor(x/3)", "floor(x / 3)"),
    "ceiled": ("ceil(x/3)", "ceil(x / 3)"),
    "cut": ("trunc((y-x)/3)", "trunc((y - x) / 3)"),
    "rounded": ("round((x-y)/4)", "CASE WHEN x < y THEN -floor((y - x) / 4 + 0.5) ELSE floor((x - y) / 4 + 0.5) END"),
    "distance": ("abs(y-x)*(1+2)", "abs(y - x) * 3"),
}
EVENT_SQL = "e AS (SELECT event_id, floor(value) AS x, cast(user_id AS double) AS y FROM events)"


@query("expression_values", f"WITH {EVENT_SQL} SELECT event_id, {', '.join(f'cast({sql} AS double) + 0.0 AS {name}' for name, (_, sql) in EXPRESSIONS.items())} FROM e")
def expression_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of crop and scale, as columns."""
    e = _read(spark, sf_dir, "events").select("event_id", F.floor("value").cast("double").alias("x"), F.col("user_id").cast("double").alias("y"))
    value = lambda text: exprlang.column(exprlang.parse(text, {"x", "y"}), {"x": F.col("x"), "y": F.col("y")})
    return e.select("event_id", *[(value(text) + F.lit(0.0)).alias(name) for name, (text, _) in EXPRESSIONS.items()])


def _rows(df: DataFrame, schema: str, make) -> DataFrame:
    """One row for each row, made by a function of its dictionary; batches come and go by Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([make(r) for r in batch.to_pylist()])

    return map_arrow(df, run, schema)


@query(
    "rational_values",
    """WITH p AS (SELECT p_partkey, p_size AS a, cast(p_partkey % 12 + 1 AS int) AS b FROM part),
      q AS (SELECT *, 3 * b + a * 2 AS s, 2 * b AS t, a * b AS m FROM p)
      SELECT p_partkey, cast(a // gcd(a, b) AS bigint) AS num, cast(b // gcd(a, b) AS bigint) AS den, cast(s // gcd(s, t) AS bigint) AS sum_num, cast(t // gcd(s, t) AS bigint) AS sum_den,
        cast(2 * a // gcd(2 * a, 3 * b) AS bigint) AS ratio_num, cast(3 * b // gcd(2 * a, 3 * b) AS bigint) AS ratio_den, cast(sign(2 * a - 3 * b) AS int) AS compared,
        a / cast(b AS double) AS as_double, cast(b // gcd(a, b) AS bigint) AS inverse_num FROM q""",
)
def rational_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a/b reduced, plus 3/2, over 3/2, compared with 3/2, as a double, and back from it."""

    def make(r: dict) -> dict:
        q, half = rational.reduce(r["a"], r["b"])[0], Rational(3, 2)
        added, ratio, back = q + half, q / half, rational.from_float(float(q), 100_000)
        assert (back.num, back.den) == (q.num, q.den)
        return {
            "p_partkey": r["p_partkey"], "num": q.num, "den": q.den, "sum_num": added.num, "sum_den": added.den, "ratio_num": ratio.num, "ratio_den": ratio.den,
            "compared": q.compare(half), "as_double": float(q), "inverse_num": q.inverse().num,
        }

    p = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("a"), (F.col("p_partkey") % 12 + 1).cast("int").alias("b"))
    out = _rows(p, "p_partkey long, num long, den long, sum_num long, sum_den long, ratio_num long, ratio_den long, compared long, as_double double, inverse_num long", make)
    return out.withColumn("compared", F.col("compared").cast("int"))


_SECONDS = "ts * (1 / cast(base AS double))"
_DECIMALS = "CASE " + " ".join(f"WHEN abs(s) >= 1e-{k} THEN printf('%.{k + 5}f', s)" for k in range(1, 7)) + " END"


@query(
    "time_strings",
    f"""WITH t AS (SELECT event_id, cast(floor(value * 1000) AS bigint) AS ts, [1, 25, 1000, 90000][cast(event_id % 4 + 1 AS int)] AS base FROM events),
      u AS (SELECT event_id, ts, {_SECONDS} AS s, cast(floor({_SECONDS} * 100 + 0.5) AS bigint) AS c FROM t)
      SELECT event_id, printf('%02d', c // 360000) || ':' || printf('%02d', c // 6000 % 60) || ':' || printf('%02d', c // 100 % 60) || '.' || printf('%02d', c % 100) AS clock,
        CASE WHEN s = 0 THEN '0' ELSE rtrim(rtrim(CASE WHEN abs(s) >= 1 THEN printf('%.6f', s) ELSE {_DECIMALS} END, '0'), '.') END AS seconds FROM u""",
)
def time_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps as clock times and as seconds."""
    bases = F.element_at(F.array(*map(F.lit, (1, 25, 1000, 90000))), (F.col("event_id") % 4 + 1).cast("int"))
    t = _read(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 1000).cast("long").alias("ts"), bases.alias("base"))
    return _rows(t, "event_id long, clock string, seconds string", lambda r: {"event_id": r["event_id"], "clock": rational.time_string(float(Rational(1, r["base"])) * r["ts"]), "seconds": rational.timestamp_string(r["ts"], Rational(1, r["base"]))})


@query("display_aspects", "WITH p AS (SELECT p_partkey, p_size * 16 * (p_partkey % 5 + 1) AS w, 1080 AS h FROM part) SELECT p_partkey, cast(w // gcd(w, h) AS bigint) AS num, cast(h // gcd(w, h) AS bigint) AS den FROM p")
def display_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of p_size * 16 by 1080 with pixels of up to 5:1."""

    def make(r: dict) -> dict:
        q = rational.display_aspect(r["w"], 1080, Rational(r["n"], 1))
        return {"p_partkey": r["p_partkey"], "num": q.num, "den": q.den}

    p = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16).alias("w"), (F.col("p_partkey") % 5 + 1).cast("int").alias("n"))
    return _rows(p, "p_partkey long, num long, den long", make)


_BYTE = "cast(('0x' || substr(md5(text), {}, 2)) AS int) & 127"
_SHOWN = "CASE WHEN regexp_full_match(chr({0}), '[A-Za-z0-9 ._-]') THEN chr({0}) ELSE '[' || {0} || ']' END"


@query(
    "fourcc_tags",
    f"WITH b AS (SELECT doc_id, {', '.join(f'greatest({_BYTE.format(2 * i + 1)}, 1) AS b{i}' for i in range(4))} FROM documents WHERE text IS NOT NULL) SELECT doc_id, cast(b0 AS bigint) + b1 * 256 + b2 * 65536 + cast(b3 AS bigint) * 16777216 AS tag, {' || '.join(_SHOWN.format(f'b{i}') for i in range(4))} AS shown FROM b",
)
def fourcc_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four characters made of document hashes, as numbers and as text."""
    byte = lambda i: F.greatest(F.conv(F.substring(F.md5("text"), 2 * i + 1, 2), 16, 10).cast("int").bitwiseAND(127), F.lit(1))
    d = _read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat(*[F.chr(byte(i)) for i in range(4)]).alias("code"))
    tag = d.select("doc_id", tags.number(F.col("code")).alias("tag"))
    return tag.select("doc_id", "tag", tags.text(F.col("tag")).alias("shown"))


@query(
    "row_pack",
    f"WITH {GRAY_SQL}, l AS (SELECT n, y, string_agg(printf('%02X', v), '' ORDER BY x) AS h FROM img GROUP BY n, y) SELECT n, md5(unhex(string_agg(h || '{'00' * 8}', '' ORDER BY y))) AS padded, md5(unhex(string_agg(h, '' ORDER BY y))) AS packed FROM l GROUP BY n",
)
def row_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 8 bytes filled up to 16, and packed again."""
    plane = F.element_at("planes", 1)
    padded = frames(spark, sf_dir).select("n", pixels.padded_rows(plane, 8, 8, 16).alias("raw"))
    return padded.select("n", F.md5("raw").alias("padded"), F.md5(pixels.packed_rows(F.col("raw"), 8, 8, 16)).alias("packed"))


@query(
    "frame_difference",
    f"WITH {GRAY_SQL}, d AS (SELECT a.n, abs(a.v - b.v) AS d FROM img a JOIN img b ON a.n = b.n AND a.y = b.y AND a.x = 7 - b.x) SELECT n, max(d) AS max_diff, cast(sum(cast(d > 3 AS int)) AS bigint) AS over, count(*) AS pixels FROM d GROUP BY n",
)
def frame_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures against their mirror images: largest difference, and how many pixels differ by more than 3."""
    g = img_gray(spark, sf_dir)
    return pixels.difference(g, pixels.hflip(g, GRAY), 3)


# fixed-tap kernels, by hand: halving 8 pixels puts every centre between two pixels


@query("scale_bilinear", f"WITH {GRAY_SQL}, o AS (SELECT n, y // 2 AS y, x // 2 AS x, cast(least(255, floor(sum(v) / 4.0 + 0.5)) AS int) AS v FROM img GROUP BY n, y // 2, x // 2) SELECT n, md5(unhex(string_agg(printf('%02X', v), '' ORDER BY y, x))) AS md5 FROM o GROUP BY n")
def scale_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_sums(filter_video(frames(spark, sf_dir), GRAY, "scale=4:4:flags=bilinear")[0])


@query("scale_nearest", f"WITH {GRAY_SQL}, o AS (SELECT n, y // 2 AS y, x // 2 AS x, v FROM img WHERE y % 2 = 1 AND x % 2 = 1) SELECT n, md5(unhex(string_agg(printf('%02X', v), '' ORDER BY y, x))) AS md5 FROM o GROUP BY n")
def scale_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_sums(filter_video(frames(spark, sf_dir), GRAY, "scale=4:4:flags=neighbor")[0])


# files, written and read back: a stream's file is made and scanned by one task


def _files(rows: DataFrame, key: str, schema: str, scan) -> DataFrame:
    """scan(key, rows of the stream in order) -> dictionaries; rows: (key, at, ...)."""
    names = rows.columns

    def run(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["at"])
        return pa.Table.from_pylist(scan(found[0][key], found), kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))
    from mediaframe.session import ship

    ship(rows.sparkSession)
    return rows.select(*names).groupBy(key).applyInArrow(run, schema)


MD5_SQL = f"WITH {GRAY_SQL}, o AS (SELECT n, md5(unhex(string_agg(printf('%02X', v), '' ORDER BY y, x))) AS md5 FROM img GROUP BY n)"


@query("y4m_round_trip", MD5_SQL + " SELECT cast(n // 50 AS bigint) AS stream, cast(row_number() OVER (PARTITION BY n // 50 ORDER BY n) - 1 AS bigint) AS frame, 'gray' AS pix_fmt, 8 AS width, 8 AS height, '24:1' AS rate, md5, 'y4m' AS picked FROM o")
def y4m_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures written as YUV4MPEG2 streams of up to 50 frames, probed, and read back."""
    import hashlib

    def scan(stream: int, rows: list[dict]) -> list[dict]:
        video = c.with_rate(GRAY, Rational(24, 1))
        data = c.y4m_write_header(video) + b"".join(b"FRAME\n" + r["data"] for r in rows)
        read, _ = c.y4m_header(data)
        picked = c.pick("stream", data[:4096])
        return [{"stream": stream, "frame": n, "pix_fmt": read.pix_fmt, "width": read.width, "height": read.height, "rate": str(read.frame_rate), "md5": hashlib.md5(payload).hexdigest(), "picked": picked} for n, payload in c.y4m_frames(data)]

    rows = frames(spark, sf_dir).select(F.floor(F.col("n") / 50).cast("long").alias("stream"), F.col("n").alias("at"), F.element_at("planes", 1).alias("data"))
    return _files(rows, "stream", "stream long, frame long, pix_fmt string, width int, height int, rate string, md5 string, picked string", scan)


@query("raw_round_trip", MD5_SQL + " SELECT cast(n // 50 AS bigint) AS stream, cast(row_number() OVER (PARTITION BY n // 50 ORDER BY n) - 1 AS bigint) AS frame, md5 FROM o")
def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a fixed size, one after the other."""
    import hashlib

    def scan(stream: int, rows: list[dict]) -> list[dict]:
        return [{"stream": stream, "frame": n, "md5": hashlib.md5(b"".join(c.planes_of(payload, GRAY))).hexdigest()} for n, payload in c.raw_frames(b"".join(r["data"] for r in rows), GRAY)]

    rows = frames(spark, sf_dir).select(F.floor(F.col("n") / 50).cast("long").alias("stream"), F.col("n").alias("at"), F.element_at("planes", 1).alias("data"))
    return _files(rows, "stream", "stream long, frame long, md5 string", scan)


@query("wav_round_trip", f"WITH {PCM_SQL}, size AS (SELECT stream_id, count(*) AS n FROM pcm GROUP BY 1) SELECT stream_id, k, v, 'pcm_s16le' AS codec, 48000 AS rate, 768000 AS bit_rate, cast(2 * n AS bigint) AS sample_bytes, 'wav' AS picked FROM pcm JOIN size USING (stream_id)")
def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mono sound written as WAV files, probed, and read back."""
    import struct

    def scan(stream: int, rows: list[dict]) -> list[dict]:
        samples = struct.pack(f"<{len(rows)}h", *[r["v"] for r in rows])
        data = c.wav_write_header(c.Audio("pcm_s16le", 48000, Layout.default(1), 16, 2), len(samples)) + samples
        read, start, end = c.wav_header(data)
        told = {"stream_id": stream, "codec": read.codec, "rate": read.sample_rate, "bit_rate": read.bit_rate, "sample_bytes": end - start, "picked": c.pick("sound", data[:4096])}
        return [told | {"k": k, "v": v} for k, (v,) in enumerate(struct.iter_unpack("<h", data[start:end]))]

    rows = pcm(spark, sf_dir).select("stream_id", F.col("k").alias("at"), "v")
    return _files(rows, "stream_id", "stream_id long, k long, v int, codec string, rate int, bit_rate int, sample_bytes long, picked string", scan)


ORDERED = "(SELECT stream_id, seq, duration, sum(7 + duration) OVER (PARTITION BY stream_id ORDER BY seq) - 7 - duration AS before FROM packets)"


@query("adts_scan", f"WITH {PACKETS_SQL} SELECT stream_id, seq, cast(before + 20 AS bigint) AS place, cast(seq * 1024 AS bigint) AS pts, cast(7 + duration AS int) AS frame_bytes, 44100 AS rate, 2 AS channels FROM {ORDERED}")
def adts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of made-up payloads behind an ID3 tag of 10 bytes, found by their headers."""

    def scan(stream: int, rows: list[dict]) -> list[dict]:
        data = b"ID3\4\0\0\0\0\0\n" + bytes(10)
        for r in rows:
            size = 7 + r["duration"]
            data += bytes([0xFF, 0xF1, 1 << 6 | 4 << 2, 2 << 6 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 0x1F, 0xFC]) + bytes(r["duration"])
        return [{"stream_id": stream, "seq": n, "place": at, "pts": pts, "frame_bytes": h.frame_bytes, "rate": h.sample_rate, "channels": h.channels} for n, (at, pts, h) in enumerate(c.adts_frames(data))]

    rows = packets(spark, sf_dir).select("stream_id", F.col("seq").alias("at"), F.col("duration").cast("int").alias("duration"))
    return _files(rows, "stream_id", "stream_id long, seq long, place long, pts long, frame_bytes int, rate int, channels int", scan)


@query(
    "mp3_scan",
    f"""WITH {PACKETS_SQL}, f AS (SELECT stream_id, seq, 417 + cast(duration AS int) % 2 AS b FROM packets)
      SELECT stream_id, seq, cast(20 + sum(b) OVER (PARTITION BY stream_id ORDER BY seq) - b AS bigint) AS place, cast(seq * 1152 AS bigint) AS pts, cast(b AS int) AS frame_bytes, 44100 AS rate, 128 AS kbits FROM f""",
)
def mp3_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent frames of 128 kbit/s, padded or not, behind an ID3 tag."""

    def scan(stream: int, rows: list[dict]) -> list[dict]:
        data = b"ID3\4\0\0\0\0\0\n" + bytes(10)
        for r in rows:
            pad = r["duration"] % 2
            data += bytes([0xFF, 0xFB, 0x90 | pad << 1, 0]) + bytes(413 + pad)
        return [{"stream_id": stream, "seq": n, "place": at, "pts": pts, "frame_bytes": h.frame_bytes, "rate": h.sample_rate, "kbits": h.bit_rate // 1000} for n, (at, pts, h) in enumerate(c.mpeg_frames(data))]

    rows = packets(spark, sf_dir).select("stream_id", F.col("seq").alias("at"), F.col("duration").cast("int").alias("duration"))
    return _files(rows, "stream_id", "stream_id long, seq long, place long, pts long, frame_bytes int, rate int, kbits int", scan)


def _mdct(window: str, size: int) -> None:
    @query(f"mdct_{window}", f"WITH {PCM_SQL} SELECT stream_id, k, v FROM pcm")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Sound through frames of coefficients and back: what the overlaps alias cancels out."""
        sound = pcm(spark, sf_dir)
        back = audio.overlap_add(audio.mdct(sound, size, window), size, window)
        return sound.select("stream_id", "k").join(back, ["stream_id", "k"]).select("stream_id", "k", F.rint("v").cast("int").alias("v"))


_mdct("sine", 16)
_mdct("kbd", 64)


@query("gapless_scan", f"WITH {PACKETS_SQL}, size AS (SELECT stream_id, count(*) AS n FROM packets GROUP BY 1) SELECT stream_id, cast(576 + 529 AS bigint) AS skip, cast(n * 1152 - 1000 + 529 AS bigint) AS discard_from, cast(n * 1152 AS bigint) AS discard_to, cast(n AS bigint) AS frames FROM size")
def gapless_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An information frame with an encoder's delays, before silent frames: what is to be cut, and that it is no frame of sound."""

    def scan(stream: int, rows: list[dict]) -> list[dict]:
        frame = bytes([0xFF, 0xFB, 0x90, 0]) + bytes(413)
        told = b"Info" + (15).to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes(4 + 100 + 4) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
        data = frame[:36] + told + frame[36 + len(told) :] + frame * len(rows)
        skip, low, high = c.mpeg_gapless(data)
        return [{"stream_id": stream, "skip": skip, "discard_from": low, "discard_to": high, "frames": sum(1 for _ in c.mpeg_frames(data))}]

    rows = packets(spark, sf_dir).select("stream_id", F.col("seq").alias("at"))
    return _files(rows, "stream_id", "stream_id long, skip long, discard_from long, discard_to long, frames long", scan)


# arithmetic of H.264 pictures


def _blocks(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """(n, md5) of what make() gives for batches of 8x8 pictures [frames, y, x]."""
    import hashlib

    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.uint8).reshape(-1, 8, 8)
                out = np.asarray(make(x)).astype(np.int16)
                yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array([hashlib.md5(",".join(map(str, o.ravel().tolist())).encode()).hexdigest() for o in out])], ["n", "md5"])

    return map_arrow(frames(spark, sf_dir).select("n", F.element_at("planes", 1).alias("data")), run, "n long, md5 string")


_NUMBERS = "SELECT n, md5(string_agg(cast(v AS varchar), ',' ORDER BY y, x)) AS md5 FROM o GROUP BY n"
_TAPS = "t(d, c) AS (VALUES (-2, 1), (-1, -5), (0, 20), (1, 20), (2, -5), (3, 1))"


def _half(axis: str) -> str:
    on = "b.y = a.y AND b.x = least(greatest(a.x + d, 0), 7)" if axis == "x" else "b.x = a.x AND b.y = least(greatest(a.y + d, 0), 7)"
    return f"half_{axis} AS (SELECT a.n, a.y, a.x, any_value(a.v) AS whole, greatest(0, least(255, (cast(sum(b.v * c) AS int) + 16) >> 5)) AS v FROM img a, t, img b WHERE b.n = a.n AND {on} GROUP BY a.n, a.y, a.x)"


def _motion(name: str, x: int, y: int, sql: str) -> None:
    @query(f"motion_{name}", f"WITH {GRAY_SQL}, {_TAPS}, {sql} {_NUMBERS}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Pictures moved by parts of a pixel."""
        return _blocks(spark, sf_dir, lambda p: blocks.moved_luma(p, x, y, 8, 8))


_motion("half_across", 2, 0, f"{_half('x')}, o AS (SELECT n, y, x, v FROM half_x)")
_motion("half_down", 0, 2, f"{_half('y')}, o AS (SELECT n, y, x, v FROM half_y)")
_motion("quarter_across", 1, 0, f"{_half('x')}, o AS (SELECT n, y, x, (whole + v + 1) >> 1 AS v FROM half_x)")
_motion("quarter_both", 1, 1, f"{_half('x')}, {_half('y')}, o AS (SELECT n, y, x, (p.v + q.v + 1) >> 1 AS v FROM half_x p JOIN half_y q USING (n, y, x))")


@query(
    "motion_chroma",
    f"""WITH {GRAY_SQL}, o AS (SELECT a.n, a.y, a.x, (5 * 3 * a.v + 3 * 3 * b.v + 5 * 5 * c.v + 3 * 5 * d.v + 32) >> 6 AS v FROM img a JOIN img b ON b.n = a.n AND b.y = a.y AND b.x = least(a.x + 1, 7)
      JOIN img c ON c.n = a.n AND c.y = least(a.y + 1, 7) AND c.x = a.x JOIN img d ON d.n = a.n AND d.y = c.y AND d.x = b.x) {_NUMBERS}""",
)
def motion_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures moved by 3/8 and 5/8 of a pixel."""
    return _blocks(spark, sf_dir, lambda p: blocks.moved_chroma(p, 3, 5, 8, 8))


def _butterfly(a: str, b: str, c: str, d: str) -> list[str]:
    return [f"{a} + {c} + {b} + ({d} >> 1)", f"{a} - {c} + ({b} >> 1) - {d}", f"{a} - {c} - ({b} >> 1) + {d}", f"{a} + {c} - {b} - ({d} >> 1)"]


_ROWS = ", ".join(f"{e} AS r{i}" for i, e in enumerate(_butterfly("d0", "d1", "d2", "d3")))
_COLUMNS = ", ".join(f"max(r{x}) FILTER (y % 4 = {y}) AS c{y}{x}" for y in range(4) for x in range(4))
_PLACES = " UNION ALL ".join(f"SELECT n, yb * 4 + {y} AS y, bx * 4 + {x} AS x, ({_butterfly(*(f'c{k}{x}' for k in range(4)))[y]} + 32) >> 6 AS v FROM cols" for y in range(4) for x in range(4))


@query(
    "residual_blocks",
    f"""WITH {GRAY_SQL}, lev AS (SELECT n, y, x, ((v - 128) * CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 13 WHEN y % 2 = 1 AND x % 2 = 1 THEN 20 ELSE 16 END) * 4 AS d FROM img),
      lines AS (SELECT n, y, x // 4 AS bx, {', '.join(f'max(d) FILTER (x % 4 = {i}) AS d{i}' for i in range(4))} FROM lev GROUP BY n, y, x // 4),
      done AS (SELECT n, y, bx, {_ROWS} FROM lines), cols AS (SELECT n, y // 4 AS yb, bx, {_COLUMNS} FROM done GROUP BY n, y // 4, bx), o AS ({_PLACES}) {_NUMBERS}""",
)
def residual_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures less 128 taken as levels of qp 14, scaled and transformed back, in blocks of 4x4."""

    def make(p):
        b = (p.astype("int64") - 128).reshape(-1, 2, 4, 2, 4).swapaxes(2, 3)
        return blocks.residual(blocks.scaled(b, 14)).swapaxes(2, 3).reshape(-1, 8, 8)

    return _blocks(spark, sf_dir, make)


@query(
    "display_order",
    f"""WITH {PACKETS_SQL}, e AS (SELECT stream_id, seq, duration AS poc, sum(cast(seq % 3 = 0 AS int)) OVER (PARTITION BY stream_id ORDER BY seq) AS epoch FROM packets)
      SELECT stream_id, seq, cast(row_number() OVER (PARTITION BY stream_id ORDER BY epoch, poc, seq) - 1 AS bigint) AS shown FROM e""",
)
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded pictures, every third one a new start, in the order in which they are shown."""
    coded = packets(spark, sf_dir).select("stream_id", "seq", (F.col("seq") % 3 == 0).alias("idr"), F.col("duration").alias("poc"))
    return pictures.display_order(coded).select("stream_id", "seq", "shown")


# H.264 streams of one small picture or two for each gray picture, made here and decoded


def _avc_sets(across: int, down: int, crop: tuple[int, ...] | None, qp: int) -> bytes:
    s, p = nal.Writer(), nal.Writer()
    for n, v in ((8, 66), (8, 0), (8, 30)):
        s.write(n, v)
    for v in (0, 0, 2, 1):  # number 0, frame numbers of four bits, order of coding, one reference
        s.ue(v)
    s.write(1, 0), s.ue(across - 1), s.ue(down - 1), s.write(2, 3), s.write(1, crop is not None)
    for v in crop or ():
        s.ue(v)
    s.write(1, 0)
    p.ue(0), p.ue(0), p.write(2, 0), p.ue(0), p.ue(0), p.ue(0), p.write(3, 0), p.se(qp - 26), p.se(0), p.se(0), p.write(3, 0b100)
    return s.unit(7) + p.unit(8)


def _avc_slice(kind: int, frame: int, smoothing: int = 1) -> nal.Writer:
    """The head of a slice over a whole picture; kinds: 0 from the picture before, 2 alone."""
    w = nal.Writer()
    w.ue(0), w.ue(kind), w.ue(0), w.write(4, frame)
    if kind == 2:
        w.ue(0), w.write(2, 0)
    else:
        w.write(3, 0)
    w.se(0), w.ue(smoothing)
    if smoothing != 1:
        w.se(0), w.se(0)
    return w


def _avc_bytes(w: nal.Writer, gray: bytes, below: int = 0) -> None:
    """A macroblock of bytes: an 8x8 picture on the left, so many rows below the upper edge, black around it; chroma in the middle."""
    w.ue(25)
    w.align()
    rows = b"\0" * (16 * below) + b"".join(gray[i : i + 8] + b"\0" * 8 for i in range(0, 64, 8)) + b"\0" * (128 - 16 * below) + b"\x80" * 128
    w.write(8 * len(rows), int.from_bytes(rows, "big"))


def _avc_frames(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """FRAME rows of the streams that make() gives for the bytes of a picture; the stream is the picture's number."""
    streams = _rows(frames(spark, sf_dir).select("n", F.element_at("planes", 1).alias("gray")), "n long, data binary", lambda r: {"n": r["n"], "data": make(bytes(r["gray"]))})
    return avc.decode(streams, "n")


def _avc_sum(df: DataFrame) -> DataFrame:
    return df.select(F.col("stream_id").alias("n"), F.col("n").alias("shown"), F.lower(F.hex(F.element_at("planes", 1))).alias("luma"), F.octet_length(F.element_at("planes", 2)).cast("long").alias("chroma"))


_HEX = "string_agg(lower(lpad(printf('%x', v), 2, '0')), '' ORDER BY y, x)"


@query("h264_plain", f"WITH {GRAY_SQL}, s(shown) AS (VALUES (0), (1)) SELECT n, cast(shown AS bigint) AS shown, {_HEX} AS luma, cast(16 AS bigint) AS chroma FROM img, s GROUP BY n, shown")
def h264_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cropped picture of bytes, and one in which all is skipped."""

    def make(gray: bytes) -> bytes:
        first, second = _avc_slice(2, 0), _avc_slice(0, 1)
        _avc_bytes(first, gray)
        second.ue(1)
        return _avc_sets(1, 1, (0, 4, 0, 4), 26) + first.unit(5) + second.unit(1, 2)

    return _avc_sum(_avc_frames(spark, sf_dir, make))


@query(
    "h264_mean",
    f"""WITH {GRAY_SQL}, m AS (SELECT n, cast(sum(v) + 8 AS int) >> 4 AS v FROM img WHERE y = 7 GROUP BY n) SELECT n, cast(0 AS bigint) AS shown, repeat(lpad(printf('%x', v), 2, '0'), 128) AS luma, cast(32 AS bigint) AS chroma FROM m""",
)
def h264_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Below a macroblock of bytes one that is the mean of the row above it: the last row of the picture and eight black pixels."""

    def make(gray: bytes) -> bytes:
        w = _avc_slice(2, 0)
        _avc_bytes(w, gray, below=8)
        w.ue(3), w.ue(0), w.se(0), w.write(6, 3)  # with 16 levels beside it, none is written as three
        return _avc_sets(1, 2, (0, 0, 8, 4), 26) + w.unit(5)

    return _avc_sum(_avc_frames(spark, sf_dir, make))


@query(
    "h264_moved",
    f"""WITH {GRAY_SQL}, w AS (SELECT i AS y, j AS x FROM generate_series(0, 7) a(i), generate_series(0, 7) b(j)),
      o AS (SELECT p.n, w.y, w.x, coalesce(i.v, 0) AS v FROM (SELECT DISTINCT n FROM img) p CROSS JOIN w LEFT JOIN img i ON i.n = p.n AND i.y = w.y + 2 AND i.x = w.x + 3)
      SELECT n, cast(1 AS bigint) AS shown, {_HEX} AS luma, cast(16 AS bigint) AS chroma FROM o GROUP BY n""",
)
def h264_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second picture that is the first one, three pixels to the right and two further down."""

    def make(gray: bytes) -> bytes:
        first, second = _avc_slice(2, 0), _avc_slice(0, 1)
        _avc_bytes(first, gray)
        second.ue(0), second.ue(0), second.se(12), second.se(8), second.ue(0)
        return _avc_sets(1, 1, (0, 4, 0, 4), 26) + first.unit(5) + second.unit(1, 2)

    return _avc_sum(_avc_frames(spark, sf_dir, make)).where("shown = 1")


# Layer III: samples taken as levels, sides and shared lines


@query(
    "layer3_lines",
    f"""WITH {PCM_SQL}, e(b, more) AS (VALUES (11, 1), (12, 1), (13, 1), (14, 1), (15, 2), (16, 2), (17, 3), (18, 3), (19, 3), (20, 2)),
      s AS (SELECT stream_id, k, v, 214 - k % 9 AS gain, k % 5 AS factor, k % 22 AS band, k % 2 = 1 AS coarse, k % 3 = 0 AS emphasis FROM pcm),
      t AS (SELECT s.*, CASE WHEN coarse THEN 1.0 ELSE 0.5 END * (factor + CASE WHEN emphasis THEN coalesce(more, 0) ELSE 0 END) AS lowered FROM s LEFT JOIN e ON b = band)
      SELECT stream_id, k, round(sign(v) * pow(abs(cast(v AS double)), 4.0::double / 3) * pow(2.0::double, (gain - 210) / 4.0 - lowered), 3) + 0.0 AS line FROM t""",
)
def layer3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from levels, gains, scale factors and emphasis."""
    k = F.col("k")
    lowered = layer3.halvings(k % 5, k % 22, k % 2 == 1, k % 3 == 0)
    return pcm(spark, sf_dir).select("stream_id", "k", (F.round(layer3.line_value(F.col("v"), 214 - k % 9, lowered), 3) + F.lit(0.0)).alias("line"))


@query(
    "layer3_stereo",
    f"""WITH {PCM_SQL}, s AS (SELECT stream_id, k, cast(v AS double) AS v, cast(k % 100 AS double) AS side, k % 8 AS position, tan(k % 8 * pi() / 12) AS ratio FROM pcm)
      SELECT stream_id, k, round((v + side) * sqrt(0.5::double), 3) + 0.0 AS l, round((v - side) * sqrt(0.5::double), 3) + 0.0 AS r,
        round(CASE WHEN position >= 6 THEN v ELSE v * ratio / (1 + ratio) END, 3) + 0.0 AS shared_l, round(CASE WHEN position >= 6 THEN 0 ELSE v / (1 + ratio) END, 3) + 0.0 AS shared_r FROM s""",
)
def layer3_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as middles, with made-up sides, and as lines that both channels share."""
    v = F.col("v").cast("double")
    columns = [*layer3.middle_side(v, F.col("k") % 100), *layer3.intensity(v, F.col("k") % 8)]
    return pcm(spark, sf_dir).select("stream_id", "k", *[(F.round(c, 3) + F.lit(0.0)).alias(name) for c, name in zip(columns, ("l", "r", "shared_l", "shared_r"))])
