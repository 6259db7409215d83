import math

import numpy as np
import pytest

from mediaframe.functions import exprlang, layouts, picture
from mediaframe.functions.picture import Video
from mediaframe.functions.pixfmt import FORMATS, pixel_format
from mediaframe.functions.rational import Rational, from_float, reduce, rescale, time_string
from mediaframe.plans.filters import FilterError
from mediaframe.plans.graph import filter_video, plan
from mediaframe.plans.language import LanguageError, parse, parse_options
from mediaframe.sources import containers as c, datasource, media


def test_pixel_geometry():
    assert len(FORMATS) == 23
    assert pixel_format("nv12").plane_sizes(5, 3) == [15, 12]
    assert pixel_format("yuv420p").plane_sizes(5, 3) == [15, 6, 6]
    assert pixel_format("gray8").name == "gray" and pixel_format("yuyv422").bits == 16 and pixel_format("yuv420p").bits == 12


def test_rationals():
    assert reduce(60000, 2002)[0] == Rational(30000, 1001)
    assert reduce(1 << 40, 3, 1000)[1] is False
    assert Rational(1, 3) + Rational(1, 6) == Rational(1, 2)
    assert Rational(1, 2).compare(Rational(2, 4)) == 0 and Rational(0, 0).compare(Rational(1, 1)) is None
    assert from_float(29.97002997, 2000) == Rational(30000, 1001) or abs(float(from_float(29.97002997)) - 29.97002997) < 1e-6
    assert [rescale(7, 1, 2, m) for m in ("zero", "inf", "down", "up", "near")] == [3, 4, 3, 4, 4]
    assert [rescale(-7, 1, 2, m) for m in ("zero", "inf", "down", "up", "near")] == [-3, -4, -4, -3, -4]
    assert time_string(3661.239) == "01:01:01.24"


def test_expressions(spark):
    from pyspark.sql import functions as F

    names = {"a", "b"}
    cases = {"-2^2": -4, "2^3^2": 64, "7/0": math.inf, "mod(-7,3)": 2, "min(a,b)": 3, "max(a,b)": 5, "clip(9,1,4)": 4, "round(-2.5)": -3, "trunc(-2.7)": -2, "1+2*3": 7, "(a+b)/2": 4, "abs(-a)": 3, "ceil(2.1)+floor(2.9)": 5}
    values = {"a": 3.0, "b": 5.0}
    row = spark.createDataFrame([(3.0, 5.0)], "a double, b double")
    columns = {n: F.col(n) for n in names}
    for text, want in cases.items():
        node = exprlang.parse(text, names)
        assert exprlang.evaluate(node, values) == want, text
        assert row.select(exprlang.column(node, columns).alias("v")).first()["v"] == want, text
    for bad in ("a(2)", "foo", "1+", "min(1)", "(1", "1 2"):
        with pytest.raises(exprlang.ExpressionError):
            exprlang.parse(bad, names)


def test_language():
    g = parse("[in]crop=4:4:0:0, scale@s=w=2:h=-1 [mid];[mid]format='rgb24|gray'[out]")
    assert [[f.name for f in chain] for chain in g.chains] == [["crop", "scale"], ["format"]]
    assert g.chains[0][1].instance == "s" and g.chains[0][1].outputs == ("mid",)
    assert parse("sws_flags=area;scale=2:2").scale_flags == "area"
    assert parse_options("1:2:x=3:x=4", ("w", "h")) == [("w", "1"), ("h", "2"), ("x", "3"), ("x", "4")]
    assert parse_options(r"a\:b:'c:d '", ("p", "q")) == [("p", "a:b"), ("q", "c:d ")]
    for bad in ("", "[in", "[]null", "null,,null"):
        with pytest.raises(LanguageError):
            parse(bad)


def test_planning():
    v = Video("yuv420p", 64, 48, sar=Rational(2, 1))
    p = plan("crop=iw/2:ih/2,scale=320:-1,format=rgb24", v)
    assert [s.name for s in p.steps] == ["Parsed_crop_0", "Parsed_scale_1"] and (p.target.pix_fmt, p.target.width, p.target.height) == ("rgb24", 320, 240)
    assert [s.name for s in plan("format=rgb24,hflip", v).steps] == ["auto_scale_0", "Parsed_hflip_1"]
    assert plan("transpose=1", v).target.sar == Rational(1, 2)
    assert plan("null", v, ["gray", "bgr24", "rgb24"]).target.pix_fmt == "bgr24"
    assert plan("scale=32:-4:force_divisible_by=2", v).target.height == 24
    assert plan("transpose=4", Video("gray", 8, 4)).target.width == 8
    for bad in ("nope", "crop=100:100", "scale=ow:2", "format=nv12,scale=2:2", "hflip=1", "scale=640", "transpose=9", "format=bad"):
        with pytest.raises((FilterError, ValueError)):
            plan(bad, v)
    with pytest.raises(FilterError):
        plan("hflip", Video("yuyv422", 8, 8))


def test_pictures_compose():
    rng = np.random.default_rng(1)
    v = Video("yuv420p", 7, 5)
    data = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in v.format.plane_sizes(7, 5)]
    planes = picture.split(data, v)
    same = lambda a, b: all((x == y).all() for x, y in zip(a, b))
    assert same(picture.hflip(picture.hflip(planes)), planes) and same(picture.vflip(picture.vflip(planes)), planes)
    turned = planes
    for _ in range(4):
        turned = picture.transpose(turned, 1)
    assert same(turned, planes)
    assert same(picture.transpose(picture.transpose(planes, 0), 0), planes)
    for kernel in ("nearest", "bilinear", "bicubic", "area", "gauss", "sinc", "lanczos", "spline"):
        flat = [np.full_like(p, 90) for p in planes]
        out = picture.scale(flat, v, v.with_(width=12, height=3), kernel)
        assert all((p == 90).all() for p in out), kernel


def test_colours():
    v = Video("yuv420p", 2, 2)
    one = lambda y, u, w, full: picture.scale([np.full((2, 2, 1), y, np.uint8), np.full((1, 1, 1), u, np.uint8), np.full((1, 1, 1), w, np.uint8)], v.with_(color_range="pc" if full else "tv"), v.with_(pix_fmt="rgb24"))[0][0, 0].tolist()
    assert one(126, 64, 128, False) == [128, 153, 0]
    assert one(90, 240, 90, True) == [37, 79, 255]


def test_layouts():
    assert layouts.Layout.parse("5.1").count == 6 and layouts.Layout.parse("0x3").describe() == "stereo" and layouts.Layout.parse("FL+FR").describe() == "stereo"
    assert layouts.Layout.default(8).describe() == "7.1" and layouts.Layout.parse("6c").describe() == "5.1"
    m = layouts.matrix(layouts.Layout.parse("5.1"), layouts.Layout.parse("stereo"))
    assert np.allclose(np.abs(m).sum(axis=1), 1) and m[0][0] > m[0][2] > 0 and m[0][3] == 0
    assert layouts.matrix(layouts.Layout.parse("mono"), layouts.Layout.parse("stereo")) == [[pytest.approx(math.sqrt(0.5))]] * 2
    assert layouts.matrix(layouts.Layout.parse("stereo"), layouts.Layout.parse("mono"))[0] == [pytest.approx(0.5)] * 2


def test_y4m_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = Video("yuv420p", 10, 6, Rational(1, 10), Rational(10, 1), Rational(1, 1), "tv", chroma_loc="left")
    frames = [rng.integers(0, 256, v.format.frame_bytes(10, 6), dtype=np.uint8).tobytes() for _ in range(7)]
    path = tmp_path / "a.y4m"
    path.write_bytes(c.y4m_write_header(v) + b"".join(b"FRAME\n" + f for f in frames))
    df, got = media.read_video(spark, str(path))
    assert got == v
    assert [b"".join(map(bytes, r.planes)) for r in df.orderBy("n").collect()] == frames
    media.save(media.y4m_bytes(df, got), str(tmp_path / "b.y4m"))
    assert (tmp_path / "b.y4m").read_bytes() == path.read_bytes()
    media.save(media.raw_bytes(df), str(tmp_path / "c.yuv"))
    raw, _ = media.read_video(spark, str(tmp_path / "c.yuv"), size=(10, 6))
    assert raw.count() == 7
    datasource.register(spark)
    ranged = spark.read.format("mediaframe").option("path", str(path)).option("records_per_partition", "3").load()
    assert ranged.rdd.getNumPartitions() == 3
    assert [b"".join(map(bytes, r.planes)) for r in ranged.orderBy("n").collect()] == frames
    flipped, _ = filter_video(df, got, "vflip,vflip")
    assert [list(map(bytes, r.planes)) for r in flipped.orderBy("n").collect()] == [list(map(bytes, r.planes)) for r in df.orderBy("n").collect()]


def test_moving_crop(spark):
    frame = bytearray(range(64))
    df = spark.createDataFrame([(0, n, n, 1, [frame]) for n in range(5)], "stream_id long, n long, pts long, duration long, planes array<binary>")
    out, v = filter_video(df, Video("gray", 8, 8), "crop=2:2:n:0")
    assert [bytes(r.planes[0])[0] for r in out.orderBy("n").collect()] == [0, 1, 2, 3, 4] and (v.width, v.height) == (2, 2)


@pytest.mark.parametrize("codec", ["pcm_u8", "pcm_s16le", "pcm_s24le", "pcm_s32le", "pcm_f32le"])
@pytest.mark.parametrize("layout, rate", [("mono", 8000), ("stereo", 44100), ("5.1", 48000), ("stereo", 96000)])
def test_wav_round_trip(spark, tmp_path, codec, layout, rate):
    rng = np.random.default_rng(3)
    bits = c.CODECS[codec][1]
    audio = c.Audio(codec, rate, layouts.Layout.parse(layout), bits, bits // 8 * layouts.Layout.parse(layout).count)
    samples = rng.integers(-100, 100, 333 * audio.layout.count)
    raw = media.encode_samples((samples + 128 if codec == "pcm_u8" else samples << 8) if codec[4] != "f" else samples / 128, codec)
    path = tmp_path / "a.wav"
    path.write_bytes(c.wav_write_header(audio, len(raw)) + raw + b"\0" * (len(raw) % 2))
    assert media.wav_type(spark, str(path)) == audio
    if layout == "5.1" or codec != "pcm_s16le":
        assert c.wav_header(path.read_bytes())[0] == audio
        return
    packets = media.read_packets(spark, str(path))
    pcm = media.decode_pcm(packets, audio)
    again = media.encode_pcm(pcm, audio, 100)
    media.save(media.wav_bytes(again, audio), str(tmp_path / "b.wav"))
    assert (tmp_path / "b.wav").read_bytes() == path.read_bytes()


def test_mpeg_and_adts_scans():
    word = 0xFFFB9064
    h = c.mpeg_header(word)
    assert (h.layer, h.sample_rate, h.bit_rate, h.frame_bytes, h.samples, h.channels) == (3, 44100, 128000, 417, 1152, 2)
    data = b"ID3\x04\x00\x00\x00\x00\x00\x05hello" + (word.to_bytes(4, "big") + bytes(413)) * 9
    assert [(p, t) for p, t, _ in c.mpeg_frames(data)][:2] == [(15, 0), (432, 1152)]
    assert c.pick("x", (0xFFFB1064).to_bytes(4, "big").ljust(104, b"\0") * 9) == "mp3" and c.pick("x.MP3", b"") == "mp3"
    size = 20
    adts = bytes([0xFF, 0xF1, 1 << 6 | 4 << 2, 2 << 6 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 31, 0xFC]) + bytes(13)
    assert [(p, t, a.sample_rate, a.channels) for p, t, a in c.adts_frames(adts * 3)] == [(0, 0, 44100, 2), (20, 1024, 44100, 2), (40, 2048, 44100, 2)]
    assert c.pick("x", adts * 5) == "aac"
    with pytest.raises(c.ContainerError):
        c.pick("x", b"nothing at all")
    assert c.probe(b"ab")["mp3"] == 0


def test_resampler_forms_agree(spark):
    from mediaframe.functions.fir import bank, resample as whole
    from mediaframe.operators import audio

    x = np.sin(np.arange(400) / 7.0) * 1000
    b = bank(32000, 48000)
    assert (b.phases, b.length % 2) == (2, 0) and np.allclose(b.taps[:2].sum(axis=1), 1, atol=1e-3)
    df = spark.createDataFrame([(1, k, 0, float(v)) for k, v in enumerate(x)], "stream_id long, k long, ch int, v double")
    rows = {r.k: r.v for r in audio.resample_rows(df, 48000, 32000).collect()}
    signal = {r.k: r.v for r in audio.resample(df, 48000, 32000).collect()}
    plain = whole(x, b)
    assert rows.keys() == signal.keys() == set(range(len(plain)))
    assert np.allclose([rows[k] for k in range(len(plain))], plain) and np.allclose([signal[k] for k in range(len(plain))], plain)
    for block in (7, 50, 1000):
        parts = {r.k: r.v for r in audio.resample(df, 48000, 32000, block=block).collect()}
        assert parts.keys() == signal.keys() and np.allclose([parts[k] for k in range(len(plain))], plain)
    odd = {r.k: r.v for r in audio.resample(df, 48000, 44100, block=64).collect()}
    assert np.allclose([odd[k] for k in range(len(odd))], whole(x, bank(44100, 48000)))
    middle = plain[60:200]
    assert np.abs(middle - np.sin((np.arange(60, 200) * 1.5) / 7.0) * 1000).max() < 5
    assert len(whole(np.zeros(48000), bank(44100, 48000))) == 44100


def test_streaming_is_batch(spark, tmp_path):
    from mediaframe.plans.graph import FRAME

    frame = bytearray(range(64))
    df = spark.createDataFrame([(0, n, n, 1, [frame]) for n in range(20)], FRAME)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, v = filter_video(stream, Video("gray", 8, 8), "hflip,crop=4:4")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.n, bytes(r.planes[0])) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.n, bytes(r.planes[0])) for r in filter_video(df, Video("gray", 8, 8), "hflip,crop=4:4")[0].collect()}
    assert got == want


def test_silent_channels(spark):
    from mediaframe.operators import audio

    df = spark.createDataFrame([(1, k, ch, k * 10 + ch) for k in range(3) for ch in range(2)], "stream_id long, k long, ch int, v int")
    got = {(r.k, r.ch): r.v for r in audio.select_channels(df, [1, -1, 0], "u8").collect()}
    assert got == {(k, ch): [k * 10 + 1, 128, k * 10][ch] for k in range(3) for ch in range(3)}
    assert audio.select_channels(df, [0]).count() == 3


def test_overdriven_floats_wrap_before_they_clip(spark):
    from pyspark.sql import functions as F

    from mediaframe.functions import samples

    df = spark.createDataFrame([(float(2**28),), (1.5,), (-1.5,), (float("nan"),)], "v double")
    got = df.select(samples.cast(F.col("v"), "dbl", "u8").alias("u8"), samples.cast(F.col("v"), "dbl", "s16").alias("s16"), samples.cast(F.col("v"), "dbl", "s32").alias("s32"), samples.cast(F.col("v"), "dbl", "s64").alias("s64")).collect()
    assert [tuple(r) for r in got] == [(128, 0, 2**31 - 1, 2**63 - 1), (255, 32767, 2**31 - 1, 2**63 - 1), (0, -32768, -(2**31), -(2**63)), (128, 0, 0, 0)]


def test_files_that_arrive_later(spark, tmp_path):
    v = Video("gray", 4, 2)
    put = lambda name, n: (tmp_path / name).write_bytes(c.y4m_write_header(v) + b"".join(b"FRAME\n" + bytes([n + i] * 8) for i in range(n)))
    put("a.y4m", 2)
    df, got = media.read_video(spark, str(tmp_path / "*.y4m"), stream=True)
    assert df.isStreaming and (got.pix_fmt, got.width) == ("gray", 4)
    out, _ = filter_video(df, got, "vflip")

    def run():
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 2
    put("b.y4m", 3)
    assert run() == 5
