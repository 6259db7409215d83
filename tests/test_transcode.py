import numpy as np
import pandas as pd
import pytest

from mediaframe.functions.layouts import Layout
from mediaframe.functions.picture import Video
from mediaframe.functions.rational import Rational
from mediaframe.plans.transcode import OptionError, Spec, describe_audio, describe_video, parse_rate, plan_audio, transcode
from mediaframe.sources import containers as c, media, nal
from mediaframe.streaming import clock


@pytest.fixture
def y4m(tmp_path):
    v = Video("yuv420p", 32, 16, Rational(1, 10), Rational(10, 1))
    rng = np.random.default_rng(4)
    path = tmp_path / "in.y4m"
    path.write_bytes(c.y4m_write_header(v) + b"".join(b"FRAME\n" + rng.integers(0, 256, v.format.frame_bytes(32, 16), dtype=np.uint8).tobytes() for _ in range(4)))
    return path


def test_video(spark, y4m, tmp_path):
    done = transcode(spark, Spec(str(y4m), str(tmp_path / "o.raw"), size=(16, 8), pix_fmt="rgb24"))
    assert (done.frames, done.bytes) == (4, 4 * 16 * 8 * 3) and "frame=    4" in done.line() and "time=00:00:00.40" in done.line()
    same = transcode(spark, Spec(str(y4m), str(tmp_path / "o.y4m"), filters="null"))
    assert same.frames == 4 and (tmp_path / "o.y4m").read_bytes() == y4m.read_bytes()
    with pytest.raises(OptionError):
        transcode(spark, Spec(str(y4m), str(tmp_path / "o.y4m")))
    with pytest.raises(OptionError):
        transcode(spark, Spec(str(y4m), str(tmp_path / "p.y4m"), sample_rate=8000))


def test_audio(spark, tmp_path):
    a = c.Audio("pcm_s16le", 48000, Layout.parse("mono"), 16, 2)
    wave = (np.sin(np.arange(4800) / 20) * 20000).astype("<i2")
    path = tmp_path / "in.wav"
    path.write_bytes(c.wav_write_header(a, wave.nbytes) + wave.tobytes())
    same = transcode(spark, Spec(str(path), str(tmp_path / "same.wav")))
    assert same.frames == 4800 and (tmp_path / "same.wav").read_bytes() == path.read_bytes()
    done = transcode(spark, Spec(str(path), str(tmp_path / "o.wav"), sample_rate=44100, channels=2, sample_fmt="flt"))
    got, start, end = c.wav_header((tmp_path / "o.wav").read_bytes())
    assert (got.codec, got.sample_rate, got.layout.describe(), (end - start) // 8) == ("pcm_f32le", 44100, "stereo", 4410)
    assert done.seconds == pytest.approx(0.1, abs=0.01)
    values = np.frombuffer((tmp_path / "o.wav").read_bytes()[start:end], "<f4").reshape(-1, 2)
    want = np.sin(np.arange(4410) * 48 / 44.1 / 20) * 20000 / 32768 * np.sqrt(0.5)
    assert np.abs(values[100:-100, 0] - want[100:-100]).max() < 0.01 and (values[:, 0] == values[:, 1]).all()
    with pytest.raises(OptionError):
        transcode(spark, Spec(str(path), str(tmp_path / "x.wav"), filters="hflip"))


def test_plans_and_texts():
    a = c.Audio("pcm_s16le", 48000, Layout.parse("5.1"), 16, 12)
    assert plan_audio(a, Spec("", "", sample_rate=44100, channels=2))[1] == ["to_float", "mix", "resample", "from_float"]
    mono = c.Audio("pcm_s16le", 44100, Layout.parse("mono"), 16, 2)
    assert plan_audio(mono, Spec("", "", sample_rate=48000, channels=2))[1] == ["to_float", "resample", "mix", "from_float"]
    assert plan_audio(mono, Spec("", ""))[1] == [] and plan_audio(mono, Spec("", "", sample_fmt="u8"))[1] == ["cast"]
    assert describe_audio(a) == "Audio: pcm_s16le, 48000 Hz, 5.1, 4608 kb/s"
    assert describe_video(Video("yuv420p", 128, 96, sar=Rational(1, 1))) == "Video: rawvideo, yuv420p, 128x96 [SAR 1:1 DAR 4:3], 25 fps"
    assert parse_rate("30000:1001") == Rational(30000, 1001) and parse_rate("25") == Rational(25, 1)


def test_nal_units(spark):
    bits = "01000010" + "0" * 8 + "00011110" + "1" + "1" + "1" + "1" + "010" + "1" + "00110" + "00100" + "1" + "1" + "0" + "0"
    bits += "1" + "0" * (-(len(bits) + 1) % 8)
    sps = int(bits, 2).to_bytes(len(bits) // 8, "big")
    stream = b"\0\0\0\1\x67" + sps + b"\0\0\1\x65\x01\0\0\3\1\xff\0\0"
    got = list(nal.units(stream))
    assert [(t, r) for _, t, r, _ in got] == [(7, 3), (5, 3)] and got[1][3] == b"\x01\0\0\1\xff"
    s = nal.sequence_set(got[0][3])
    assert (s.profile, s.level, s.width, s.height, s.frame_bits, s.references) == (66, 30, 96, 64, 4, 1)
    df = spark.createDataFrame([(1, bytearray(stream)), (2, None)], "stream_id long, data binary")
    assert [(r.stream_id, r.seq, r.type) for r in nal.split(df).orderBy("seq").collect()] == [(1, 0, 7), (1, 1, 5)]


def test_clock(spark, tmp_path):
    assert clock.step(None, 5, 10, 0) == (0, 0, 15)
    assert clock.step(15, 20, 10, 2) == (5, 0, 30) and clock.step(15, 10, 10, 2) == (0, 5, 20) and clock.step(15, 16, 10, 2) == (0, 0, 25)
    for part, rows in enumerate([[(1, 0, 10), (2, 0, 5)], [(1, 14, 10), (2, 3, 5)], [(1, 20, 10)]]):
        spark.createDataFrame(rows, "stream_id long, pts long, samples long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id long, pts long, samples long").parquet(str(tmp_path / "in"))
    q = clock.repair(stream).writeStream.format("memory").queryName("repaired").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.stream_id, r.pts): (r.samples, r.silence, r.dropped) for r in spark.table("repaired").collect()}
    assert got == {(1, 0): (10, 0, 0), (1, 14): (10, 4, 0), (1, 24): (6, 0, 4), (2, 0): (5, 0, 0), (2, 5): (3, 0, 2)}
