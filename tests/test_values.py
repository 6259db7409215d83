"""Transforms, source options, gapless counts and reads of parts of files."""

import numpy as np
import pytest

from mediaframe.errors import MediaError
from mediaframe.functions import blocks, mdct
from mediaframe.functions.rational import Rational, timestamp_string
from mediaframe.plans.graph import source_of, source_text
from mediaframe.sources import containers as c
from mediaframe.sources.media import head, read_packets


@pytest.mark.parametrize("name", mdct.WINDOWS)
@pytest.mark.parametrize("size", [4, 18, 64])
def test_overlaps_give_the_signal(name, size):
    w = mdct.window(name, size)
    assert np.allclose(w[:size] ** 2 + w[size:] ** 2, 1) and np.allclose(w, w[::-1])
    x = np.random.default_rng(size).standard_normal(6 * size)
    frames = np.stack([x[m * size : (m + 2) * size] for m in range(5)])
    back = mdct.inverse(mdct.forward(frames, name), name)
    out = np.zeros(6 * size)
    for m in range(5):
        out[m * size : (m + 2) * size] += back[m]
    assert np.allclose(out[size:-size], x[size:-size])


def test_mdct_of_one_cosine():
    size = 16
    x = np.cos(np.pi / size * (np.arange(2 * size) + 0.5 + size / 2) * 3.5)
    found = x @ mdct.basis(size).T
    assert np.argmax(np.abs(found)) == 3 and abs(found[3] - size) < 1e-9


def test_timestamps_as_seconds():
    told = {(None, 25): "NOPTS", (100, 25): "4", (0, 25): "0", (500, 1000): "0.5", (-3200, 25): "-128", (1, 90000): "0.0000111111", (1001, 30000): "0.0333667"}
    assert {k: timestamp_string(k[0], Rational(1, k[1])) for k in told} == told


def test_source_options():
    v = source_of("video_size=64x48:pix_fmt=yuv420p:time_base=1/25:frame_rate=25/1")
    assert (v.width, v.height, v.pix_fmt, v.time_base, v.frame_rate) == (64, 48, "yuv420p", Rational(1, 25), Rational(25, 1))
    assert source_of("64:48:gray:1/25:4/3").sar == Rational(4, 3)
    assert source_of(source_text(v)) == v
    for wrong in ("video_size=64x48:pix_fmt=yuv420p", "64:48:nothing:1/25", "0:48:gray:1/25", "64:48:gray:x", "64:48:gray:1/25:size=3"):
        with pytest.raises((MediaError, ValueError)):
            source_of(wrong)


def mp3(frames: int, delays: tuple[int, int] | None) -> bytes:
    frame = bytes([0xFF, 0xFB, 0x90, 0]) + bytes(413)
    if delays is None:
        return frame * frames
    told = b"Info" + (1).to_bytes(4, "big") + frames.to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (delays[0] << 12 | delays[1]).to_bytes(3, "big")
    return frame[:36] + told + frame[36 + len(told) :] + frame * frames


def test_gapless_packets_of_files(spark, tmp_path):
    (tmp_path / "b.mp3").write_bytes(mp3(5, (576, 1500)))
    name, first = head(spark, str(tmp_path), 10)
    assert name.endswith("b.mp3") and first == mp3(5, (576, 1500))[:10]
    rows = read_packets(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.pts for r in rows] == [0, 1152, 2304, 3456, 4608]
    assert [r.skip_samples for r in rows] == [1105, 0, 0, 0, 0]
    # 5 frames less 1500 samples, and the decoder's delay: 4789 on goes, 971 of the last frame's samples
    assert [r.discard_padding for r in rows] == [0, 0, 0, 0, 971]
    assert c.mpeg_gapless(mp3(4, None)) == (0, 0, 0)


def test_probe_needs_mostly_frames():
    data = mp3(5, None)
    assert c.probe(data)["mp3"] >= 25
    assert c.probe(b"\1" * 1500 + data[:417])["mp3"] <= 1


def test_moved_pictures():
    """Whole places copy; a flat picture stays flat; quarters are means; a slope is followed."""
    rng = np.random.default_rng(5)
    p = rng.integers(0, 256, (12, 16))
    assert (blocks.moved_luma(p, 8, 4, 6, 5) == p[1:6, 2:8]).all()
    assert (blocks.moved_luma(p, -4000, -4000, 3, 2) == p[0, 0]).all() and (blocks.moved_luma(p, 4000, 4000, 3, 2) == p[-1, -1]).all()
    flat = np.full((12, 16), 77)
    slope = np.tile(np.arange(16) * 8, (12, 1))
    for x in range(4):
        for y in range(4):
            assert (blocks.moved_luma(flat, 16 + x, 16 + y, 4, 4) == 77).all()
            assert (blocks.moved_luma(slope, 16 + x, 16 + y, 4, 4) == np.arange(4, 8) * 8 + 2 * x).all()
    # turned by a quarter, a picture gives the turned block
    for x, y in ((1, 3), (2, 1), (3, 2), (2, 2), (0, 3)):
        assert (blocks.moved_luma(p, 12 + x, 12 + y, 4, 4) == blocks.moved_luma(p.T, 12 + y, 12 + x, 4, 4).T).all()
    assert (blocks.moved_chroma(p, 16, 8, 4, 4) == p[1:5, 2:6]).all()
    assert (blocks.moved_chroma(slope, 16 + 3, 8, 4, 4) == np.arange(2, 6) * 8 + 3).all()


def test_residual_of_one_coefficient():
    level = np.zeros((4, 4), int)
    level[0, 0] = 5
    for qp in (0, 14, 27, 51):
        want = (5 * blocks.SCALES[qp % 6][0] << qp // 6) + 32 >> 6
        assert (blocks.residual(blocks.scaled(level, qp)) == want).all()
    level[0, 0], level[0, 1] = 0, 64
    assert blocks.residual(level).tolist() == [[1, 1, 0, -1]] * 4
