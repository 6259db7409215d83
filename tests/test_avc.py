"""Decoding of H.264: against streams made by a plain writer and against the formulas of the standard, pixel by pixel."""

from __future__ import annotations

import numpy as np
import pytest

from mediaframe.errors import MediaError
from mediaframe.functions import avc, blocks, cavlc, deblock, intra
from mediaframe.operators import avc as op
from mediaframe.plans.transcode import Spec, transcode
from mediaframe.sources import media, nal
from tests import avc_writer as w


def noise(seed, *shape):
    return np.random.default_rng(seed).integers(0, 256, shape)


def planes(raw, width, height):
    return [np.frombuffer(p, np.uint8).reshape(height >> c, width >> c).astype(int) for c, p in zip((0, 1, 1), raw)]


def test_codes_are_prefix_codes():
    tables = [cavlc.token_codes(c) for c in (-1, 0, 2, 4, 8)]
    tables += [cavlc.zero_codes(n, False) for n in range(1, 16)] + [cavlc.zero_codes(n, True) for n in range(1, 4)] + [cavlc.run_codes(n) for n in range(1, 8)]
    for table in tables:
        words = [format(b, f"0{n}b") for _, n, b in table]
        assert len(set(words)) == len(words)
        assert not any(a != b and b.startswith(a) for a in words for b in words)
    assert [len(cavlc.token_codes(c)) for c in (-1, 0, 2, 4, 8)] == [14, 62, 62, 62, 62]


def test_blocks_come_back():
    rng = np.random.default_rng(3)
    for trial in range(1500):
        most = (4, 15, 16)[trial % 3]
        context = -1 if most == 4 else int(rng.integers(0, 17))
        scale = (1, 2, 40, 3000)[trial % 4]
        levels = [int(v) if rng.random() < (0.2, 0.6, 1.0)[trial % 5 % 3] else 0 for v in np.rint(rng.normal(0, scale, most))]
        out = nal.Writer()
        w.block(out, levels, context)
        size = out.size
        b = nal.Bits(next(nal.units(out.unit(1)))[3])
        n, got = cavlc.block(b, context, most)
        assert got == levels and n == sum(v != 0 for v in levels) and b.at == size and not b.more()


def test_broken_bits_raise():
    with pytest.raises(MediaError):
        nal.Bits(b"\0").read(9)
    with pytest.raises(MediaError):
        cavlc.block(nal.Bits(b"\0" * 4), 0, 16)


def literal_4x4(mode, p):
    """The standard's formulas; p(x, y) is a pixel of the border."""
    out = np.zeros((4, 4), int)
    two = lambda a, b: (p(*a) + p(*b) + 1) >> 1
    three = lambda a, b, c: (p(*a) + 2 * p(*b) + p(*c) + 2) >> 2
    for y in range(4):
        for x in range(4):
            if mode == 3:
                v = (p(6, -1) + 3 * p(7, -1) + 2) >> 2 if x == y == 3 else three((x + y, -1), (x + y + 1, -1), (x + y + 2, -1))
            elif mode == 4:
                v = three((x - y - 2, -1), (x - y - 1, -1), (x - y, -1)) if x > y else three((-1, y - x - 2), (-1, y - x - 1), (-1, y - x)) if x < y else three((0, -1), (-1, -1), (-1, 0))
            elif mode == 5:
                z, k = 2 * x - y, x - (y >> 1)
                v = three((-1, y - 1), (-1, y - 2), (-1, y - 3)) if z < -1 else three((-1, 0), (-1, -1), (0, -1)) if z == -1 else three((k - 2, -1), (k - 1, -1), (k, -1)) if z % 2 else two((k - 1, -1), (k, -1))
            elif mode == 6:
                z, k = 2 * y - x, y - (x >> 1)
                v = three((x - 1, -1), (x - 2, -1), (x - 3, -1)) if z < -1 else three((-1, 0), (-1, -1), (0, -1)) if z == -1 else three((-1, k - 2), (-1, k - 1), (-1, k)) if z % 2 else two((-1, k - 1), (-1, k))
            elif mode == 7:
                k = x + (y >> 1)
                v = three((k, -1), (k + 1, -1), (k + 2, -1)) if y % 2 else two((k, -1), (k + 1, -1))
            else:
                z, k = x + 2 * y, y + (x >> 1)
                v = p(-1, 3) if z > 5 else (p(-1, 2) + 3 * p(-1, 3) + 2) >> 2 if z == 5 else three((-1, k), (-1, k + 1), (-1, k + 2)) if z % 2 else two((-1, k), (-1, k + 1))
            out[y, x] = v
    return out


@pytest.mark.parametrize("mode", range(3, 9))
def test_small_predictions(mode):
    for seed in range(5):
        border = noise(seed, 13)
        left, above, right, corner = border[:4], border[4:8], border[8:12], int(border[12])
        whole = np.concatenate([above, right])
        p = lambda x, y: corner if x == y == -1 else int(left[y]) if x == -1 else int(whole[x])
        assert (intra.predict_4x4(mode, left, above, corner, right) == literal_4x4(mode, p)).all()
        whole = np.concatenate([above, np.full(4, above[3])])
        assert (intra.predict_4x4(mode, left, above, corner, None) == literal_4x4(mode, p)).all()
    with pytest.raises(MediaError):
        intra.predict_4x4(mode, None, None, None, None)


def test_other_predictions():
    left, above = np.arange(16) * 2 + 10, np.arange(16) * 3 + 11
    slope = intra.plane(left, above, 8)
    assert (slope[:, 1:] - slope[:, :-1] == 3).all() and (slope[1:] - slope[:-1] == 2).all() and slope[15, 15] == (left[15] + above[15]) - 8
    assert (intra.predict_16x16(2, None, None, None) == 128).all()
    assert intra.predict_16x16(2, left, None, None)[0, 0] == (left.sum() + 8) >> 4
    got = intra.predict_chroma(0, left[:8], above[:8], None)
    assert got[0, 0] == (left[:4].sum() + above[:4].sum() + 4) >> 3 and got[0, 4] == (above[4:8].sum() + 2) >> 2 and got[4, 0] == (left[4:8].sum() + 2) >> 2
    assert got[4, 4] == (left[4:8].sum() + above[4:8].sum() + 4) >> 3
    assert intra.predict_chroma(0, left[:8], None, None)[0, 4] == (left[:4].sum() + 2) >> 2


def literal_smooth(line, strength, qp, luma):
    half = len(line) // 2
    p, q = [int(v) for v in line[:half][::-1]], [int(v) for v in line[half:]]
    if qp < 16 or not strength:
        return list(line)
    alpha, beta = deblock.ALPHA[qp - 16], deblock.BETA[qp - 16]
    if not (abs(p[0] - q[0]) < alpha and abs(p[1] - p[0]) < beta and abs(q[1] - q[0]) < beta):
        return list(line)
    a, b = p[:], q[:]
    clip = lambda low, high, v: max(low, min(high, v))
    near = [luma and abs(s[2] - s[0]) < beta for s in (p, q)]
    if strength < 4:
        move = deblock.MOVES[qp - 17][strength - 1] if qp > 16 else 0
        most = move + sum(near) if luma else move + 1
        d = clip(-most, most, (((q[0] - p[0]) << 2) + (p[1] - q[1]) + 4) >> 3)
        a[0], b[0] = clip(0, 255, p[0] + d), clip(0, 255, q[0] - d)
        for out, s, n in ((a, p, near[0]), (b, q, near[1])):
            if n:
                out[1] = s[1] + clip(-move, move, (s[2] + ((p[0] + q[0] + 1) >> 1) - (s[1] << 1)) >> 1)
    else:
        for out, s, o, n in ((a, p, q, near[0]), (b, q, p, near[1])):
            if n and abs(p[0] - q[0]) < (alpha >> 2) + 2:
                out[0] = (s[2] + 2 * s[1] + 2 * s[0] + 2 * o[0] + o[1] + 4) >> 3
                out[1] = (s[2] + s[1] + s[0] + o[0] + 2) >> 2
                out[2] = (2 * s[3] + 3 * s[2] + s[1] + s[0] + o[0] + 4) >> 3
            else:
                out[0] = (2 * s[1] + s[0] + o[1] + 2) >> 2
    return a[::-1] + b


@pytest.mark.parametrize("luma", [True, False])
def test_smoothing(luma):
    rng = np.random.default_rng(8)
    changed = 0
    for qp in (10, 16, 17, 25, 33, 40, 51):
        lines = np.clip(128 + np.rint(rng.normal(0, 4, (400, 8 if luma else 4))) + rng.integers(-6, 7, (400, 1)), 0, 255).astype(int)
        strength = rng.integers(0, 5, 400)
        want = [literal_smooth(line, s, qp, luma) for line, s in zip(lines, strength)]
        assert deblock.smoothed(lines, strength, qp, 0, 0, luma).tolist() == [list(map(int, x)) for x in want]
        changed += (np.array(want) != lines).any()
    assert changed >= 4


def test_plain_picture_and_its_crop():
    y, u, v = noise(1, 16, 16), noise(2, 8, 8), np.zeros((8, 8), int)
    s = w.slice_start("I", 0, True)
    w.plain(s, y, u, v)
    got = w.frames(w.sequence(1, 1) + w.picture() + s.unit(5))
    assert [p.tolist() for p in planes(got[0], 16, 16)] == [y.tolist(), u.tolist(), v.tolist()]
    got = w.frames(w.sequence(1, 1, (1, 2, 0, 3)) + w.picture() + s.unit(5))
    assert planes(got[0], 10, 10)[0].tolist() == y[:10, 2:12].tolist() and planes(got[0], 10, 10)[1].tolist() == u[:5, 1:6].tolist()


def coded_pair(kind, chroma_mode, levels=None, qp=26):
    """A macroblock of bytes, and one of 16x16 beside it: its type, chroma's mode, constant levels of luma."""
    y, u, v = noise(4, 16, 16), noise(5, 8, 8), noise(6, 8, 8)
    s = w.slice_start("I", 0, True)
    w.plain(s, y, u, v)
    s.ue(kind), s.ue(chroma_mode), s.se(0)
    w.block(s, levels or [0] * 16, 16)
    got = planes(w.frames(w.sequence(2, 1) + w.picture(qp) + s.unit(5))[0], 32, 16)
    return y, u, v, got


def test_large_block_from_the_left():
    y, u, v, got = coded_pair(2, 1)
    assert (got[0][:, 16:] == y[:, 15:]).all() and (got[1][:, 8:] == u[:, 7:]).all() and (got[2][:, 8:] == v[:, 7:]).all()
    y, u, v, got = coded_pair(3, 0)
    assert (got[0][:, 16:] == (y[:, 15].sum() + 8) >> 4).all() and (got[1][:4, 8:] == (u[:4, 7].sum() + 2) >> 2).all()


@pytest.mark.parametrize("qp", [4, 26, 40])
def test_constant_level(qp):
    """One constant level of 4x4 constants is a step that is the same in all blocks."""
    y, _, _, got = coded_pair(3, 0, [5] + [0] * 15, qp)
    scale = 16 * blocks.SCALES[qp % 6][0]
    constant = 5 * scale << qp // 6 - 6 if qp >= 36 else (5 * scale + (1 << 5 - qp // 6)) >> 6 - qp // 6
    assert (got[0][:, 16:] == np.clip(((y[:, 15].sum() + 8) >> 4) + ((constant + 32) >> 6), 0, 255)).all()


def test_small_blocks_with_levels():
    """4x4 blocks, all from the left, one of them with levels."""
    y, u, v = noise(4, 16, 16), noise(5, 8, 8), noise(6, 8, 8)
    s = w.slice_start("I", 0, True)
    w.plain(s, y, u, v)
    s.ue(0)
    for i in range(16):  # beside bytes the mean (2) is expected, later on mode 1 itself
        x, row = avc.ORDER[i]
        above_missing = row == 0
        expected = 2 if above_missing else min(2 if x == 0 else 1, 1)
        if expected == 1:
            s.write(1, 1)
        else:
            s.write(1, 0), s.write(3, 1)
    s.ue(1)
    s.ue(avc.CODED_INTRA.index(1)), s.se(3)
    first = [7, -2, 0, 1] + [0] * 12
    w.block(s, first, 16), w.block(s, [0] * 16, 3), w.block(s, [0] * 16, (16 + 3 + 1) // 2), w.block(s, [0] * 16, 0)
    got = planes(w.frames(w.sequence(2, 1) + w.picture() + s.unit(5))[0], 32, 16)
    level = np.zeros(16, int)
    level[avc.ZIGZAG] = first
    block = np.clip(y[:4, 15:] + blocks.residual(blocks.scaled(level.reshape(4, 4), 29)), 0, 255)
    assert (got[0][:4, 16:20] == block).all()
    assert (got[0][:4, 20:] == block[:, 3:]).all() and (got[0][4:, 16:] == y[4:, 15:]).all()


def moving(parts, kind, references=1, order=None):
    """Two pictures of 2x2 macroblocks of bytes and noise; in the second the first macroblock is moved, the others are skipped."""
    first = [noise(k, 32 >> c, 32 >> c) for k, c in zip((1, 2, 3), (0, 1, 1))]
    s = w.slice_start("I", 0, True, order=order and order[0])
    for at in range(4):
        y, x = divmod(at, 2)
        w.plain(s, *(p[y * n : y * n + n, x * n : x * n + n] for p, n in zip(first, (16, 8, 8))))
    data = w.sequence(2, 2, references=references, order_type=2 if order is None else 0) + w.picture() + s.unit(5)
    p = w.slice_start("P", 1, False, order=order and order[1])
    p.ue(0), p.ue(kind)
    for numbers in parts:
        for n in numbers:
            p.se(n)
    p.ue(0), p.ue(3)
    return first, data + p.unit(1, 2)


def test_moved_picture():
    """A movement of a whole macroblock; those after it, skipped, take it over where the rules say so."""
    first, data = moving([(-9, 6)], 0)
    got = planes(w.frames(data)[1], 32, 32)
    assert (got[0][:16, :16] == blocks.moved_luma(first[0], -9, 6, 16, 16)).all()
    assert (got[1][:8, :8] == blocks.moved_chroma(first[1], -9, 6, 8, 8)).all()
    # the second has nothing above it and the third nothing to the left: both stand still; the fourth: the median of 0, 0 and the corner
    assert (got[0][:16, 16:] == first[0][:16, 16:]).all() and (got[0][16:] == first[0][16:]).all() and (got[2][4 * 2 :] == first[2][8:]).all()


def test_moved_halves():
    """Upper half (4, 0), lower half expected as the upper, by (0, 8) more; left and right likewise."""
    first, data = moving([(4, 0), (0, 8)], 1)
    got = planes(w.frames(data)[1], 32, 32)[0]
    assert (got[:8, :16] == blocks.moved_luma(first[0], 4, 0, 16, 8)).all() and (got[8:16, :16] == blocks.moved_luma(first[0], 4, 32 + 8, 16, 8)).all()
    first, data = moving([(4, 2), (1, 1)], 2)
    got = planes(w.frames(data)[1], 32, 32)[0]
    # with neither above nor behind it the right half expects what the left one has
    assert (got[:16, :8] == blocks.moved_luma(first[0], 4, 2, 8, 16)).all() and (got[:16, 8:16] == blocks.moved_luma(first[0], 32 + 5, 3, 8, 16)).all()


def test_frames_by_period(spark):
    """Two periods of two pictures each, the second of a period shown first; broken and empty streams."""
    _, data = moving([(0, 0)], 0, order=(4, 2))
    assert [places for places, _ in op.split_periods(data + data)] == [[1, 0], [3, 2]]
    rows = spark.createDataFrame([(1, bytearray(data + data)), (2, bytearray(b"")), (3, None), (4, bytearray(data))], "stream_id long, data binary")
    got = {(r.stream_id, r.n): [bytes(p) for p in r.planes] for r in op.decode(rows).collect()}
    alone = w.frames(data)
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (4, 0), (4, 1)]
    assert got[1, 3] == got[1, 1] == got[4, 1] == alone[0] and got[1, 0] == got[1, 2] == alone[1]
    assert op.video_type(data).width == 32


def test_smoothed_picture():
    """Two flat macroblocks, the second brighter by a constant level: only the edge between them is smoothed."""

    def stream(smoothing):
        s = w.slice_start("I", 0, True, smoothing=smoothing)
        for levels, context in (([0] * 16, 0), ([3] + [0] * 15, 0)):
            s.ue(3), s.ue(0), s.se(0)
            w.block(s, levels, context)
        return planes(w.frames(w.sequence(2, 1) + w.picture(36) + s.unit(5))[0], 32, 16)

    rough, smooth = stream(1), stream(0)
    assert (rough[0][:, :16] == 128).all() and (rough[0][:, 16:] > 128).all()
    want = rough[0].copy()
    want[:, 12:20] = [literal_smooth(line, 4, 36, True) for line in rough[0][:, 12:20]]
    assert (want != rough[0]).any() and (smooth[0] == want).all() and (smooth[1] == 128).all()


def test_quarters_and_references():
    """Quarters in two parts each, from two pictures; the list begins with the latest."""
    head = w.sequence(1, 1, references=2) + w.picture(references=2)
    bytes_of = [[noise(10 * k + c, 16 >> (c > 0), 16 >> (c > 0)) for c in range(3)] for k in range(2)]
    out = head
    for k in range(2):
        s = w.slice_start("I", k, k == 0)
        w.plain(s, *bytes_of[k])
        out += s.unit(5 if k == 0 else 1)
    p = w.slice_start("P", 2, False)
    p.ue(0), p.ue(3)
    for kind in (0, 1, 2, 0):
        p.ue(kind)
    for ref in (0, 1, 1, 0):
        p.write(1, 1 - ref)
    wanted = [((0, 0, 8, 8), 0, (4, 8)), ((8, 0, 8, 4), 1, (2, 2)), ((8, 4, 8, 4), 1, (-3, 1)), ((0, 8, 4, 8), 1, (0, 5)), ((4, 8, 4, 8), 1, (7, -7)), ((8, 8, 8, 8), 0, (12, 0))]
    # expected: nothing around; nothing above, the left has another reference and stands alone; what is above; ...
    expected = [(0, 0), (4, 8), (2, 2), None, None, None]
    neighbours = {3: [(-2, (0, 0)), (0, (4, 8)), (0, (4, 8))], 4: [(1, (0, 5)), (0, (4, 8)), (1, (-3, 1))], 5: [(1, (7, -7)), (1, (-3, 1)), (0, (4, 8))]}
    for i, (_, ref, move) in enumerate(wanted):
        if expected[i] is None:
            same = [m for r, m in neighbours[i] if r == ref]
            expected[i] = same[0] if len(same) == 1 else tuple(sorted(m[j] for _, m in neighbours[i])[1] for j in (0, 1))
        p.se(move[0] - expected[i][0]), p.se(move[1] - expected[i][1])
    p.ue(0)
    got = planes(w.frames(out + p.unit(1))[2], 16, 16)
    for (x, y, width, height), ref, (dx, dy) in wanted:
        source = bytes_of[1 - ref]
        assert (got[0][y : y + height, x : x + width] == blocks.moved_luma(source[0], 4 * x + dx, 4 * y + dy, width, height)).all()
        chroma = blocks.moved_chroma(source[2], 4 * x + dx, 4 * y + dy, width // 2, height // 2)
        assert (got[2][y // 2 : (y + height) // 2, x // 2 : (x + width) // 2] == chroma).all()


def test_weights_and_slices():
    """A skipped picture in two slices, each with weights of its own for what it takes over."""
    first = [noise(k, 32 >> (k > 1), 16 >> (k > 1)) for k in (1, 2, 3)]
    s = w.slice_start("I", 0, True)
    for at in range(2):
        w.plain(s, *(p[at * n : at * n + n] for p, n in zip(first, (16, 8, 8))))
    data = w.sequence(1, 2) + w.picture(weighted=1) + s.unit(5)
    weights = ((3, 0, (5, -7), (2, 4), (-1, 100)), (0, 2, (1, 9), (3, 0), (4, -3)))
    for at, some in enumerate(weights):
        p = w.slice_start("P", 1, False, first=at, weights=some)
        p.ue(1)
        data += p.unit(1)
    got = planes(w.frames(data)[1], 16, 32)
    for at, some in enumerate(weights):
        for plane, n in enumerate((16, 8, 8)):
            shift, (weight, offset) = some[plane > 0], some[2 + plane]
            half = 1 << shift - 1 if shift else 0
            want = np.clip(((first[plane][at * n : at * n + n] * weight + half) >> shift) + offset, 0, 255)
            assert (got[plane][at * n : at * n + n] == want).all()


def test_a_file_is_read(spark, tmp_path):
    _, data = moving([(-9, 6)], 0)
    (tmp_path / "in.h264").write_bytes(data)
    (tmp_path / "unnamed").write_bytes(data)
    for name in ("in.h264", "unnamed"):
        frames, video = media.read_video(spark, str(tmp_path / name))
        assert (video.pix_fmt, video.width, video.height) == ("yuv420p", 32, 32)
        assert [[bytes(p) for p in r.planes] for r in frames.orderBy("n").collect()] == w.frames(data)
    done = transcode(spark, Spec(str(tmp_path / "in.h264"), str(tmp_path / "out.y4m")))
    assert done.frames == 2 and (tmp_path / "out.y4m").read_bytes().startswith(b"YUV4MPEG2 W32 H32")


def test_unsupported_streams_say_so():
    s = w.slice_start("I", 0, True)
    s.ue(3), s.ue(0), s.se(0)
    w.block(s, [0] * 16, 0)
    good = w.sequence(1, 1) + w.picture() + s.unit(5)
    assert len(w.frames(good)) == 1
    with pytest.raises(MediaError, match="parameter sets"):
        w.frames(s.unit(5))
    with pytest.raises(MediaError, match="parts of a picture"):
        w.frames(w.sequence(2, 1) + w.picture() + s.unit(5))
    with pytest.raises(MediaError, match="too short|not there|no code|invalid|more"):
        w.frames(w.sequence(1, 1) + w.picture() + s.unit(5)[:5])


def test_messages():
    payload = bytes([5, 3, 1, 2, 3, 255, 1, 2, 9, 9, 0x80])
    assert list(nal.messages(payload)) == [(5, b"\1\2\3"), (256, b"\t\t")]
    assert list(nal.messages(bytes([5, 30, 1, 0x80]))) == [] and list(nal.messages(b"")) == []
