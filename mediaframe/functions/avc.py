"""Pictures of H.264 streams out of their units: I and P slices of progressive 8-bit 4:2:0 with variable-length codes.

Arithmetic coding, B slices, 8x8 transforms, interlace, slice groups and long-term references raise a MediaError.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from mediaframe.errors import MediaError
from mediaframe.functions import blocks, cavlc, deblock, intra
from mediaframe.sources.nal import Bits, SequenceSet, picture_set, sequence_set

#: Places of levels in a block by the order of coding (rows * 4 + columns).
ZIGZAG = np.array((0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15))
#: chroma's qp for luma's from 30 on; equal below.
CHROMA_QP = (29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39)
#: Which blocks have levels, by the number that is coded, for 4x4 blocks inside a picture and for others.
CODED_INTRA = (
    47, 31, 15, 0, 23, 27, 29, 30, 7, 11, 13, 14, 39, 43, 45, 46, 16, 3, 5, 10, 12, 19, 21, 26,
    28, 35, 37, 42, 44, 1, 2, 4, 8, 17, 18, 20, 24, 6, 9, 22, 25, 32, 33, 34, 36, 40, 38, 41,
)
CODED_INTER = (
    0, 16, 1, 2, 4, 8, 32, 3, 5, 10, 12, 15, 47, 7, 11, 13, 14, 6, 9, 31, 35, 37, 42, 44,
    33, 34, 36, 40, 39, 43, 45, 46, 17, 18, 20, 24, 19, 21, 26, 28, 23, 27, 29, 30, 22, 25, 38, 41,
)
#: (column, row) of the 16 blocks of a macroblock in the order of coding: quarters, and quarters of these.
ORDER = tuple(((i & 1) + 2 * (i >> 2 & 1), (i >> 1 & 1) + 2 * (i >> 3)) for i in range(16))
#: Parts (column, row, width, height in blocks) of a macroblock by its type, and of a quarter by its.
PARTS = (((0, 0, 4, 4),), ((0, 0, 4, 2), (0, 2, 4, 2)), ((0, 0, 2, 4), (2, 0, 2, 4)))
QUARTER_PARTS = (((0, 0, 2, 2),), ((0, 0, 2, 1), (0, 1, 2, 1)), ((0, 0, 1, 2), (1, 0, 1, 2)), ((0, 0, 1, 1), (1, 0, 1, 1), (0, 1, 1, 1), (1, 1, 1, 1)))
HADAMARD = np.array(((1, 1, 1, 1), (1, 1, -1, -1), (1, -1, -1, 1), (1, -1, 1, -1)))
#: References of blocks that are not there, and of blocks that have none.
MISSING, NONE = -2, -1


@dataclass
class Slice:
    first: int
    kind: str
    pps: dict
    sps: SequenceSet
    frame: int
    idr: bool
    importance: int
    order: tuple[int, ...]
    active: int = 0
    changes: list[tuple[int, int]] = field(default_factory=list)
    weights: list | None = None
    denominators: tuple[int, int] = (0, 0)
    marks: list[tuple[int, int]] = field(default_factory=list)
    qp: int = 26
    smoothing: int = 0
    alpha: int = 0
    beta: int = 0


def slice_header(b: Bits, type: int, importance: int, sequences: dict[int, SequenceSet], pictures: dict[int, dict]) -> Slice:
    first, kind, number = b.ue(), b.ue() % 5, b.ue()
    if number not in pictures or pictures[number]["sequence"] not in sequences:
        raise MediaError("a slice's parameter sets are missing")
    pps = pictures[number]
    sps = sequences[pps["sequence"]]
    if kind not in (0, 2) or pps["cabac"]:
        raise MediaError("only I and P slices with variable-length codes are supported")
    idr = type == 5
    frame = b.read(sps.frame_bits)
    if idr:
        b.ue()
    order: tuple[int, ...] = ()
    if sps.order_type == 0:
        order = (b.read(sps.order_bits), b.se() if pps["order_present"] else 0)
    elif sps.order_type == 1 and not sps.same_order:
        order = (b.se(), b.se() if pps["order_present"] else 0)
    if pps["redundant"] and b.ue():
        raise MediaError("redundant pictures are not supported")
    s = Slice(first, "P" if kind == 0 else "I", pps, sps, frame, idr, importance, order)
    if s.kind == "P":
        s.active = b.ue() + 1 if b.read(1) else pps["references_0"]
        if b.read(1):
            while (what := b.ue()) != 3:
                if what > 1:
                    raise MediaError("long-term references are not supported")
                s.changes.append((what, b.ue() + 1))
        if pps["weighted"]:
            _weights(b, s)
    if importance:
        if idr:
            b.read(1)
            if b.read(1):
                raise MediaError("long-term references are not supported")
        elif b.read(1):
            while what := b.ue():
                if what not in (1, 5):
                    raise MediaError("long-term references are not supported")
                s.marks.append((what, b.ue() + 1 if what == 1 else 0))
    s.qp = pps["qp"] + b.se()
    if pps["deblocking"]:
        s.smoothing = b.ue()
        if s.smoothing != 1:
            s.alpha, s.beta = 2 * b.se(), 2 * b.se()
    return s


def _weights(b: Bits, s: Slice) -> None:
    """(weight, offset) of each plane for each reference."""
    s.denominators = b.ue(), b.ue()
    s.weights = []
    for _ in range(s.active):
        row = [(1 << s.denominators[0], 0), *[(1 << s.denominators[1], 0)] * 2]
        if b.read(1):
            row[0] = b.se(), b.se()
        if b.read(1):
            row[1:] = [(b.se(), b.se()) for _ in range(2)]
        s.weights.append(row)


class Picture:
    """Planes and what later blocks and the smoothing need to know of each macroblock and each 4x4 block."""

    def __init__(self, sps: SequenceSet):
        self.across, self.down = sps.across, sps.down
        w, h = sps.across * 4, sps.down * 4
        self.planes = [np.zeros((16 * sps.down >> c, 16 * sps.across >> c), np.int64) for c in (0, 1, 1)]
        self.owner = np.full((sps.down, sps.across), -1)
        self.qp = np.zeros((sps.down, sps.across), np.int64)
        self.intra = np.zeros((sps.down, sps.across), bool)
        self.levels = [np.zeros((h >> c, w >> c), np.int64) for c in (0, 1, 1)]
        self.modes = np.full((h, w), 2)
        self.refs = np.full((h, w), NONE)
        self.moves = np.zeros((h, w, 2), np.int64)
        self.shown_by = np.full((h, w), -1)
        self.slices: list[Slice] = []
        self.frame = self.number = 0


class SliceDecoder:
    def __init__(self, b: Bits, s: Slice, picture: Picture, references: list[Picture]):
        self.b, self.s, self.pic, self.references = b, s, picture, references
        self.qp = s.qp
        self.number = len(picture.slices)
        picture.slices.append(s)

    def run(self) -> None:
        at, total, b = self.s.first, self.pic.across * self.pic.down, self.b
        while True:
            skipped = b.ue() if self.s.kind == "P" else 0
            if at + skipped > total:
                raise MediaError("more macroblocks than the picture has")
            for _ in range(skipped):
                self._start(at)
                self._skip()
                at += 1
            if skipped and not b.more():
                return
            if at >= total:
                raise MediaError("more macroblocks than the picture has")
            self._start(at)
            self._macroblock()
            at += 1
            if not b.more():
                return

    # where things are

    def _start(self, at: int) -> None:
        p = self.pic
        self.my, self.mx = divmod(at, p.across)
        if p.owner[self.my, self.mx] != -1:
            raise MediaError("a macroblock is coded twice")
        p.owner[self.my, self.mx] = self.number
        p.qp[self.my, self.mx] = self.qp
        self.bx, self.by = 4 * self.mx, 4 * self.my
        p.refs[self.by : self.by + 4, self.bx : self.bx + 4] = MISSING

    def _there(self, mx: int, my: int) -> bool:
        p = self.pic
        return 0 <= mx < p.across and 0 <= my < p.down and p.owner[my, mx] == self.number

    def _usable(self, mx: int, my: int) -> bool:
        """Whether pixels of a macroblock may predict others inside the picture."""
        return self._there(mx, my) and (not self.s.pps["constrained_intra"] or bool(self.pic.intra[my, mx]))

    def _context(self, plane: int, x: int, y: int) -> int:
        """The expected number of levels of the block (x, y) of a plane."""
        shift, found = 2 if plane == 0 else 1, []
        for nx, ny in ((x - 1, y), (x, y - 1)):
            if self._there(nx >> shift, ny >> shift):
                found.append(int(self.pic.levels[plane][ny, nx]))
        return (found[0] + found[1] + 1) >> 1 if len(found) == 2 else found[0] if found else 0

    def _border(self, plane: int, x: int, y: int, size: int):
        """(left, above, corner) of a block at pixel (x, y), each None if it may not be used."""
        a, shift = self.pic.planes[plane], 4 if plane == 0 else 3
        left = self._usable((x - 1) >> shift, y >> shift)
        above = self._usable(x >> shift, (y - 1) >> shift)
        corner = self._usable((x - 1) >> shift, (y - 1) >> shift)
        return a[y : y + size, x - 1] if left else None, a[y - 1, x : x + size] if above else None, int(a[y - 1, x - 1]) if corner else None

    # kinds of macroblocks

    def _macroblock(self) -> None:
        kind = self.b.ue()
        if self.s.kind == "P":
            if kind < 5:
                return self._inter(kind)
            kind -= 5
        p = self.pic
        p.intra[self.my, self.mx] = True
        p.refs[self.by : self.by + 4, self.bx : self.bx + 4] = NONE
        if kind == 25:
            return self._plain()
        if kind > 25:
            raise MediaError("invalid type of macroblock")
        modes = self._modes() if kind == 0 else None
        chroma_mode = self.b.ue()
        if kind == 0:
            code = self.b.ue()
            if code > 47:
                raise MediaError("invalid pattern of coded blocks")
            coded = CODED_INTRA[code]
        else:
            coded = 16 * ((kind - 1) // 4 % 3) + (15 if kind >= 13 else 0)
        if chroma_mode > 3:
            raise MediaError("invalid prediction of chroma")
        if coded or kind:
            self._change_qp()
        x, y = 16 * self.mx, 16 * self.my
        luma = self._luma(coded, kind != 0)
        if kind:
            p.planes[0][y : y + 16, x : x + 16] = self._sum(intra.predict_16x16((kind - 1) % 4, *self._border(0, x, y, 16)), _joined(luma, 4))
        else:
            self._small_blocks(modes, luma)
        self._chroma(coded, lambda plane: intra.predict_chroma(chroma_mode, *self._border(plane, x >> 1, y >> 1, 8)))

    def _plain(self) -> None:
        x, y, p = 16 * self.mx, 16 * self.my, self.pic
        raw = np.frombuffer(self.b.aligned_bytes(384), np.uint8)
        p.planes[0][y : y + 16, x : x + 16] = raw[:256].reshape(16, 16)
        p.planes[1][y >> 1 : (y >> 1) + 8, x >> 1 : (x >> 1) + 8] = raw[256:320].reshape(8, 8)
        p.planes[2][y >> 1 : (y >> 1) + 8, x >> 1 : (x >> 1) + 8] = raw[320:].reshape(8, 8)
        p.qp[self.my, self.mx] = 0
        for plane, n in ((0, 4), (1, 2), (2, 2)):
            p.levels[plane][n * self.my : n * self.my + n, n * self.mx : n * self.mx + n] = 16

    def _modes(self) -> list[int]:
        """Modes of the 16 blocks, in the order of coding."""
        p, out = self.pic, []
        for x, y in ORDER:
            near = []
            for nx, ny in ((self.bx + x - 1, self.by + y), (self.bx + x, self.by + y - 1)):
                near.append(int(p.modes[ny, nx]) if self._usable(nx >> 2, ny >> 2) else -1)
            mode = 2 if -1 in near else min(near)
            if not self.b.read(1):
                other = self.b.read(3)
                mode = other + (other >= mode)
            p.modes[self.by + y, self.bx + x] = mode
            out.append(mode)
        return out

    def _small_blocks(self, modes: list[int], luma: np.ndarray) -> None:
        a, done = self.pic.planes[0], set()
        for mode, (x, y) in zip(modes, ORDER):
            px, py = 16 * self.mx + 4 * x, 16 * self.my + 4 * y
            inside = x < 3 and (x + 1, y - 1) in done
            outside = y == 0 and self._usable(self.mx + (x == 3), self.my - 1)
            right = a[py - 1, px + 4 : px + 8] if inside or outside else None
            a[py : py + 4, px : px + 4] = self._sum(intra.predict_4x4(mode, *self._border(0, px, py, 4), right), luma[y, x])
            done.add((x, y))

    # levels

    def _change_qp(self) -> None:
        self.qp = (self.qp + self.b.se() + 52) % 52
        self.pic.qp[self.my, self.mx] = self.qp

    @staticmethod
    def _sum(predicted: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return np.clip(predicted + rest, 0, 255)

    def _block(self, plane: int, x: int, y: int, most: int) -> list[int]:
        n, levels = cavlc.block(self.b, self._context(plane, x, y), most)
        self.pic.levels[plane][y, x] = n
        return levels

    def _luma(self, coded: int, whole: bool) -> np.ndarray:
        """Residuals [row, column, 4, 4]; whole: the constant levels of the blocks come in a block of their own."""
        if not coded & 15 and not whole:
            return np.zeros((4, 4, 4, 4), np.int64)
        out = np.zeros((4, 4, 16), np.int64)
        constant = np.zeros(16, np.int64)
        if whole:
            constant[ZIGZAG] = cavlc.block(self.b, self._context(0, self.bx, self.by), 16)[1]
        for i, (x, y) in enumerate(ORDER):
            if coded >> (i >> 2) & 1:
                out[y, x, ZIGZAG[whole:]] = self._block(0, self.bx + x, self.by + y, 16 - whole)
        out = blocks.scaled(out.reshape(4, 4, 4, 4), self.qp)
        if whole:
            scale, up = 16 * blocks.SCALES[self.qp % 6][0], self.qp // 6
            f = HADAMARD @ constant.reshape(4, 4) @ HADAMARD * scale
            out[..., 0, 0] = f << up - 6 if up >= 6 else (f + (1 << 5 - up)) >> 6 - up
        return blocks.residual(out)

    def _chroma(self, coded: int, predict) -> None:
        p, x, y = self.pic, 8 * self.mx, 8 * self.my
        if not coded >> 4:
            for plane in (1, 2):
                p.planes[plane][y : y + 8, x : x + 8] = predict(plane)
            return
        constants = [np.array(cavlc.block(self.b, -1, 4)[1]).reshape(2, 2) for _ in range(2)]
        for plane in (1, 2):
            out = np.zeros((2, 2, 16), np.int64)
            if coded >> 5:
                for i in range(4):
                    out[i >> 1, i & 1, ZIGZAG[1:]] = self._block(plane, 2 * self.mx + (i & 1), 2 * self.my + (i >> 1), 15)
            qp = chroma_qp(self.qp, self.s.pps, plane)
            out = blocks.scaled(out.reshape(2, 2, 4, 4), qp)
            turn = HADAMARD[:2, [0, 2]]
            out[..., 0, 0] = ((turn @ constants[plane - 1] @ turn * (16 * blocks.SCALES[qp % 6][0])) << qp // 6) >> 5
            p.planes[plane][y : y + 8, x : x + 8] = self._sum(predict(plane), _joined(blocks.residual(out), 2))

    # prediction from other pictures

    def _near(self, x: int, y: int):
        """(reference, movement) of a block; MISSING if it is not there or not known yet."""
        if not self._there(x >> 2, y >> 2):
            return MISSING, (0, 0)
        ref = int(self.pic.refs[y, x])
        return ref, tuple(int(v) for v in self.pic.moves[y, x]) if ref >= 0 else (0, 0)

    def _expected(self, x: int, y: int, width: int, height: int, ref: int, shape: int) -> tuple[int, int]:
        """The movement that a part at block (x, y) of the picture is expected to have."""
        a, b, c = self._near(x - 1, y), self._near(x, y - 1), self._near(x + width, y - 1)
        if c[0] == MISSING:
            c = self._near(x - 1, y - 1)
        if shape == 1:  # halves above one another
            side = b if y == self.by else a
        else:
            side = (a if x == self.bx else c) if shape == 2 else None
        if side and side[0] == ref:
            return side[1]
        if b[0] == MISSING and c[0] == MISSING and a[0] != MISSING:
            return a[1]
        same = [n[1] for n in (a, b, c) if n[0] == ref]
        if len(same) == 1:
            return same[0]
        return tuple(sorted(n[1][i] for n in (a, b, c))[1] for i in (0, 1))

    def _skip(self) -> None:
        a, b = self._near(self.bx - 1, self.by), self._near(self.bx, self.by - 1)
        still = any(n[0] == MISSING or n == (0, (0, 0)) for n in (a, b))
        self._move(self.bx, self.by, 4, 4, 0, (0, 0) if still else self._expected(self.bx, self.by, 4, 4, 0, 0))
        self._predict(0, None)

    def _move(self, x: int, y: int, width: int, height: int, ref: int, move: tuple[int, int]) -> None:
        p = self.pic
        if ref >= len(self.references):
            raise MediaError("a reference is missing")
        here = slice(y, y + height), slice(x, x + width)
        p.refs[here], p.moves[here], p.shown_by[here] = ref, move, self.references[ref].number

    def _reference(self, kind: int) -> int:
        if self.s.active == 1 or kind == 4:
            return 0
        return self.b.ue() if self.s.active > 2 else 1 - self.b.read(1)

    def _inter(self, kind: int) -> None:
        b = self.b
        if kind < 3:
            parts = [(*part, self._reference(kind), kind) for part in PARTS[kind]]
        else:
            kinds = [b.ue() for _ in range(4)]
            if max(kinds) > 3:
                raise MediaError("invalid type of a quarter")
            refs = [self._reference(kind) for _ in range(4)]
            parts = [(2 * (q & 1) + x, 2 * (q >> 1) + y, w, h, refs[q], 0) for q in range(4) for x, y, w, h in QUARTER_PARTS[kinds[q]]]
        for x, y, w, h, ref, shape in parts:
            expected = self._expected(self.bx + x, self.by + y, w, h, ref, shape)
            self._move(self.bx + x, self.by + y, w, h, ref, (expected[0] + b.se(), expected[1] + b.se()))
        code = b.ue()
        if code > 47:
            raise MediaError("invalid pattern of coded blocks")
        coded = CODED_INTER[code]
        if coded:
            self._change_qp()
        self._predict(coded, [part[:4] for part in parts])

    def _predict(self, coded: int, parts) -> None:
        p, x, y = self.pic, 16 * self.mx, 16 * self.my
        predicted = [np.empty((16, 16), np.int64), np.empty((8, 8), np.int64), np.empty((8, 8), np.int64)]
        for bx, by, w, h in parts or ((0, 0, 4, 4),):
            ref = int(p.refs[self.by + by, self.bx + bx])
            dx, dy = (int(v) for v in p.moves[self.by + by, self.bx + bx])
            source = self.references[ref]
            for plane in range(3):
                n = 4 if plane == 0 else 2
                left, top = n * (self.bx + bx), n * (self.by + by)
                moved = blocks.moved_luma if plane == 0 else blocks.moved_chroma
                part = moved(source.planes[plane], left * (16 // n) + dx, top * (16 // n) + dy, n * w, n * h)
                if self.s.weights:
                    weight, offset = self.s.weights[ref][plane]
                    shift = self.s.denominators[plane > 0]
                    part = np.clip((part * weight + (1 << shift >> 1) >> shift) + offset, 0, 255)
                predicted[plane][n * by : n * (by + h), n * bx : n * (bx + w)] = part
        luma = self._luma(coded, False)
        p.planes[0][y : y + 16, x : x + 16] = self._sum(predicted[0], _joined(luma, 4))
        self._chroma(coded, lambda plane: predicted[plane])


def _joined(parts: np.ndarray, n: int) -> np.ndarray:
    """[row, column, 4, 4] as one square."""
    return parts.swapaxes(1, 2).reshape(4 * n, 4 * n)


def chroma_qp(qp: int, pps: dict, plane: int) -> int:
    at = min(max(qp + pps["chroma_qp" if plane == 1 else "chroma_qp_2"], 0), 51)
    return at if at < 30 else CHROMA_QP[at - 30]


def smooth(p: Picture) -> None:
    """All edges of a picture, macroblock by macroblock: those that stand first, then those that lie."""
    if all(s.smoothing == 1 for s in p.slices):
        return
    for my in range(p.down):
        for mx in range(p.across):
            s = p.slices[p.owner[my, mx]]
            if s.smoothing == 1:
                continue
            for down in (False, True):
                for edge in range(4):
                    other = (mx, my) if edge else (mx - (not down), my - down)
                    if min(other) < 0 or (s.smoothing == 2 and p.owner[other[1], other[0]] != p.owner[my, mx]):
                        continue
                    strength = _strength(p, mx, my, edge, other, down)
                    if strength.any():
                        _smooth_edge(p, s, mx, my, edge, other, down, strength)


def _strength(p: Picture, mx: int, my: int, edge: int, other: tuple[int, int], down: bool) -> np.ndarray:
    """Of the four blocks along an edge."""
    if p.intra[my, mx] or p.intra[other[1], other[0]]:
        return np.full(4, 3 if edge else 4)
    along = np.arange(4)
    q = (np.full(4, 4 * my + edge), 4 * mx + along) if down else (4 * my + along, np.full(4, 4 * mx + edge))
    b = (q[0] - down, q[1] - (not down))
    levels = (p.levels[0][q] > 0) | (p.levels[0][b] > 0)
    moved = (p.shown_by[q] != p.shown_by[b]) | (abs(p.moves[q] - p.moves[b]) >= 4).any(1)
    return np.where(levels, 2, moved.astype(int))


def _smooth_edge(p: Picture, s: Slice, mx: int, my: int, edge: int, other: tuple[int, int], down: bool, strength: np.ndarray) -> None:
    qps = int(p.qp[my, mx]), int(p.qp[other[1], other[0]])
    for plane in range(3):
        if plane and edge % 2:
            continue
        n, reach = (16, 4) if plane == 0 else (8, 2)
        at = 4 * edge if plane == 0 else 2 * edge
        a = p.planes[plane].T if down else p.planes[plane]
        row, column = (mx, my) if down else (my, mx)
        here = slice(n * row, n * row + n), slice(n * column + at - reach, n * column + at + reach)
        qp = sum(qps if plane == 0 else (chroma_qp(q, s.pps, plane) for q in qps)) + 1 >> 1
        a[here] = deblock.smoothed(a[here], np.repeat(strength, n // 4), qp, s.alpha, s.beta, plane == 0)


class OrderCounter:
    """Places of pictures in the order of output, from the headers of their first slices alone, by one of three rules."""

    def __init__(self):
        self.epoch = self.high = self.low = self.frame_offset = self.last_frame = 0

    def place(self, s: Slice) -> tuple[int, int]:
        """(epoch, order count): pictures of a later epoch are shown after all of those before."""
        count = self._count(s)
        if s.idr or any(what == 5 for what, _ in s.marks):
            self.epoch += 1
        if not s.idr and any(what == 5 for what, _ in s.marks):
            count = self.high = self.low = self.last_frame = self.frame_offset = 0
        return self.epoch, count

    def _count(self, s: Slice) -> int:
        sps = s.sps
        size = 1 << sps.frame_bits
        if s.idr:
            self.frame_offset = 0
        elif s.frame < self.last_frame:
            self.frame_offset += size
        self.last_frame = s.frame
        if sps.order_type == 0:
            low, span = s.order[0], 1 << sps.order_bits
            if s.idr:
                self.high, self.low = 0, 0
            high = self.high + (span if low < self.low and self.low - low >= span // 2 else -span if low > self.low and low - self.low > span // 2 else 0)
            if s.importance:
                self.high, self.low = high, low
            return high + low + min(0, s.order[1])
        number = self.frame_offset + s.frame
        if sps.order_type == 2:
            return 2 * number - (s.importance == 0)
        n = len(sps.cycle)
        number = (number if n else 0) - (s.importance == 0 and n > 0 and number > 0)
        count = 0
        if number > 0:
            rounds, rest = divmod(number - 1, n)
            count = rounds * sum(sps.cycle) + sum(sps.cycle[: rest + 1])
        first, second = s.order or (0, 0)
        count += first + (sps.order_offset if s.importance == 0 else 0)
        return count + min(0, sps.field_offset + second)


class Decoder:
    """Units in, planes of pictures without what is cropped out, in the order of coding; a stream, or a part of it from an IDR picture on."""

    def __init__(self):
        self.sequences: dict[int, SequenceSet] = {}
        self.pictures: dict[int, dict] = {}
        self.references: list[Picture] = []
        self.current: Picture | None = None
        self.count = 0

    def decode(self, units: Iterable[tuple[int, int, bytes]]) -> Iterator[list[bytes]]:
        for type, importance, payload in units:
            if type == 7:
                s = sequence_set(payload)
                self.sequences[s.number] = s
            elif type == 8:
                p = picture_set(payload)
                self.pictures[p["number"]] = p
            elif type in (1, 5):
                b = Bits(payload)
                s = slice_header(b, type, importance, self.sequences, self.pictures)
                if self.current is not None and self._is_new(s):
                    yield self._finish()
                if self.current is None:
                    self._begin(s)
                SliceDecoder(b, s, self.current, self._list(s)).run()
            elif type in (2, 3, 4):
                raise MediaError("parted slices are not supported")
        if self.current is not None:
            yield self._finish()

    def _is_new(self, s: Slice) -> bool:
        last = self.current.slices[-1]
        return (s.frame, s.idr, s.order, s.importance > 0) != (last.frame, last.idr, last.order, last.importance > 0) or self.current.owner.flat[min(s.first, self.current.owner.size - 1)] != -1

    def _begin(self, s: Slice) -> None:
        if s.idr:
            self.references = []
        elif not self.count:
            raise MediaError("the stream does not begin with a picture that stands alone")
        self.current = Picture(s.sps)
        self.current.frame, self.current.number = s.frame, self.count
        self.count += 1

    def _list(self, s: Slice) -> list[Picture]:
        """References, the latest first, changed as the slice says."""
        if s.kind == "I":
            return []
        size = 1 << s.sps.frame_bits
        number = {id(r): r.frame - (size if r.frame > s.frame else 0) for r in self.references}
        out = sorted(self.references, key=lambda r: -number[id(r)])
        at = s.frame
        for i, (what, by) in enumerate(s.changes):
            at = (at - by if what == 0 else at + by) % size
            wanted = at - size if at > s.frame else at
            found = [r for r in self.references if number[id(r)] == wanted]
            if not found:
                raise MediaError("a reference is missing")
            out = out[:i] + found + [r for r in out[i:] if r is not found[0]]
        return out[: s.active]

    def _finish(self) -> list[bytes]:
        p, self.current = self.current, None
        if (p.owner < 0).any():
            raise MediaError("parts of a picture are missing")
        smooth(p)
        s = p.slices[0]
        if s.importance:
            size = 1 << s.sps.frame_bits
            for what, by in s.marks:
                if what == 1:
                    gone = (s.frame - by) % size
                    self.references = [r for r in self.references if r.frame != gone]
                else:
                    self.references, p.frame = [], 0
            if not s.marks and not s.idr:
                while len(self.references) >= max(1, s.sps.references):
                    first = min(self.references, key=lambda r: r.frame - (size if r.frame > s.frame else 0))
                    self.references.remove(first)
            self.references.append(p)
        v = s.sps
        out = []
        for c, plane in zip((0, 1, 1), p.planes):
            out.append(plane[v.top >> c : v.top + v.height >> c, v.left >> c : v.left + v.width >> c].astype(np.uint8).tobytes())
        return out
