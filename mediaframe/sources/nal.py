"""H.264 byte streams: NAL units, and the sequence and picture parameter sets in them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediaframe.errors import MediaError
from mediaframe.session import map_arrow

START = re.compile(rb"\x00\x00\x01")
ESCAPE = re.compile(rb"\x00\x00\x03")
NEEDS_ESCAPE = re.compile(rb"\x00\x00(?=[\x00-\x03])")
#: Profiles whose parameter sets describe the chroma format.
HIGH = {100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 144}


def units(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(place, type, importance, payload without escapes) of each unit after a start code; trailing zeros are no part of it."""
    starts = [m.end() for m in START.finditer(data)]
    for a, b in zip(starts, [*starts[1:], len(data) + 3]):
        body = data[a : b - 3].rstrip(b"\0")
        if body:
            yield a, body[0] & 31, body[0] >> 5, ESCAPE.sub(b"\0\0", body[1:])


class Bits:
    def __init__(self, data: bytes):
        self.data, self.size, self.at = data, len(data) * 8, 0
        rest = data.rstrip(b"\0")
        #: The place of the closing one bit.
        self.end = len(rest) * 8 - (rest[-1] & -rest[-1]).bit_length() if rest else 0

    def peek(self, n: int) -> int:
        """The next bits, up to 57; beyond the end they are zeros."""
        byte = self.at >> 3
        window = int.from_bytes(self.data[byte : byte + 8].ljust(8, b"\0"), "big")
        return (window >> (64 - (self.at & 7) - n)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise MediaError("the bit stream is too short")
        out = self.peek(n)
        self.at += n
        return out

    def more(self) -> bool:
        """Whether anything but the closing one bit and zeros is left."""
        return self.at < self.end

    def aligned_bytes(self, n: int) -> bytes:
        """Whole bytes from the next byte on."""
        start = (self.at + 7) >> 3
        if start + n > len(self.data):
            raise MediaError("the bit stream is too short")
        self.at = (start + n) * 8
        return self.data[start : start + n]

    def ue(self) -> int:
        """Unsigned Exp-Golomb."""
        zeros = 0
        while not self.read(1):
            zeros += 1
            if zeros > 32:
                raise MediaError("invalid Exp-Golomb code")
        return (1 << zeros) - 1 + self.read(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


class Writer:
    """Bits one after another, and units made of them."""

    def __init__(self):
        self.value, self.size = 1, 0

    def write(self, n: int, value: int) -> None:
        self.value, self.size = self.value << n | value, self.size + n

    def ue(self, value: int) -> None:
        self.write(2 * (value + 1).bit_length() - 1, value + 1)

    def se(self, value: int) -> None:
        self.ue(2 * value - 1 if value > 0 else -2 * value)

    def align(self) -> None:
        self.write(-self.size % 8, 0)

    def unit(self, type: int, importance: int = 3) -> bytes:
        """A start code and the unit of what has been written, closed and with escapes."""
        rest = -(self.size + 1) % 8
        body = (((self.value ^ 1 << self.size) << 1 | 1) << rest).to_bytes((self.size + 1 + rest) // 8, "big")
        return b"\0\0\1" + bytes([importance << 5 | type]) + NEEDS_ESCAPE.sub(b"\0\0\3", body)


@dataclass(frozen=True)
class SequenceSet:
    profile: int
    level: int
    number: int
    width: int
    height: int
    frame_bits: int
    order_type: int
    references: int
    across: int = 0
    down: int = 0
    left: int = 0
    top: int = 0
    order_bits: int = 0
    same_order: int = 0
    order_offset: int = 0
    field_offset: int = 0
    cycle: tuple[int, ...] = ()


def sequence_set(payload: bytes) -> SequenceSet:
    """4:2:0 8-bit progressive streams only, as the rest of this module has no use for others."""
    b = Bits(payload)
    profile, _, level, number = b.read(8), b.read(8), b.read(8), b.ue()
    chroma = 1
    if profile in HIGH:
        chroma = b.ue()
        if chroma == 3:
            b.read(1)
        if b.ue() or b.ue() or chroma != 1:
            raise MediaError("only 8-bit 4:2:0 is supported")
        b.read(1)
        if b.read(1):
            raise MediaError("scaling matrices are not supported")
    frame_bits = b.ue() + 4
    order = b.ue()
    more: dict = {}
    if order == 0:
        more["order_bits"] = b.ue() + 4
    elif order == 1:
        more["same_order"], more["order_offset"], more["field_offset"] = b.read(1), b.se(), b.se()
        more["cycle"] = tuple(b.se() for _ in range(b.ue()))
    elif order > 2:
        raise MediaError("invalid type of picture order")
    references = b.ue()
    b.read(1)
    across, down = b.ue() + 1, b.ue() + 1
    if not b.read(1):
        raise MediaError("interlaced streams are not supported")
    b.read(1)
    left, right, top, bottom = (b.ue() for _ in range(4)) if b.read(1) else (0, 0, 0, 0)
    width, height = across * 16 - 2 * (left + right), down * 16 - 2 * (top + bottom)
    if width <= 0 or height <= 0:
        raise MediaError("nothing of the picture is shown")
    return SequenceSet(profile, level, number, width, height, frame_bits, order, references, across, down, 2 * left, 2 * top, **more)


def picture_set(payload: bytes) -> dict[str, int]:
    b = Bits(payload)
    out = {"number": b.ue(), "sequence": b.ue(), "cabac": b.read(1), "order_present": b.read(1)}
    if b.ue():
        raise MediaError("slice groups are not supported")
    out |= {"references_0": b.ue() + 1, "references_1": b.ue() + 1, "weighted": b.read(1), "weighted_bi": b.read(2), "qp": b.se() + 26}
    b.se()
    out |= {"chroma_qp": b.se(), "deblocking": b.read(1), "constrained_intra": b.read(1), "redundant": b.read(1)}
    out["chroma_qp_2"] = out["chroma_qp"]
    if b.more():
        if b.read(1) or b.read(1):
            raise MediaError("8x8 transforms and scaling matrices are not supported")
        out["chroma_qp_2"] = b.se()
    return out


def messages(payload: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, content) of each message of a unit of supplemental information (6); one that is cut ends them."""
    at, end = 0, len(payload.rstrip(b"\0")) - 1
    while at < end:
        numbers = []
        for _ in range(2):
            n = 0
            while at < end and payload[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                return
            numbers.append(n + payload[at])
            at += 1
        if at + numbers[1] > end:
            return
        yield numbers[0], payload[at : at + numbers[1]]
        at += numbers[1]


def split(streams: DataFrame, key: str = "stream_id", data: str = "data") -> DataFrame:
    """(stream_id, seq, place, type, importance, payload) of every unit of byte streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, raw in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist()):
                rows = list(units(raw or b""))
                columns = [[stream] * len(rows), list(range(len(rows))), *([r[k] for r in rows] for k in range(4))]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["stream_id", "seq", "place", "type", "importance", "payload"])

    return map_arrow(streams.select(F.col(key).cast("long").alias("key"), F.col(data).alias("data")), run, "stream_id long, seq long, place long, type int, importance int, payload binary")
