"""H.264 byte streams to FRAME rows.

A stream is split at its IDR pictures: what follows one needs nothing from before it but parameter sets. The headers alone
say where each picture stands in the order of output, so these periods go to tasks of their own, each of which decodes
its period a picture at a time and holds no more than the reference pictures.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediaframe.errors import MediaError
from mediaframe.functions import avc
from mediaframe.functions.picture import Video
from mediaframe.functions.rational import Rational
from mediaframe.plans.graph import FRAME
from mediaframe.session import map_arrow
from mediaframe.sources import nal

PERIOD = "stream_id long, period long, places array<long>, types array<int>, importances array<int>, payloads array<binary>"


def video_type(head: bytes, rate: Rational = Rational(25, 1)) -> Video:
    """The type of a stream's frames, from the first sequence set in its first bytes."""
    for _, type, _, payload in nal.units(head):
        if type == 7:
            s = nal.sequence_set(payload)
            return Video("yuv420p", s.width, s.height, rate.inverse(), rate)
    raise MediaError("no sequence set among the first bytes")


def _ranks(keys: list[tuple[int, int]], first: int) -> list[int]:
    out = [0] * len(keys)
    for rank, i in enumerate(sorted(range(len(keys)), key=lambda i: keys[i])):
        out[i] = first + rank
    return out


def split_periods(data: bytes) -> Iterator[tuple[list[int], list[tuple[int, int, bytes]]]]:
    """(place in the order of output of each picture, units with the parameter sets before them) of each period of a stream."""
    sequences, pictures, sets, order = {}, {}, {}, avc.OrderCounter()
    first, keys, units = 0, [], []
    for _, type, importance, payload in nal.units(data):
        unit = type, importance, payload
        if type in (7, 8):
            if type == 7:
                s = nal.sequence_set(payload)
                sequences[s.number], key = s, (7, s.number)
            else:
                p = nal.picture_set(payload)
                pictures[p["number"]], key = p, (8, p["number"])
            sets[key] = unit
            units.append(unit)
        elif type in (1, 5):
            if payload[:1] >= b"\x80":  # the first macroblock of a picture
                if type == 5:
                    if keys:
                        yield _ranks(keys, first), units
                    first, keys, units = first + len(keys), [], [sets[k] for k in sorted(sets)]
                keys.append(order.place(avc.slice_header(nal.Bits(payload), type, importance, sequences, pictures)))
            units.append(unit)
        elif type in (2, 3, 4):
            units.append(unit)
    if keys:
        yield _ranks(keys, first), units


def decode(streams: DataFrame, key: str = "stream_id", data: str = "data") -> DataFrame:
    """FRAME rows of byte streams; one shuffle deals their periods. A null or empty stream has no frames."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, raw in zip(batch.column("key").to_pylist(), batch.column("data")):
                for period, (places, units) in enumerate(split_periods(raw.as_py() or b"")):
                    types, importances, payloads = zip(*units)
                    values = ([stream], [period], [places], [list(types)], [list(importances)], [list(payloads)])
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["stream_id", "period", "places", "types", "importances", "payloads"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                done = avc.Decoder().decode(zip(row["types"], row["importances"], row["payloads"]))
                for n, planes in zip(row["places"], done, strict=True):
                    place = pa.array([n], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([row["stream_id"]], pa.int64()), place, place, pa.array([1], pa.int64()), pa.array([planes], pa.list_(pa.binary()))], ["stream_id", "n", "pts", "duration", "planes"])

    periods = map_arrow(streams.select(F.col(key).cast("long").alias("key"), F.col(data).cast("binary").alias("data")), split, PERIOD)
    return map_arrow(periods.repartition("stream_id", "period"), run, FRAME)
