"""Media files as DataFrames, and DataFrames as media files.

Files are read through Spark's binaryFile source, so any store that Spark reads works; a task takes whole files. Local files
of fixed-size records (raw video, Y4M, WAV samples) can also be read by byte ranges, see datasource.py. A media file has one
writer by nature: its bytes are made by the executors, in order, and streamed to the file through the driver, a partition at
a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mediaframe.functions.picture import Video
from mediaframe.operators import avc
from mediaframe.plans.graph import FRAME
from mediaframe.session import map_arrow
from mediaframe.sources import containers as c


FILES = "path string, modificationTime timestamp, length long, content binary"


def _files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(FILES).load(path) if stream else spark.read.format("binaryFile").load(path)
    return found.select("path", F.xxhash64("path").alias("stream_id"), "content")


def head(spark: SparkSession, path: str, size: int = 65536) -> tuple[str, bytes]:
    """Name and first bytes of the first file: files are listed without their content, and only so much of one is read."""
    row = spark.read.format("binaryFile").load(path).select("path").orderBy("path").first()
    if row is None:
        raise c.ContainerError(f"no file at {path!r}")
    name = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
    stream = name.getFileSystem(spark._jsc.hadoopConfiguration()).open(name)
    try:
        return row["path"], bytes(stream.readNBytes(size))
    finally:
        stream.close()


def read_video(spark: SparkSession, path: str, format: str | None = None, pix_fmt: str = "yuv420p", size: tuple[int, int] | None = None, framerate: c.Rational = c.Rational(25, 1), stream: bool = False) -> tuple[DataFrame, Video]:
    """(FRAME rows, their type) of Y4M, raw video or H.264 files; raw video needs a size. stream: files that arrive later are read as they do."""
    name, first = head(spark, path)
    kind = c.pick(name, first, format)
    if kind == "y4m":
        video = c.y4m_header(first)[0]
    elif kind == "rawvideo":
        if size is None:
            raise c.ContainerError("raw video needs a picture size")
        video = Video(pix_fmt, *size, framerate.inverse(), framerate)
    elif kind == "h264":
        return avc.decode(_files(spark, path, stream), data="content"), avc.video_type(first, framerate)
    else:
        raise c.ContainerError(f"{kind} is not a video format")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, content in zip(batch.column("stream_id").to_pylist(), batch.column("content")):
                data = content.as_buffer().to_pybytes()
                if kind == "y4m" and c.y4m_header(data)[0] != video:
                    raise c.ContainerError("the files have different types")
                records = c.y4m_frames(data) if kind == "y4m" else c.raw_frames(data, video)
                rows: list[tuple[int, list[bytes]]] = []
                for n, payload in records:
                    rows.append((n, c.planes_of(payload, video)))
                    if len(rows) * len(payload) > 4 << 20:
                        yield _frame_batch(stream, rows)
                        rows = []
                if rows:
                    yield _frame_batch(stream, rows)

    return map_arrow(_files(spark, path, stream), run, FRAME), video


def _frame_batch(stream: int, rows: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
    n = pa.array([r[0] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([stream] * len(rows), pa.int64()), n, n, pa.array([1] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["stream_id", "n", "pts", "duration", "planes"])


def read_packets(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """PACKET rows (stream_id, seq, pts, duration, pos, data, skip_samples, discard_padding) of WAV, MPEG audio or ADTS files."""
    kind = c.pick(*head(spark, path), format)
    if kind not in ("wav", "mp3", "aac"):
        raise c.ContainerError(f"{kind} is not an audio format")

    def packets(data: bytes) -> Iterator[tuple[int, int, int, bytes, int, int]]:
        if kind == "wav":
            audio, start, end = c.wav_header(data)
            size = audio.packet_bytes
            for at in range(start, end, size):
                part = data[at : min(at + size, end)]
                yield (at - start) // audio.block_align, len(part) // audio.block_align, at, part, 0, 0
        else:
            skip, low, high = c.mpeg_gapless(data) if kind == "mp3" else (0, 0, 0)
            for at, pts, h in c.mpeg_frames(data) if kind == "mp3" else c.adts_frames(data):
                end = pts + h.samples
                beyond = min(end - low, h.samples) if low and end >= low and pts < high else 0
                yield pts, h.samples, at, data[at : at + h.frame_bytes], 0 if pts else skip, beyond

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, content in zip(batch.column("stream_id").to_pylist(), batch.column("content")):
                rows = list(packets(content.as_buffer().to_pybytes()))
                columns = [[stream] * len(rows), list(range(len(rows))), *([r[k] for r in rows] for k in range(6))]
                kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["stream_id", "seq", "pts", "duration", "pos", "data", "skip_samples", "discard_padding"])

    return map_arrow(_files(spark, path), run, "stream_id long, seq long, pts long, duration long, pos long, data binary, skip_samples long, discard_padding long")


def wav_type(spark: SparkSession, path: str) -> c.Audio:
    return c.wav_header(head(spark, path)[1] + b"\0")[0]


def decode_samples(raw: np.ndarray, codec: str) -> np.ndarray:
    """Samples of PCM bytes; 24 bits come as the high ones of 32."""
    kind, bits = c.CODECS[codec]
    if bits == 24:
        b = raw.reshape(-1, 3).astype(np.int32)
        low, mid, high = (b[:, 0], b[:, 1], b[:, 2]) if kind[0] == "<" else (b[:, 2], b[:, 1], b[:, 0])
        return (high << 24) | (mid << 16) | (low << 8)
    return raw.view(kind)


def encode_samples(v: np.ndarray, codec: str) -> bytes:
    kind, bits = c.CODECS[codec]
    if bits == 24:
        b = (v.astype(np.int64) >> 8).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]
        return np.ascontiguousarray(b if kind[0] == "<" else b[:, ::-1]).tobytes()
    return v.astype(kind).tobytes()


def decode_pcm(packets: DataFrame, audio: c.Audio) -> DataFrame:
    """Sample rows (stream_id, k, ch, v) of PCM packets; a packet must hold whole blocks."""
    kind = "double" if audio.codec.startswith("pcm_f") else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, pts, data in zip(batch.column("stream_id").to_pylist(), batch.column("pts").to_pylist(), batch.column("data")):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                if len(raw) % audio.block_align:
                    raise c.ContainerError("a PCM packet does not hold whole blocks")
                v = decode_samples(raw, audio.codec).astype(np.float64 if kind == "double" else np.int64)
                n, at = audio.layout.count, np.arange(len(v))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), stream)), pa.array(pts + at // n), pa.array((at % n).astype(np.int32)), pa.array(v)], ["stream_id", "k", "ch", "v"])

    return map_arrow(packets.select("stream_id", "pts", "data"), run, f"stream_id long, k long, ch int, v {kind}")


def encode_pcm(pcm: DataFrame, audio: c.Audio, block: int = 4096) -> DataFrame:
    """Packets (stream_id, seq, data) of so many samples a channel, from sample rows; seq orders them."""
    rows = pcm.withColumn("seq", F.floor(F.col("k") / block))

    def pack(table: pa.Table) -> pa.Table:
        k, ch, v = (np.asarray(table.column(x)) for x in ("k", "ch", "v"))
        v = v[np.lexsort((ch, k))]
        return pa.table({"stream_id": table.column("stream_id").slice(0, 1), "seq": table.column("seq").slice(0, 1), "data": pa.array([encode_samples(v, audio.codec)], pa.binary())})

    from mediaframe.session import ship

    ship(pcm.sparkSession)
    return rows.groupBy("stream_id", "seq").applyInArrow(pack, "stream_id long, seq long, data binary")


def y4m_bytes(frames: DataFrame, video: Video) -> DataFrame:
    """(seq, data): the header, then every frame with its line."""
    body = frames.select(F.col("n").alias("seq"), F.concat(F.lit(b"FRAME\n"), F.expr("aggregate(planes, cast('' AS binary), (a, x) -> concat(a, x))")).alias("data"))
    first = frames.sparkSession.createDataFrame([(-1, bytearray(c.y4m_write_header(video)))], "seq long, data binary")
    return first.unionByName(body)


def raw_bytes(frames: DataFrame) -> DataFrame:
    return frames.select(F.col("n").alias("seq"), F.expr("aggregate(planes, cast('' AS binary), (a, x) -> concat(a, x))").alias("data"))


def wav_bytes(packets: DataFrame, audio: c.Audio) -> DataFrame:
    """(seq, data): the header, made from the counted bytes, then the samples, padded to an even length."""
    size = packets.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    ends = [(-1, bytearray(c.wav_write_header(audio, size)))] + ([((1 << 62), bytearray(1))] if size % 2 else [])
    return packets.sparkSession.createDataFrame(ends, "seq long, data binary").unionByName(packets.select("seq", "data"))


def save(rows: DataFrame, path: str) -> int:
    """Write (seq, data) in order into one local file; returns its length. Only a partition at a time is in memory."""
    total = 0
    with open(path, "wb") as f:
        for r in rows.orderBy("seq").toLocalIterator(prefetchPartitions=False):
            total += f.write(r["data"])
    return total
