"""Shared helpers: the shared work folder, Arrow text buffers, word and shingle hashes, connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that a Python worker handles at a time.
CHUNK_BYTES = 1 << 20
#: Rows up to which a side of a join may be broadcast; each row has a few longs at most.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is a new local one if the master is local."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mediaframe-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again: what was made of them has been written itself."""
    for table in tables:
        if path := table.__dict__.get("_written"):
            spark = table.sparkSession
            name = spark._jvm.org.apache.hadoop.fs.Path(path)
            name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; counts no more than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size is within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def one_column(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash: new name = old name."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the text column of each has at most so many bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = utf8(batch.column(text))
        start = 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _step(x: np.ndarray) -> np.ndarray:
    """A cheaper mixing than mix(), between the levels of doubled()."""
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def doubled(values: np.ndarray, top: int) -> list[np.ndarray]:
    """Hashes of the runs of 1, 2, 4, ... 2 ** top values from each place on; every doubling is mixed."""
    out = [values]
    for k in range(top):
        last, size = out[-1], 1 << k
        out.append(_step(last[: max(0, len(last) - size)] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + last[size:]))
    return out


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal spans have equal hashes wherever they lie.

    The values are mixed words. A span is told by its length and by the two runs of the largest power of two that fits,
    from its start and to its end, which cover it.
    """
    size = np.asarray(end - start)
    out = mix(size.astype(np.uint64) + np.uint64(1))
    top = np.frexp(np.maximum(size, 1).astype(float))[1] - 1  # the largest power of two that fits
    if levels is None:
        levels = doubled(values, int(top.max(initial=0)))
    for k in np.unique(top[size > 0]):
        some = np.flatnonzero((top == k) & (size > 0))
        low, high = levels[k][start[some]], levels[k][end[some] - (1 << int(k))]
        out[some] = mix(out[some] + mix(low) * np.uint64(0xD6E8FEB86659FD93) + high)
    return out


#: Byte classes: 1 where a byte is a separator.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A fixed random word for each byte value.
BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Bytes of a word that are hashed in blocks, together with other words.
WORD_BYTES = 64


def words_of(raw: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the n + 1 offsets of each document's words; words never cross documents."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~separators[raw]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    edges = at[:-1][at[:-1] < len(raw)]
    begins[edges] = inside[edges]
    ends = inside[:-1] & ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: blocks of 8 bytes, each mixed into what the blocks before gave; BLAKE2 for long words."""
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(size):
        return out
    blocks = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    long = size > WORD_BYTES
    live = np.flatnonzero(~long & (size > 0))
    at = 0
    while len(live):
        word = np.ascontiguousarray(blocks[start[live] + at]).view(np.uint64).ravel()
        rest = np.minimum(size[live] - at, 8).astype(np.uint64)
        word &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        out[live] = mix((out[live] ^ word) + np.uint64(0xD6E8FEB86659FD93))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def owners(at: np.ndarray) -> np.ndarray:
    """The document's index of each element, from n + 1 offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b), as (node, component), component being the smallest node.

    Alternating large-star and small-star rounds: neighbours move to the smallest node that they see. Each round is a
    partial aggregation and a join on the node; every round is written to the shared folder. Nodes without edges are absent.
    Loops and repeated edges are harmless; nulls are dropped.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, now = now, materialize(star.where("a <> b").distinct(), "edges")
        discard(before)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, each run as one table; keys are integers without nulls."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in keys])
        cut = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        edges = [0, *cut.tolist(), n]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(values[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def pack_groups(tables: Iterator[pa.Table], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Groups put together up to so many rows: a table, and the n + 1 offsets of its groups. A larger group stands alone."""
    held, sizes = [], []
    for t in tables:
        if held and sum(sizes) + t.num_rows > rows:
            yield pa.concat_tables(held).combine_chunks(), np.concatenate([[0], np.cumsum(sizes)])
            held, sizes = [], []
        held.append(t)
        sizes.append(t.num_rows)
    if held:
        yield pa.concat_tables(held).combine_chunks(), np.concatenate([[0], np.cumsum(sizes)])


def blocks(rows: DataFrame, keys: list[str], by: str, block: int) -> DataFrame:
    """Split large groups into pairs of blocks: adds own_block, low_block and high_block.

    A group of up to `block` rows is the one pair (0, 0). A larger one has n = ceil(rows / block) blocks, dealt by a hash of
    column `by`; each row goes to all n pairs (low, high) that its block is in, so that every two rows of a group meet in
    exactly one pair: of their two blocks, or their common block with itself.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    sizes = sizes.where(F.col("__n") > block)
    large = materialize(sizes, "sizes")
    if large.isEmpty():
        return rows.select("*", *[F.lit(0).alias(c) for c in ("own_block", "low_block", "high_block")])
    out = rows.join(maybe_broadcast(large), keys, "left").withColumn("__b", F.coalesce(F.ceil(F.col("__n") / block).cast("int"), F.lit(1)))
    out = out.withColumn("own_block", F.pmod(F.xxhash64(by, F.lit(11)), F.col("__b")).cast("int"))
    out = out.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    return out.select(*rows.columns, "own_block", F.least("own_block", "__o").alias("low_block"), F.greatest("own_block", "__o").alias("high_block"))


def forest(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest id) that connect what the symmetric boolean matrix links; nodes without links are left out."""
    label = np.full(len(ids), -1)
    a, b = [], []
    for s in np.flatnonzero(linked.any(axis=1)):
        if label[s] >= 0:
            continue
        reached, frontier = np.zeros(len(ids), bool), np.array([s])
        reached[s] = True
        while len(frontier):
            new = linked[frontier].any(axis=0) & ~reached
            reached |= new
            frontier = np.flatnonzero(new)
        label[reached] = s
        members = ids[reached]
        root = members.min()
        a.append(members[members != root])
        b.append(np.full(len(a[-1]), root))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
