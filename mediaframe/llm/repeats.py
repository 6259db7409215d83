"""Where documents may repeat each other: candidates for repeated windows, found without sending the texts around.

A window is ``length`` consecutive symbols (bytes or words) of one document. Its anchor is the leftmost of its ``gram``-symbol
grams of least hash, so equal windows have equal anchors at equal places. Consecutive windows of one anchor are a stretch;
inside a passage that documents share, their stretches are the same. A stretch is told by the hash of its anchor and the hash
of all its symbols, 64 bits each; about one stretch for every (length - gram + 2) / 2 symbols is sent, as packed columns, to
the bucket of its anchor's hash.

* Stretches of one content are a class. Documents other than the class's first (of least id) have the whole stretch earlier:
  a covered interval. Each task sorts that out among its own documents before it sends anything, so that the copies of a
  passage are sent once for a task, however many there are.
* Classes that share an anchor with another class of another document may share some of their windows: the first
  document's stretches of such a class are requests, which the suffix structure decides.
* An anchor with more than ``HOT`` contents in one task (a line that stands in ever other surroundings) is hot: its stretches
  are not sent to the anchor's bucket, only the word that it is hot is; the bucket asks for the others'. The windows of such
  stretches are dealt one by one.

Anchors that no two documents share end here. The number of buckets follows from the bytes of text. A bucket gets ``HOT``
contents of an anchor from a task at most.
"""

from __future__ import annotations

import gc
import itertools
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mediaframe.llm.common import chunks, doubled, materialize, mix, span_hashes
from mediaframe.session import map_arrow

#: Bytes of text for each bucket, and stretches that a task holds before it sends.
BUCKET_BYTES, HELD = 8 << 20, 400_000
#: Requests of one anchor beyond which its windows are dealt one by one, by their own hashes.
WIDE = 20_000
#: Contents of one anchor in a task beyond which the anchor is hot.
HOT = 64
#: Symbols and offsets of a batch's texts: (values, n + 1 offsets).
Symbols = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of what has been written to the shared folder."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def gram_hashes(levels: list[np.ndarray], gram: int) -> np.ndarray:
    """A mixed hash of each run of `gram` values, from those of runs of powers of two."""
    n, at, out = len(levels[0]) - gram + 1, 0, None
    for i in reversed(range(len(levels))):
        if gram >> i & 1:
            part = levels[i][at : at + n]
            out = part.copy() if out is None else out * np.uint64(0xD6E8FEB86659FD93) + part
            at += 1 << i
    return mix(out)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the place of the least, the leftmost of equals."""
    n = len(h) - width + 1
    value, place, size = h, np.arange(len(h), dtype=np.int32), 1
    while size * 2 <= width:
        m = len(value) - size
        right = value[size:] < value[:m]
        place = np.where(right, place[size:], place[:m])
        value = np.minimum(value[size:], value[:m])
        size *= 2
    rest = width - size
    right = value[rest : rest + n] < value[:n]
    return np.where(right, place[rest : rest + n], place[:n])


def stretches(values: np.ndarray, at: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """anchor and content hash, text index, first window (from the text's start) and number of windows of each stretch."""
    n = len(values)
    if n < length:
        return {c: np.zeros(0, k) for c, k in (("anchor", np.uint64), ("content", np.uint64), ("text", np.int64), ("first", np.int64), ("count", np.int64))}
    levels = doubled(values, (2 * length - gram).bit_length() - 1)
    h = gram_hashes(levels, gram)
    place = least_places(h, length - gram + 1)
    size = np.diff(at)
    valid = np.zeros(n + 1, np.int8)  # +1 where the valid windows of a text begin, -1 where they end
    long = size >= length
    np.add.at(valid, at[:-1][long], 1)
    np.add.at(valid, at[1:][long] - length + 1, -1)
    valid = np.cumsum(valid[: len(place)]).astype(bool)
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    begins = at[:-1][long]
    new[begins] = True
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(place))
    ends = np.searchsorted(at, start, "right") - 1
    stop = np.minimum(stop, at[ends + 1] - length + 1)
    return {
        "anchor": h[place[start]],
        "content": span_hashes(values, start, stop - 1 + length, levels),
        "text": ends,
        "first": start - at[ends],
        "count": stop - start,
    }


#: Bytes of an anchor's hash that are sent: with the bucket's number they tell anchors apart well enough to ask for a closer look.
COLUMNS = (("anchor", np.uint64), ("content", np.uint64), ("doc", np.int64), ("first", np.int64), ("count", np.int64))
SENT = {"anchor": 5, "content": 8, "doc": 8, "first": 4, "count": 2}


def pack(part: dict[str, np.ndarray]) -> bytes:
    """The columns, each as planes of bytes, so that high bytes that hardly vary are compressed away; `first` as differences."""
    first = part["first"].astype(np.int64)
    first = np.diff(first, prepend=0) & 0xFFFFFFFF
    out = [np.int64(len(first)).tobytes()]
    for c, width in SENT.items():
        values = first if c == "first" else part[c]
        planes = np.ascontiguousarray(values).astype(np.uint64 if values.dtype == np.uint64 else np.int64).view(np.uint8).reshape(-1, 8)
        out.append(np.ascontiguousarray(planes[:, :width].T).tobytes())
    return b"".join(out)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, {}
    for c, kind in COLUMNS:
        planes = np.zeros((n, 8), np.uint8)
        width = SENT[c]
        planes[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        out[c] = planes.view(kind).ravel()
    out["first"] = np.cumsum(out["first"]) & 0xFFFFFFFF
    out["count"] = out["count"].astype(np.uint16).astype(np.int16).astype(np.int64)
    return out


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.asarray(p[c], kind) for p in parts]) for c, kind in COLUMNS}


def taken(part: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[rows] for c, v in part.items()}


def ranked(part: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The stretches sorted by anchor, content, document; of each, its class's number, and whether it is of the class's first document."""
    part = taken(part, np.lexsort((part["first"], part["doc"], part["content"], part["anchor"])))
    n = len(part["doc"])
    new = np.ones(n, bool)
    new[1:] = (part["content"][1:] != part["content"][:-1]) | (part["anchor"][1:] != part["anchor"][:-1])
    number = np.cumsum(new) - 1
    return part, number, part["doc"] == part["doc"][np.flatnonzero(new)][number] if n else new


def merged(doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals, by document."""
    if not len(doc):
        return doc, first, end
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order].astype(np.int64), end[order].astype(np.int64)
    change = np.concatenate([[True], doc[1:] != doc[:-1]])
    # a running maximum within each document: offset the documents apart
    base = (np.cumsum(change) - 1) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = change.copy()
    new[1:] |= first[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], first[at], (reach - base)[last]


OUT = "kind int, doc long, first int, count int, anchor long, wide int"
COVERED, REQUEST = 0, 1


def _batch(kind: int, doc, first, count, anchor=None, wide=None) -> pa.RecordBatch:
    n = len(doc)
    zero = np.zeros(n, np.int64)
    arrays = [np.full(n, kind, np.int32), np.asarray(doc, np.int64), np.asarray(first, np.int32), np.asarray(count, np.int32), zero if anchor is None else anchor.view(np.int64), np.asarray(zero if wide is None else wide, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["kind", "doc", "first", "count", "anchor", "wide"])


def find_candidates(docs: DataFrame, symbols: Symbols, length: int, gram: int, name: str) -> DataFrame:
    """From (key, text): covered intervals (kind 0: doc, first symbol, count of symbols) and requests (kind 1: doc, first window, count of windows, anchor, wide)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        count = 0

        def dealt(kind: int, part: dict[str, np.ndarray], by: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
            where = (by % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((part["first"], part["doc"], where))
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                yield b, kind, pack(taken(part, order[edges[b] : edges[b + 1]]))

        def flush() -> Iterator[pa.RecordBatch]:
            part, number, first = ranked(joined(held))
            doc, low, high = merged(part["doc"][~first], part["first"][~first], part["first"][~first] + part["count"][~first] + (length - 1))
            covered = {"anchor": np.zeros(len(doc), np.uint64), "content": (high - low).astype(np.uint64), "doc": doc, "first": low, "count": np.zeros(len(doc), np.int64)}
            # contents of each anchor
            new = np.ones(len(number), bool)
            new[1:] = part["anchor"][1:] != part["anchor"][:-1]
            anchor = np.cumsum(new) - 1
            begins = np.flatnonzero(new)
            contents = np.diff(np.append(number[begins], number[-1] + 1)) if len(number) else number
            hot = (contents > HOT)[anchor] if len(number) else first
            asked = taken(part, np.flatnonzero(hot & first))
            word = taken(part, begins[contents > HOT])
            word["count"], word["content"] = np.zeros_like(word["count"]), np.zeros_like(word["content"])
            sent = joined([taken(part, np.flatnonzero(first & ~hot)), word])
            # covered intervals and hot requests travel along, in the bucket of their document
            each = (dealt(0, sent, sent["anchor"] >> np.uint64(40)), dealt(1, covered, mix(doc.view(np.uint64))), dealt(2, asked, mix(asked["doc"].view(np.uint64))))
            for b, kind, data in itertools.chain(*each):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["bucket", "kind", "data"])

        for batch in chunks(batches, "text"):
            key = np.asarray(batch.column("key"))
            values, at = symbols(batch)
            part = stretches(values, at, length, gram)
            part["doc"] = key[part.pop("text")]
            held.append(part)
            count += len(part["doc"])
            if count >= HELD:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        bucket = None

        def settle() -> Iterator[pa.RecordBatch]:
            part = joined(held)
            order = np.argsort(part["anchor"], kind="stable")
            anchor, doc = part["anchor"][order], part["doc"][order]
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            at = np.flatnonzero(new)
            hot = np.minimum.reduceat(part["count"][order], at) == 0 if len(at) else np.zeros(0, bool)
            shared = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) | hot if len(at) else hot
            keep = shared[np.cumsum(new) - 1] & (part["count"][order] > 0)
            if not keep.any():
                return
            hot = hot[np.cumsum(new) - 1][keep]
            part["hot"] = np.zeros(len(part["doc"]), bool)
            part["hot"][order[keep]] = hot
            part, _, first = ranked(taken(part, order[keep]))
            copies = taken(part, np.flatnonzero(~first))
            yield _batch(COVERED, copies["doc"], copies["first"], copies["count"].astype(np.int64) + length - 1)
            anchor, content, hot = part["anchor"], part["content"], part["hot"]
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            group = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            mixed = (np.minimum.reduceat(content, at) != np.maximum.reduceat(content, at))[group]
            asked = first & (mixed | hot)
            size = np.bincount(group[asked], minlength=len(at))[group]
            wide = hot | (size > WIDE)
            rows = np.flatnonzero(asked)
            asked = taken(part, rows)
            yield _batch(REQUEST, asked["doc"], asked["first"], asked["count"], asked["anchor"], wide[rows])

        for batch in batches:
            for b, kind, data in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")):
                if b != bucket and held:
                    yield from settle()
                    held = []
                bucket = b
                part = unpack(data.as_buffer().to_pybytes())
                if kind == 1:
                    yield _batch(COVERED, part["doc"], part["first"], part["content"].astype(np.int64))
                elif kind == 2:
                    yield _batch(REQUEST, part["doc"], part["first"], part["count"], part["anchor"], np.ones(len(part["doc"])))
                else:
                    held.append(part)
        if held:
            yield from settle()

    usable = docs.where("key IS NOT NULL AND text IS NOT NULL")
    sent = map_arrow(usable, send, "bucket int, kind int, data binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    out = materialize(map_arrow(sent, resolve, OUT), name)
    del sent
    release(docs.sparkSession)
    return out


def requests_by_document(candidates: DataFrame, which: str = "true") -> DataFrame:
    """(doc, first, count, anchor, wide): arrays of the requests of each document."""
    asked = candidates.where(F.col("kind") == REQUEST).where(which)
    return asked.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("first", "count", "anchor", "wide"))).alias("asked"))


def intervals_by_document(*parts: DataFrame) -> DataFrame:
    """(doc, spans): array of (first, count), the union of all intervals of each document, in order."""
    every = parts[0].select("doc", "first", "count")
    for p in parts[1:]:
        every = every.unionByName(p.select("doc", "first", "count"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("first", pa.int32()), ("count", pa.int32())])
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("spans")
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            first, count = (np.asarray(flat.field(c)).astype(np.int64) for c in ("first", "count"))
            row, low, high = merged(row, first, first + count)
            spans = pa.StructArray.from_arrays([pa.array(low.astype(np.int32)), pa.array((high - low).astype(np.int32))], fields=list(kind))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.ListArray.from_arrays(pa.array(at), spans)], ["doc", "spans"])

    return map_arrow(every.groupBy("doc").agg(F.collect_list(F.struct("first", "count")).alias("spans")), unite, "doc long, spans array<struct<first:int,count:int>>")


#: Documents with intervals, and intervals in all, up to which they are broadcast to the texts.
BROADCAST_SPANS = 4_000_000


def settled(spans: DataFrame, name: str) -> DataFrame:
    """The intervals of documents, written, and broadcast if they are counted to be few; else for a shuffled join."""
    done = materialize(spans, name)
    release(done.sparkSession)
    rows, total = done.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    return F.broadcast(done) if 8 * rows + total <= BROADCAST_SPANS else done


def covered_mask(size: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of so many symbols are in the intervals."""
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + count, -1)
    return np.cumsum(edges[:size]) > 0
