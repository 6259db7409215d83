"""Byte-level BPE encoding and decoding with length-bucketed, padded numpy matrices.

A text is split by the pattern; each distinct piece that a worker has not seen lately is encoded once, together with the
others of its batch:

* pieces are sorted by length into matrices of token ids, padded with -1; one-byte tokens to begin with;
* each round every row merges its leftmost pair of minimum rank. The rank of a pair comes from an open-addressing hash
  table over (left id, right id), built once from the ranks: every split of a token into two tokens is an entry;
* after a merge only the pairs beside it are looked up again; rows without a mergeable pair are compacted away.

A piece that is itself a token takes its id at once. Pieces over ``LONG`` bytes (runs without a break) have the same merges
done with a heap, since a row would take as many rounds as it has bytes. Decoding joins the bytes of the ids.

Null and empty texts have no tokens. Any Unicode text round-trips; lone surrogates cannot occur in Spark's strings. Special
tokens are never recognised. Repeated rows give the same tokens each; ties of rank go to the leftmost pair; an empty table gives
no rows; extra columns are ignored. The ranks come from a file of `base64 rank` lines that the driver reads and broadcasts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from mediaframe.llm.common import chunks, one_column, utf8
from mediaframe.session import map_arrow

#: Bytes up to which a piece is a row of a matrix.
LONG = 2048
#: Pieces that a worker remembers from one chunk of texts to the next.
REMEMBERED = 200_000
NONE = np.int64(1) << np.int64(40)


@dataclass(frozen=True)
class Vocabulary:
    """The content of a rank file and the splitting pattern."""

    ranks: bytes
    pattern: str

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary(f.read(), pattern)


class PairTable:
    """(left, right) -> id of the merged token, by linear probing; lookups are over arrays."""

    def __init__(self, tokens: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in tokens.items():
            for k in range(1, len(token)):
                a, b = tokens.get(token[:k]), tokens.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.bits = max(4, (2 * len(merged)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        values, slot = np.array(merged, np.int64), self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            first = np.unique(slot[todo][free], return_index=True)[1]
            put = todo[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = self.keys[slot[todo]] != keys[todo]
            todo = todo[rest]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token's id, which is its rank, or NONE; ids under 0 are padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), np.int64(-2), keys).ravel()
        slot, out = self._slot(keys), np.full(keys.shape, NONE, np.int64)
        todo = np.flatnonzero(keys >= 0)
        while len(todo):
            have = self.keys[slot[todo]]
            same = have == keys[todo]
            out[todo[same]] = self.values[slot[todo[same]]]
            todo = todo[~same & (have >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Pieces(dict):
    """Piece to its row; a piece that is new gets the next row, and is listed in `new`."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = row = len(self)
        self.new.append(piece)
        return row


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.ranks.splitlines() if line)}
        self.pattern = regex.compile(vocabulary.pattern)
        self.pairs = PairTable(self.tokens)
        self.single = np.array([self.tokens[bytes([i])] for i in range(256)], np.int64)
        # ranks of pairs of bytes, at (left + 1) * 257 + right + 1; padding is -1
        self.first = np.full(257 * 257, NONE, np.int64)
        left, right = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
        self.first[(left + 1) * 257 + right + 1] = self.pairs.look(self.single[left], self.single[right])
        self.seen = Pieces()
        self.start, self.flat, self.uses = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = max(self.tokens.values()) + 1
        parts = [b""] * size
        for token, rank in self.tokens.items():
            parts[rank] = token
        self.bytes_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        rows = []
        for i, p in enumerate(pieces):
            whole = self.tokens.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[i] = self._heap(p)
            else:
                rows.append(i)
        rows.sort(key=lambda i: len(pieces[i]))
        pos = 0
        while pos < len(rows):
            least = len(pieces[rows[pos]])
            stop = pos
            while stop < len(rows) and len(pieces[rows[stop]]) <= least * 5 // 4 + 1 and (stop - pos) * len(pieces[rows[stop]]) < 1 << 18:
                stop += 1
            stop = max(stop, pos + 1)
            part = rows[pos:stop]
            for i, ids in zip(part, self._matrix([pieces[i] for i in part])):
                out[i] = ids
            pos = stop
        return out

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        ids = np.full((len(pieces), width), -1, np.int64)
        inside = np.arange(width)[None, :] < size[:, None]
        ids[inside] = np.frombuffer(b"".join(pieces), np.uint8)  # bytes, for the table of first ranks
        done: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        number = np.arange(len(pieces))
        rank = self.first[(ids[:, :-1] + 1) * 257 + ids[:, 1:] + 1] if width > 1 else np.full((len(pieces), 0), NONE)
        ids[inside] = self.single[ids[inside]]
        while len(number):
            if rank.shape[1] == 0:
                best = np.full(len(number), NONE)
            else:
                at = rank.argmin(axis=1)  # the first of equals
                best = rank[np.arange(len(number)), at]
            over = best >= NONE
            if over.any():
                for k in np.flatnonzero(over):
                    row = ids[k]
                    done[number[k]] = row[row >= 0].astype(np.int32)
                go = ~over
                number, ids, rank = number[go], ids[go], rank[go]
                if not len(number):
                    break
                at, best = at[go], best[go]
            n, w = ids.shape
            k = np.arange(n)
            # drop the right one of the merged pair: what follows moves one to the left
            moved = np.empty((n, w - 1), np.int64)
            column = np.arange(w - 1)[None, :]
            left = column <= at[:, None]
            np.copyto(moved, ids[:, 1:])
            moved[left] = ids[:, :-1][left]
            moved[k, at] = best
            if w > 2:
                ranks = np.empty((n, w - 2), np.int64)
                np.copyto(ranks, rank[:, 1:])
                before = column[:, : w - 2] < at[:, None]
                ranks[before] = rank[:, :-1][before]
                has = at < w - 2
                ranks[k[has], at[has]] = self.pairs.look(best[has], moved[k[has], at[has] + 1])
                has = at > 0
                ranks[k[has], at[has] - 1] = self.pairs.look(moved[k[has], at[has] - 1], best[has])
            else:
                ranks = np.full((n, 0), NONE)
            ids, rank = moved, ranks
        return done

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self.pairs.look(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first < NONE)]
        heapq.heapify(heap)
        token, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        rank = lambda i: self._one(token[i], token[after[i]]) if after[i] < n else None
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or self._one(token[i], token[after[i]]) != r:
                continue
            j = after[i]
            token[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k))
        return np.array([t for t, a in zip(token, alive) if a], np.int32)

    def _one(self, a: int, b: int) -> int | None:
        p, at = self.bytes, self.bytes_at
        return self.tokens.get(p[at[a] : at[a + 1]].tobytes() + p[at[b] : at[b + 1]].tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and n + 1 offsets."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        find, look = self.pattern.findall, self.seen.__getitem__
        rows = [np.fromiter(map(look, find(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        if self.seen.new:
            found = self.merge([p.encode() for p in self.seen.new])
            self.seen.new = []
            size = np.array([len(x) for x in found], np.int64)
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
            self.flat = np.concatenate([self.flat, *found])
            self.uses = np.concatenate([self.uses, np.zeros(len(found), np.int64)])
        row = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.uses += np.bincount(row, minlength=len(self.uses))
        size = self.start[row + 1] - self.start[row]
        end = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(end[-1]) + np.repeat(self.start[row] - end[:-1], size)]
        return ids, end[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]

    def _forget(self) -> None:
        """Keep the half of the pieces that were used most."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        names = list(self.seen)
        size = self.start[keep + 1] - self.start[keep]
        end = np.concatenate([[0], np.cumsum(size)])
        self.flat = self.flat[np.arange(end[-1]) + np.repeat(self.start[keep] - end[:-1], size)]
        self.start, self.uses = end, self.uses[keep] // 2
        self.seen = Pieces({names[k]: i for i, k in enumerate(keep.tolist())})

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and n + 1 offsets."""
        size = self.bytes_at[ids + 1] - self.bytes_at[ids] if len(ids) else np.zeros(0, np.int64)
        end = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(end[-1]) + np.repeat(self.bytes_at[ids] - end[:-1], size) if len(ids) else np.zeros(0, np.int64)
        return self.bytes[index], end[at]


_MADE: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder of the vocabulary, made once."""
    key = hashlib.sha256(vocabulary.ranks + b"\0" + vocabulary.pattern.encode()).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(vocabulary)
    return _MADE[key]


def default_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path(name), public_tokenizers.PATTERN)


def encode(documents: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids array<int>) for every document; with `decoded`, also the bytes that those ids decode to."""
    docs = one_column(documents, key=key, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for batch in chunks(batches, "text"):
            ids, at = coder.encode(batch.column("text").to_pylist())
            out = {"key": batch.column("key"), "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))}
            if decoded:
                out["decoded"] = binary(*coder.decode(ids, at))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    more = ", decoded binary" if decoded else ""
    return map_arrow(docs, run, f"key {dict(docs.dtypes)['key']}, ids array<int>{more}").withColumnRenamed("key", key)


def binary(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and `out`: the bytes of the ids (null ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    schema = StructType([*encoded.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(ids)
            lists = lists.fill_null([]) if lists.null_count else lists
            at = np.asarray(lists.offsets).astype(np.int64)
            made = binary(*coder.decode(np.asarray(lists.flatten()), at - at[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return map_arrow(encoded, run, schema)


def digests(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    coded = encode(documents, vocabulary, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
