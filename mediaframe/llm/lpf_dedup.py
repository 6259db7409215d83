"""Suffix-array dedup with longest-previous-factor arrays: later copies of long byte strings go, the first stays.

A byte of a document is removed if a string of ``length`` bytes that covers it also starts in a document of smaller id.
``repeats.find_candidates`` leaves the stretches of text that may hold such strings. The stretches of one anchor meet in a
task, which

1. sorts the suffixes that start at their windows (the suffix array of the group), and computes the longest common prefix
   of each suffix and the one before;
2. finds, for each suffix, the nearest before and after it in suffix order that belong to a smaller document (previous and
   next smaller values), with the least common prefix on the way; the longer of the two is the longest previous factor;
3. gives an interval for every factor of at least ``length`` bytes.

Copies of a whole stretch are one entry, its first document's; for the others the factor is the stretch, told by hashes of its
anchor and of its content (``repeats``). The windows of a hot anchor, or of one with more than ``repeats.WIDE`` stretches, are
told by 128 bits of hashes, and their least documents found by a partial aggregation; no two copies of such a window need to meet.

Null and empty texts have no bytes. Rows with a null id are kept whole and remove nothing. Ids are unique, or their rows
repeated as a whole; a document never removes its own repeats. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediaframe.llm.common import BYTE_WORDS, chunks, grouped, materialize, mix, one_column, pack_groups, span_hashes, utf8
from mediaframe.llm.repeats import covered_mask, find_candidates, intervals_by_document, requests_by_document, settled
from mediaframe.session import map_arrow

LENGTH, GRAM = 50, 20


def symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, at = utf8(batch.column("text"))
    return BYTE_WORDS[raw], at


def suffix_order(matrix: np.ndarray) -> np.ndarray:
    """The order of rows of bytes (the suffixes, padded with zeros)."""
    width = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), width), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    words = padded.view(">u8").astype(np.uint64)
    return np.lexsort(words.T[::-1])


def smaller(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The least lcp on the way to the nearest earlier entry with a smaller document; lcp[i] is that of entries i - 1 and i."""
    n = len(doc)
    to, least = np.arange(-1, n - 1), lcp.copy()
    if n:
        least[0] = 0
    while True:
        todo = np.flatnonzero((to >= 0) & (least > 0))
        todo = todo[doc[to[todo]] >= doc[todo]]
        if not len(todo):
            break
        # everything between to[to[i]] and to[i] has documents no smaller than that of to[i]
        nearest = to[todo]
        least[todo], to[todo] = np.minimum(least[todo], least[nearest]), to[nearest]
    return np.where(to >= 0, least, 0)


def longest_previous(suffixes: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix (padded rows and their sizes), the longest prefix that a suffix of its group and a smaller document has."""
    n = len(suffixes)
    order = suffix_order(suffixes)
    order = order[np.argsort(group[order], kind="stable")]
    rows, lengths, groups, docs = suffixes[order], size[order], group[order], doc[order]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        common = np.minimum(common, np.minimum(lengths[1:], lengths[:-1]))
        lcp[1:] = np.where(groups[1:] == groups[:-1], common, 0)
    before = smaller(docs, lcp)
    back = np.concatenate([[0], lcp[1:][::-1]]) if n else lcp
    after = smaller(docs[::-1], back)[::-1]
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(before, after)
    return out


def find_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, spans) of documents with removed bytes, from (key, text)."""
    found = find_candidates(docs, symbols, length, gram, "bytes")
    asked = requests_by_document(found, "wide = 0")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw, at = utf8(batch.column("text"))
            key = np.asarray(batch.column("key"))
            lists = batch.column("asked")
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            first, count, anchor = (np.asarray(flat.field(c)).astype(np.int64) for c in ("first", "count", "anchor"))
            start = at[owner] + first
            pieces = [raw[a : a + n].tobytes() for a, n in zip(start.tolist(), (count - 1 + length).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key[owner]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(pieces, pa.binary())], ["anchor", "doc", "first", "count", "piece"])

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in pack_groups(grouped(batches, ["anchor"]), 4_000):
            doc, first, count = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("doc", "first", "count"))
            raw, offset = utf8(table.column("piece").combine_chunks())
            group = np.repeat(np.arange(len(at) - 1), np.diff(at))
            row = np.repeat(np.arange(len(doc)), count)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            size = count[row] - 1 + length - shift
            width = int(size.max())
            start = offset[row] + shift
            padded = np.concatenate([raw, np.zeros(width, np.uint8)])
            suffixes = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
            suffixes[np.arange(width)[None, :] >= size[:, None]] = 0
            factor = longest_previous(suffixes, size, group[row], doc[row])
            hit = np.flatnonzero(factor >= length)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(doc[row[hit]]), pa.array((first[row[hit]] + shift[hit]).astype(np.int32)), pa.array(factor[hit].astype(np.int32))], ["doc", "first", "count"])

    pieces = map_arrow(docs.join(asked, docs["key"] == asked["doc"]).select("key", "text", "asked"), cut, "anchor long, doc long, first int, count int, piece binary")
    pieces = pieces.repartition("anchor").sortWithinPartitions("anchor")
    return intervals_by_document(found.where("kind = 0"), map_arrow(pieces, factors, "doc long, first int, count int"), *hot_windows(docs, found, length))


def hot_windows(docs: DataFrame, found: DataFrame, length: int) -> list[DataFrame]:
    """(doc, first, count) of the windows of hot anchors that a smaller document has."""
    asked = requests_by_document(found, "wide = 1")
    if asked.isEmpty():
        return []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw, at = utf8(batch.column("text"))
            lists = batch.column("asked")
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            first, count = (np.asarray(flat.field(c)).astype(np.int64) for c in ("first", "count"))
            row = np.repeat(np.arange(len(count)), count)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = at[owner[row]] + window
            names = [span_hashes(mix(BYTE_WORDS ^ np.uint64(k))[raw], start, start + length).view(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(names[0]), pa.array(names[1]), pa.array(np.asarray(batch.column("key"))[owner[row]]), pa.array(window.astype(np.int32))], ["h1", "h2", "doc", "first"])

    windows = map_arrow(docs.join(asked, docs["key"] == asked["doc"]).select("key", "text", "asked"), cut, "h1 long, h2 long, doc long, first int")
    windows = materialize(windows, "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    return [windows.join(least, ["h1", "h2"]).where("doc > least").select("doc", "first", F.lit(length).alias("count"))]


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, kept binary, spans array<struct<start,end>>) for every document; spans are the maximal removed runs."""
    every = one_column(documents, key=key, text=text).withColumn("key", F.col("key").cast("long"))
    docs = every.where("key IS NOT NULL")
    spans = settled(find_spans(docs, length, gram), "spans")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in chunks(batches, "text"):
            raw, at = utf8(batch.column("text"))
            kept, removed = [], []
            for i, found in enumerate(batch.column("spans")):
                own = raw[at[i] : at[i + 1]]
                if found.is_valid and len(found):
                    flat = found.values
                    mask = covered_mask(len(own), np.asarray(flat.field("first")).astype(np.int64), np.asarray(flat.field("count")).astype(np.int64))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    kept.append(own[~mask].tobytes())
                    removed.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                else:
                    kept.append(own.tobytes())
                    removed.append([])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(at)), pa.array(kept, pa.binary()), pa.array(removed, runs)], ["key", "n_bytes", "kept", "spans"])

    whole = docs.join(spans, docs["key"] == spans["doc"], "left").select("key", "text", "spans")
    without = every.where("key IS NULL").select("key", "text", F.lit(None).cast(whole.schema["spans"].dataType).alias("spans"))
    out = map_arrow(whole.unionByName(without), drop, "key long, n_bytes long, kept binary, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("key", key)


def op6_columns(out: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of remove_repeats()."""
    return out.select(key, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return op6_columns(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = r"""
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS w FROM (SELECT doc_id, h, unnest(generate_series(1, len(h) // 2 - 49)) AS i FROM doc WHERE len(h) >= 100)),
first AS (SELECT w, min(doc_id) AS m FROM win GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, i FROM win JOIN first USING (w) WHERE doc_id > m),
edge AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, min(i) AS s, max(i) + 49 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edge) GROUP BY doc_id, g),
piece AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before, lead(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL AS last FROM run),
kept AS (
  SELECT doc_id, sum(e - s + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (s - before - 1)) || CASE WHEN last THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY s) AS k
  FROM piece JOIN doc USING (doc_id) GROUP BY 1)
SELECT doc_id, cast(len(h) // 2 AS bigint) AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, cast(coalesce(n_spans, 0) AS bigint) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""
