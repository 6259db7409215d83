r"""Substring dedup with prefix-partitioned suffix trees: later copies of long word sequences go, the first stays.

A word (a run of ``[^\x20\x09-\x0D]``, unchanged) is removed if a window of ``length`` consecutive words that covers it also
starts in a document of smaller id. ``repeats.find_candidates`` leaves the stretches that may hold such windows; of those,

1. every suffix that starts at a window is dealt to a group by a prefix of variable length: the first word, or the first 2,
   4, 8 or ``length`` words where a shorter prefix has more than ``GROUP`` suffixes (prefixes are counted, and the frequent
   ones, few by that bound, are joined);
2. a group's suffixes are sorted, which together with the longest common prefixes of neighbours is its suffix tree: the
   runs of neighbours with at least so many common words are its internal nodes of that depth. The deep ones, of at
   least ``length`` words, are the maximal repeats; each knows the least document under it;
3. a suffix under a deep node with a smaller document is repeated: the words of the deepest such node are covered.

Groups of the longest prefix hold equal windows only; what they need is their least document, an aggregation. Words are
compared by 64-bit hashes. Copies of a whole stretch are settled before, see ``repeats``.

Null and empty texts have no words. Rows with a null id are kept whole and remove nothing. Ids are unique, or their rows
repeated as a whole; a document never removes its own repeats. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediaframe.llm.common import chunks, grouped, materialize, maybe_broadcast, one_column, pack_groups, span_hashes, utf8, word_hashes, words_of
from mediaframe.llm.repeats import find_candidates, intervals_by_document, requests_by_document, settled
from mediaframe.session import map_arrow

LENGTH, GRAM = 13, 6
#: Suffixes that a prefix's group may have before its prefix is made longer.
GROUP = 20_000
#: Lengths of prefixes, besides the window's.
PREFIXES = (1, 2, 4, 8)


def symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, at = utf8(batch.column("text"))
    start, end, first = words_of(raw, at)
    return word_hashes(raw, start, end), first


def deepest(words: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each suffix (rows of word hashes, padded, and their sizes): the depth of the deepest node of at least `least` words above it that has a smaller document; else 0."""
    n, width = words.shape
    order = np.lexsort((*words.T[::-1], group))
    rows, lengths, groups, docs = words[order], size[order], group[order], doc[order]
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp = np.minimum(lcp, np.minimum(lengths[1:], lengths[:-1]))
        common[1:] = np.where(groups[1:] == groups[:-1], lcp, 0)
    out = np.zeros(n, np.int64)
    for depth in range(least, width + 1):
        under = common >= depth
        if not under.any():
            break
        node = np.flatnonzero(~under)  # the runs between are the nodes of this depth
        smallest = np.minimum.reduceat(docs, node)[np.cumsum(~under) - 1]
        out[smallest < docs] = depth
    back = np.empty(n, np.int64)
    back[order] = out
    return back


def find_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, spans) in words, of documents with removed words, from (key, text)."""
    found = find_candidates(docs, symbols, length, gram, "words")
    asked = requests_by_document(found)
    levels = [p for p in PREFIXES if p < length] + [length]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            values, at = symbols(batch)
            key = np.asarray(batch.column("key"))
            lists = batch.column("asked")
            flat = lists.flatten()
            first, count = (np.asarray(flat.field(c)).astype(np.int64) for c in ("first", "count"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            row = np.repeat(np.arange(len(count)), count)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = at[owner[row]] + window
            size = first[row] + count[row] - 1 + length - window
            offset = np.concatenate([[0], np.cumsum(size)])
            words = values[np.arange(offset[-1]) + np.repeat(start - offset[:-1], size)]
            columns = {"doc": pa.array(key[owner[row]]), "first": pa.array(window.astype(np.int32))}
            columns |= {f"p{k}": pa.array(span_hashes(values, start, start + k).view(np.int64)) for k in levels}
            columns["words"] = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    prefixes = "".join(f"p{k} long, " for k in levels)
    suffixes = map_arrow(docs.join(asked, docs["key"] == asked["doc"]).select("key", "text", "asked"), cut, f"doc long, first int, {prefixes}words array<long>")
    suffixes = materialize(suffixes, "suffixes")
    keyed = suffixes.withColumn("prefix", F.lit(None).cast("long"))
    whole = False
    for k in levels[:-1]:
        own = F.col(f"p{k}")
        frequent = keyed.where("prefix IS NULL").groupBy(own).agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
        frequent = materialize(frequent.select(own.alias("often")), "frequent")
        keyed = keyed.join(maybe_broadcast(frequent), own == F.col("often"), "left")
        keyed = keyed.withColumn("prefix", F.coalesce("prefix", F.when(F.col("often").isNull(), own))).drop("often")
        if frequent.isEmpty():
            whole = True
            break

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in pack_groups(grouped(batches, ["prefix"]), 20_000):
            doc, first = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("doc", "first"))
            lists = table.column("words").combine_chunks()
            offset = np.asarray(lists.offsets).astype(np.int64)
            size = np.diff(offset)
            flat = np.asarray(lists.flatten()).view(np.uint64)
            width = int(size.max())
            words = np.zeros((len(doc), width), np.uint64)
            words[np.arange(width)[None, :] < size[:, None]] = flat
            depth = deepest(words, size, np.repeat(np.arange(len(at) - 1), np.diff(at)), doc, length)
            hit = np.flatnonzero(depth)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(first[hit].astype(np.int32)), pa.array(depth[hit].astype(np.int32))], ["doc", "first", "count"])

    every = keyed.where("prefix IS NOT NULL").select("doc", "first", "prefix", "words")
    repeats = map_arrow(every.repartition("prefix").sortWithinPartitions("prefix"), trees, "doc long, first int, count int")
    if not whole:
        window = f"p{length}"
        rest = keyed.where("prefix IS NULL")
        least = rest.groupBy(window).agg(F.min("doc").alias("least"))
        same = rest.join(least, window).where("doc > least").select("doc", "first", F.lit(length).alias("count"))
        repeats = repeats.unionByName(same)
    return intervals_by_document(found.where("kind = 0"), repeats)


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, n_words, n_removed, kept) for every document; kept is its other words, joined by one space."""
    every = one_column(documents, key=key, text=text).withColumn("key", F.col("key").cast("long"))
    docs = every.where("key IS NOT NULL")
    spans = settled(find_spans(docs, length, gram), "spans")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw, at = utf8(batch.column("text"))
            start, end, word = words_of(raw, at)
            lists = batch.column("spans").fill_null([]) if batch.column("spans").null_count else batch.column("spans")
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            first = word[owner] + np.asarray(flat.field("first")).astype(np.int64)
            edges = np.zeros(len(start) + 1, np.int64)
            np.add.at(edges, first, 1)
            np.add.at(edges, first + np.asarray(flat.field("count")).astype(np.int64), -1)
            kept = np.cumsum(edges[:-1]) == 0
            before = np.concatenate([[0], np.cumsum(kept)])
            n_kept = before[word[1:]] - before[word[:-1]]
            a, b = start[kept], end[kept]
            size = b - a + 1  # a space after each
            offset = np.concatenate([[0], np.cumsum(size)])
            index = np.arange(offset[-1]) + np.repeat(a - offset[:-1], size)
            out = np.append(raw, np.uint8(0x20))[np.minimum(index, len(raw))]
            out[offset[1:] - 1] = 0x20
            cut = offset[before[word]]
            texts = [out[i : max(i, j - 1)].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(word)), pa.array(np.diff(word) - n_kept), pa.array(texts, pa.binary()).cast(pa.string())], ["key", "n_words", "n_removed", "kept"])

    whole = docs.join(spans, docs["key"] == spans["doc"], "left").select("key", "text", "spans")
    without = every.where("key IS NULL").select("key", "text", F.lit(None).cast(whole.schema["spans"].dataType).alias("spans"))
    out = map_arrow(whole.unionByName(without), drop, "key long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("key", key)


def op8_tree_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH word AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i : i + 12], ' ')) AS h, array_to_string(w[i : i + 12], ' ') AS t
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM word WHERE len(w) >= 13)),
first AS (SELECT h, t, min(doc_id) AS m FROM win GROUP BY 1, 2),
hit AS (SELECT doc_id, i FROM win JOIN first USING (h, t) WHERE doc_id > m),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(generate_series(i, i + 12)) AS p FROM hit) GROUP BY 1),
kept AS (SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
         CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k FROM word LEFT JOIN gone USING (doc_id))
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(n_removed AS bigint) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
