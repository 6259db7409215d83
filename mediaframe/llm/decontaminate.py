r"""Benchmark decontamination: windows of training words are looked up among the hashed windows of benchmark items.

Words are runs of bytes outside ``[\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased. An item's windows are its runs
of ``size`` words; an item of fewer words, but not none, is one window. Everything is a DataFrame expression:

* word hashes of a document are an array; arrays of the hashes of 2, 4, 8, ... words are made by pairing an array with
  itself, shifted, so that a window's hash takes a few operations and no slices;
* the hashes are exploded with their positions and joined with the benchmark's. The benchmark's window hashes are
  broadcast if their counted number is within ``BROADCAST_ROWS``; beyond that the join is a shuffled one;
* every hit is verified by comparing the words themselves, at the hit's position, with the window's words;
* hits of a document become an array of hit words, and its text is joined once, by id and a hash of the text: only texts with
  hits are cut into words a second time.

Null and empty texts have no words. An item without words has no windows. Repeated items each count. Every row is judged by its
own text: rows of one id with different texts, rows without an id, and repeated rows. Ties cannot occur. Very long texts are
taken whole. Without documents or without benchmark items nothing is hit. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mediaframe.llm.common import materialize, maybe_broadcast, one_column

SIZE = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def with_window_hashes(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds w<size>: the hash of the window that starts at each word; empty if the document has fewer words.

    Each doubling is a column of its own, so that no array is computed twice.
    """
    out = df.withColumn("h0", F.transform("words", lambda w: F.xxhash64(w)))
    top = max(sizes).bit_length()
    for i in range(1, top):
        out = out.withColumn(f"h{i}", _pair(f"h{i - 1}", f"h{i - 1}", 2 ** (i - 1)))
    for size in sizes:
        bits = [i for i in reversed(range(top)) if size >> i & 1]
        out, at = out.withColumn(f"w{size}", F.col(f"h{bits[0]}")), 2 ** bits[0]
        for i in bits[1:]:
            out, at = out.withColumn(f"w{size}", _pair(f"w{size}", f"h{i}", at)), at + 2**i
    return out


def _pair(a: str, b: str, step: int) -> Column:
    """Hashes of a[i] and b[i + step]; as many as both have."""
    n = F.greatest(F.size(b) - F.lit(step), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))


def benchmark_windows(benchmark: DataFrame, item_key: str, item_text: str, size: int) -> DataFrame:
    """(size, hash, text, items): each distinct window, its words joined by a space, and the items that have it."""
    items = one_column(benchmark, item=item_key, text=item_text).select("item", words(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(size)))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1))
    rows = items.select("item", "size", "words", at.alias("at")).select("item", "size", F.slice("words", F.col("at"), F.col("size")).alias("words"))
    return rows.groupBy("size", F.array_join("words", " ").alias("text")).agg(F.first("words").alias("words"), F.collect_set("item").alias("items"))


def find_contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, uid, n_words, spans, items) for every row; uid is a hash of the text.

    spans: sorted, distinct array of (start, end) word indexes of verified windows, end exclusive; items: the distinct
    items with occurring windows. Both are empty for clean documents.
    """
    docs = one_column(documents, key=key, text=text).withColumn("uid", F.xxhash64("text"))
    counted = docs.select("key", "uid", F.size(words(F.col("text"))).alias("n_words"))
    windows = materialize(benchmark_windows(benchmark, item_key, item_text, size), "windows")
    none = {"spans": "array<struct<start:int,end:int>>", "items": windows.schema["items"].dataType}
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `size` values
    if not sizes:
        return counted.select(F.col("key").alias(key), "uid", "n_words", *[F.array().cast(kind).alias(c) for c, kind in none.items()])
    single = with_window_hashes(windows.select("size", "words"), sizes)
    hashed = reduce(DataFrame.unionByName, (single.where(F.col("size") == n).select("size", F.element_at(f"w{n}", 1).alias("hash")) for n in sizes)).distinct()

    arrays = with_window_hashes(docs.select("key", "uid", words(F.col("text")).alias("words")), sizes)
    per_size = arrays.select("key", "uid", F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.col(f"w{n}").alias("hashes")) for n in sizes])).alias("e"))
    every = per_size.select("key", "uid", "e.size", F.posexplode("e.hashes").alias("pos", "hash"))
    hits = materialize(every.join(maybe_broadcast(hashed, BROADCAST_HASHES), ["size", "hash"]).select("key", "uid", "size", "pos"), "hits")

    # the documents with hits, with the words at the hits: equality of the words is what counts
    places = hits.groupBy("key", "uid").agg(F.collect_set(F.struct("size", "pos")).alias("places"))
    found = of_rows(docs, maybe_broadcast(places, BROADCAST_PLACES), "inner").select("key", "uid", words(F.col("text")).alias("words"), "places")
    # the words are made below the explode, once for each text
    found = found.select("key", "uid", "words", F.explode("places").alias("p"))
    found = found.select("key", "uid", "p.size", "p.pos", F.array_join(F.slice("words", F.col("p.pos") + 1, F.col("p.size")), " ").alias("text"))
    true = found.join(maybe_broadcast(windows.select("size", "text", "items"), BROADCAST_WINDOWS), ["size", "text"])
    spans = true.groupBy("key", "uid").agg(
        F.sort_array(F.collect_set(F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    spans = materialize(spans, "spans")
    out = of_rows(counted, maybe_broadcast(spans, BROADCAST_PLACES), "left")
    return out.select(F.col("key").alias(key), "uid", "n_words", *[F.coalesce(F.col(c), F.array().cast(kind)).alias(c) for c, kind in none.items()])


def of_rows(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """Rows joined with the facts of their key, which may be null, and uid; the facts' other columns come along."""
    other = facts.withColumnsRenamed({"key": "__key", "uid": "__uid"})
    return rows.join(other, rows["key"].eqNullSafe(other["__key"]) & (rows["uid"] == other["__uid"]), how).drop("__key", "__uid")


#: Rows up to which the windows' hashes, the hit positions of documents, and the windows with their words, are broadcast.
BROADCAST_HASHES = 200_000
BROADCAST_PLACES = 50_000
BROADCAST_WINDOWS = 50_000


def covered(spans: str = "spans") -> Column:
    """Distinct word indexes inside the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1))))


def hit_rows(documents: DataFrame, benchmark: DataFrame, key: str, text: str, options: dict) -> DataFrame:
    """(key, uid, hit) of the rows with hits: the word indexes inside them."""
    found = find_contamination(documents, benchmark, key, text, **options).where(F.size("spans") > 0)
    return materialize(found.select(F.col(key).alias("key"), "uid", covered().alias("hit")).dropDuplicates(["key", "uid"]), "contaminated")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without any window of the benchmark; all columns stay. Every row is judged by its own text, with or without an id."""
    bad = hit_rows(documents, benchmark, key, text, options).select(F.col("key").alias("__key"), F.col("uid").alias("__uid"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__uid"))
    return documents.join(maybe_broadcast(bad), same, "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, kept): the words outside all hits, lower-cased and joined by a space."""
    found = hit_rows(documents, benchmark, key, text, options)
    docs = one_column(documents, key=key, text=text).withColumn("uid", F.xxhash64("text"))
    out = of_rows(docs, maybe_broadcast(found, BROADCAST_PLACES), "left").select("key", "hit", words(F.col("text")).alias("words"))
    kept = F.when(F.col("hit").isNull(), F.col("words")).otherwise(F.filter("words", lambda w, i: ~F.array_contains(F.col("hit"), i)))
    return out.select(F.col("key").alias(key), F.array_join(kept, " ").alias("kept"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    hit = F.size(covered())
    return find_contamination(docs, bench).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS t
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
place AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc, sizes WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, item_id, k, i FROM place JOIN win USING (k, t)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""
