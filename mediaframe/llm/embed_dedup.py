"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Vectors are compared only within one label (and one dimension). Equal vectors of a label are one representative with a
number of copies. A table's hash of a vector is ``k`` cross-polytope codes: after three rounds of random signs and a fast
Hadamard transform, the coordinate of largest magnitude with its sign. A vector lives in the bucket of its codes and visits
``PROBES`` more: those in which one code is replaced by its second choice, smallest loss first. ``k`` follows from the
number of vectors (a bucket has about ``BUCKET`` of them), and the number of tables from the collision rate of pairs at the
threshold, measured by simulation, so that such a pair misses all tables with probability ``MISS`` at most. Where that takes
more than ``TABLES`` tables, fewer codes do with larger buckets; where even one code takes more, there are no codes: all vectors
of a label are one bucket, compared exactly in pairs of blocks.

In a bucket every resident is compared with the other residents and with the visitors: cosines in double precision, in
blocks. Buckets over ``BLOCK`` rows are split into pairs of blocks, none is capped. A pair that several tables or buckets
find counts in the first only; each row carries its codes of all tables for that. Blocks emit sums for each vector and a
spanning forest, never the pairs. A cosine within ``CLOSE`` of the threshold is computed again by the plain formula with exact
sums, so that it does not depend on the block that a pair falls in.

Null, empty or zero vectors, those with null or non-finite components, and null labels link with nothing: n_links 0, their
own component. Null ids are kept as rows without links. Repeated rows are one vector. Rows of one id with other vectors or
labels share the id: its links are the sum of its vectors' links to other ids, its component holds what any of them links to.
Vectors of other lengths never link. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediaframe.llm.common import blocks, components, forest, grouped, materialize, one_column
from mediaframe.session import map_arrow

THRESHOLD = 0.93
PROBES = 1
BUCKET = 400
BLOCK = 1024
MISS = 0.002
TABLES = 200
CLOSE = 1e-12
SEED = 20240


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    x = x.copy()
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, k: int, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers of unit rows, [rows, tables, 1 + probes]: the own bucket, then those visited."""
    n, dim = x.shape
    d = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng([SEED, d])
    out = np.zeros((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        first, second, loss = np.empty((3, n, k))
        for j in range(k):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d)) / math.sqrt(d)
            size = np.abs(y)
            top = np.argpartition(size, d - 2, axis=1)[:, d - 2 :]
            swap = size[rows, top[:, 0]] > size[rows, top[:, 1]]
            best, next_ = np.where(swap, top[:, 0], top[:, 1]), np.where(swap, top[:, 1], top[:, 0])
            first[:, j], second[:, j] = best + d * (y[rows, best] < 0), next_ + d * (y[rows, next_] < 0)
            loss[:, j] = size[rows, best] - size[rows, next_]
        if not k:
            out[:, t, 1:] = -1
            continue
        base = (2 * d) ** np.arange(k)
        out[:, t, 0] = (first * base).sum(axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        for p in range(min(probes, k)):
            other = first.copy()
            other[rows, order[:, p]] = second[rows, order[:, p]]
            out[:, t, 1 + p] = (other * base).sum(axis=1)
        for p in range(min(probes, k), probes):
            out[:, t, 1 + p] = -1
    return out


def collide(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows meet in each table, from codes of [..., tables, 1 + probes]."""
    return (x[..., :1] == y).any(axis=-1) | (y[..., :1] == x).any(axis=-1)


def plan(count: int, dim: int, threshold: float) -> tuple[int, int]:
    """Codes in a bucket's number, and tables, for so many vectors of a label."""
    d = max(2, 1 << (dim - 1).bit_length())
    k = max(1, math.ceil(math.log(max(count / BUCKET, 1), 2 * d)))
    rng = np.random.default_rng(SEED)
    x = rng.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z
    while k:
        rate = float(collide(codes(x, 4, k), codes(y, 4, k)).mean())
        tables = max(2, math.ceil(math.log(MISS) / math.log(1 - min(rate, 1 - 1e-9)))) if rate > 0 else TABLES + 1
        if tables <= TABLES:
            return k, tables
        k -= 1
    return 0, 1


def plain_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum((a * b).tolist()) / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))


def find_links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id) for every row."""
    rows = one_column(vectors, key=key, vector=vector, label=label).withColumn("vector", F.col("vector").cast("array<double>"))
    good = "key IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(vector, x -> x <> 0)"
    rows = rows.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
    usable = rows.where("good").select("key", "vector", F.xxhash64(F.col("label").cast("string"), F.size("vector")).alias("class"))
    same = usable.groupBy("class", "vector").agg(F.min("key").alias("rep"), F.count_distinct("key").alias("copies"))
    reps = materialize(same, "representatives")
    stats = reps.groupBy(F.size("vector").alias("dim"), "class").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()  # a row for each dimension
    plans = {r["dim"]: plan(r["n"], r["dim"], threshold) for r in stats}

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["class", "table", "bucket", "resident", "id", "copies", "vector", "codes"]
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(np.asarray(lists.offsets))
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(at))
                x = np.asarray(part.column("vector").flatten()).reshape(len(at), dim)
                k, tables = plans[int(dim)]
                code = codes(x / np.linalg.norm(x, axis=1, keepdims=True), tables, k)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(code.reshape(len(at), -1).ravel()), tables * (1 + PROBES)).cast(pa.list_(pa.int64()))
                for t in range(tables):
                    for p in range(1 + PROBES):
                        some = pa.array(np.flatnonzero(code[:, t, p] >= 0))
                        m = len(some)
                        if m:
                            sub = part.take(some)
                            yield pa.RecordBatch.from_arrays(
                                [sub.column("class"), pa.array(np.full(m, t, np.int32)), pa.array(code[:, t, p][np.asarray(some)]), pa.array(np.full(m, int(p == 0), np.int32)), sub.column("rep"), sub.column("copies"), sub.column("vector"), flat.take(some)],
                                names,
                            )

    dealt = map_arrow(reps, hash_rows, "class long, table int, bucket long, resident int, id long, copies long, vector array<double>, codes array<long>")
    keys = ["class", "table", "bucket"]
    sized = blocks(dealt, keys, "id", BLOCK)
    full = [*keys, "low_block", "high_block"]
    dealt = sized.repartition(*full).sortWithinPartitions(*full)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, full):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            column = lambda c: np.asarray(group.column(c).combine_chunks())
            n, t = group.num_rows, int(group.column("table")[0].as_py())
            ids, copies, resident, own = column("id"), column("copies"), column("resident") == 1, column("own_block")
            given = np.asarray(group.column("vector").combine_chunks().flatten()).reshape(n, -1)
            x = given / np.linalg.norm(given, axis=1, keepdims=True)
            code = np.asarray(group.column("codes").combine_chunks().flatten()).reshape(n, -1, 1 + PROBES)
            crossing = column("low_block")[0] != column("high_block")[0]
            linked = np.zeros((n, n), bool)
            add = np.zeros(n, np.int64)
            for a in range(0, n, 256):
                cosine = x[a : a + 256] @ x.T
                block = cosine >= threshold
                for i, j in zip(*np.nonzero(np.abs(cosine - threshold) <= CLOSE)):
                    block[i, j] = plain_cosine(given[a + i], given[j]) >= threshold
                block &= (resident[a : a + 256, None] | resident[None, :]) & (ids[a : a + 256, None] != ids[None, :])
                if crossing:
                    block &= own[a : a + 256, None] != own[None, :]
                linked[a : a + 256] = block
            i, j = np.nonzero(np.triu(linked, 1))
            linked |= linked.T
            # only what no earlier table, and no earlier bucket of this table, has counted
            for s in range(0, len(i), 100_000):
                a, b = i[s : s + 100_000], j[s : s + 100_000]
                new = ~collide(code[a, :t], code[b, :t]).any(axis=1) if t else np.ones(len(a), bool)
                low, high = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
                # both buckets of this table may hold the pair: the one where the smaller id lives counts it
                new &= resident[low] | ~(code[high, t, 1:] == code[low, t, :1]).any(axis=1)
                add += np.bincount(a[new], copies[b[new]], n).astype(np.int64) + np.bincount(b[new], copies[a[new]], n).astype(np.int64)
            node, root = forest(linked, ids)
            some = np.flatnonzero(add)
            if len(some) or len(node):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[some], node])), pa.array(np.concatenate([add[some], np.zeros(len(node), np.int64)])), pa.array(np.concatenate([ids[some], root]))],
                    ["id", "links", "root"],
                )

    found = materialize(map_arrow(dealt, compare, "id long, links long, root long"), "links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    info = same_info(reps, sums, component)
    linked = usable.join(info, ["class", "vector"]).select("key", "n_links", "component")
    alone = rows.where("NOT good").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").cast("long").alias("component"))
    return linked.unionByName(alone).select(F.col("key").alias(key), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"))


def same_info(reps: DataFrame, sums: DataFrame, component: DataFrame) -> DataFrame:
    """(class, vector, n_links, component) of each representative."""
    out = reps.join(sums, reps["rep"] == sums["id"], "left").join(component, F.col("rep") == F.col("node"), "left")
    return out.select("class", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))


def op10_embed_dedup(spark, sf_dir: str) -> DataFrame:
    found = find_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, cast(embedding AS double[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT vec_id, cast(coalesce(n, 0) AS bigint) AS n_links, cast(least(vec_id, coalesce(m, vec_id)) AS bigint) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT x, count(*) AS n FROM link GROUP BY 1) l ON l.x = vec_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY 1) r ON r.x = vec_id
"""
