"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

1. Every labelled training text is turned into the set of its hashed, lower-cased character n-grams (``ORDERS``, hashed to
   ``BITS`` bits). Executors count, over all training rows, in how many texts of each class a feature occurs.
2. The log-count ratio of a feature is r = log((p / |p|) / (q / |q|)), p and q being its smoothed counts of texts of the two
   classes. The ``FEATURES`` features with the highest G statistic stay.
3. A logistic regression on presence * r is fitted on the driver to at most ``SAMPLE`` training rows of each class, those of
   lowest hash; only the few kept features of a row come to the driver. The bound is a parameter.
4. Scoring looks every n-gram of the whole text up in a table of ``2 ** BITS`` slots; a text's score is the logistic function
   of the sum over the distinct features that it has.

Null and empty texts have no features; their score is that of the intercept. Without labelled rows of both classes the
score is the smoothed share of label 1 (0.5 without rows). A null or other label than 0 or 1 isn't used. Repeated training
rows count each time. A score of 0.5 counts as toxic. Texts of any length are read whole; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mediaframe.llm.common import chunks, materialize, maybe_broadcast, one_column
from mediaframe.session import map_arrow

ORDERS = (3, 4, 5)
BITS = 18
FEATURES = 4096
SAMPLE = 4000
SMOOTHING = 1.0
#: n-grams of a text up to which its distinct features are found by sorting.
SORTED = 4000
#: Of the squared weights, for each training row.
PENALTY = 1e-3


@dataclass(frozen=True)
class Model:
    """features: sorted feature numbers; weights: what the presence of each adds; bias: the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.features] = np.arange(len(self.features))
        return out


def grams(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the feature at each position of the batch's texts, and the offsets of each text's positions."""
    texts = [(x or "").lower() for x in batch.column("text").to_pylist()]
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(length)])
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
            continue
        h = np.zeros(n, np.uint32)
        for j in range(order):
            h *= np.uint32(0x01000193)
            h ^= codes[j : j + n]
        h += np.uint32(order)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - BITS)
        # n-grams that would cross into the next text are left out
        inside = np.zeros(len(codes) + 1, np.int8)
        for j in range(order - 1):
            cut = begin[1:] - 1 - j
            inside[cut[(cut >= begin[:-1]) & (length > j)]] = 1
        keep = inside[:n] == 0
        at = np.concatenate([[0], np.cumsum(np.maximum(length - order + 1, 0))])
        yield h[keep].astype(np.int64), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, no, yes): in how many texts of each label the feature occurs; feature -1 counts the texts."""
    counts, texts, flag = np.zeros((2, 1 << BITS), np.int64), [0, 0], np.zeros(1 << BITS, bool)
    for batch in chunks(batches, "text"):
        labels = batch.column("label").to_pylist()
        sets = list(grams(batch))
        for i, label in enumerate(labels):
            own = [h[at[i] : at[i + 1]] for h, at in sets]
            if sum(map(len, own)) < SORTED:
                counts[label, np.unique(np.concatenate(own))] += 1
            else:  # beyond some length a flag for every feature is quicker than sorting
                flag[:] = False
                for h in own:
                    flag[h] = True
                counts[label] += flag
            texts[label] += 1
    if sum(texts):
        some = np.flatnonzero(counts.any(axis=0))
        for part in np.array_split(some, max(1, len(some) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[0, part]), pa.array(counts[1, part])], ["feature", "no", "yes"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([texts[0]], pa.int64()), pa.array([texts[1]], pa.int64())], ["feature", "no", "yes"])


def present(batch: pa.RecordBatch, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and kept feature's index of each distinct pair."""
    pairs = []
    for h, at in grams(batch):
        slot = table[h]
        hit = np.flatnonzero(slot >= 0)
        pairs.append((np.searchsorted(at, hit, "right") - 1) * len(table) + slot[hit])
    both = np.unique(np.concatenate(pairs))
    return both // len(table), both % len(table)


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", use: Column | None = None, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit to the labelled documents; `use` is a condition on the column `key` for training rows."""
    rows = one_column(labels, key=key, label=label).where("label IN (0, 1) AND key IS NOT NULL")
    rows = (rows.where(use) if use is not None else rows).select("key", F.col("label").cast("int").alias("label"))
    docs = one_column(documents, key=key, text=text)
    texts = docs.join(maybe_broadcast(rows), "key").select("text", "label")
    counted = map_arrow(texts, _count, "feature int, no long, yes long").groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    counted = materialize(counted, "features")
    stats = counted.where("feature < 0").first()
    n0, n1 = (int(stats["no"]), int(stats["yes"])) if stats else (0, 0)
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 1) / (n0 + 1))))
    share1 = F.lit(n1 / (n0 + n1))
    total = F.col("no") + F.col("yes")
    log = lambda x, mean: F.when(x > 0, x * F.log(x / mean)).otherwise(0.0)
    g = log(F.col("yes"), total * share1) + log(F.col("no"), total * (1 - share1)) + log(n1 - F.col("yes"), (n0 + n1 - total) * share1) + log(n0 - F.col("no"), (n0 + n1 - total) * (1 - share1))
    top = counted.where(f"feature >= 0 AND no + yes > 1 AND no + yes < {n0 + n1}").withColumn("g", g).orderBy(F.desc("g"), "feature").limit(features).toPandas().sort_values("feature")
    kept = top["feature"].to_numpy(np.int64)
    # the lengths |p| and |q| are those of the kept features
    p, q = top["yes"].to_numpy() + SMOOTHING, top["no"].to_numpy() + SMOOTHING
    r = np.log((p / p.sum()) / (q / q.sum()))
    table = Model(kept, r, 0.0).table()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            doc, slot = present(batch, table)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(slot.astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], ["label", "slots"])

    # at most `sample` label rows of each class, those of lowest hash: few enough to be broadcast
    order = F.xxhash64(F.col("key").cast("string"), F.lit(7))
    least = [rows.where(F.col("label") == which).orderBy(order, "key").limit(sample) for which in (0, 1)]
    chosen = docs.join(F.broadcast(least[0].unionByName(least[1])), "key")
    data = map_arrow(chosen.select("text", "label"), pick, "label int, slots array<smallint>").toPandas()
    return _fit(kept, r, data["slots"].tolist(), data["label"].to_numpy(np.float64), (n0, n1))


def _fit(kept: np.ndarray, r: np.ndarray, slots: list, y: np.ndarray, totals: tuple[int, int]) -> Model:
    """Logistic regression by accelerated gradient steps; classes are weighted to their shares of all training rows."""
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    col = np.concatenate([np.asarray(s, np.int64) for s in slots]) if len(row) else np.zeros(0, np.int64)
    value = r[col]
    have = np.array([(y == 0).sum(), (y == 1).sum()], float)
    share = np.array(totals, float) / sum(totals) / np.maximum(have, 1)
    weight = share[y.astype(int)]  # sums to 1
    norm = np.sqrt(np.bincount(col, value**2 * weight[row], len(kept)) + 1e-12)
    w, b = np.zeros(len(kept)), float(np.log(totals[1] / totals[0]))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, 401):
        z = np.bincount(row, value * w[col], len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        grad = np.append(np.bincount(col, value * d[row], len(kept)) + PENALTY * norm * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * min(1.0, 4.0 * (1 - t / 401)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model(kept, w * r, float(b))


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every document."""
    docs = one_column(documents, key=key, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in chunks(batches, "text"):
            z = np.full(batch.num_rows, model.bias)
            if len(model.features):
                doc, slot = present(batch, table)
                z += np.bincount(doc, model.weights[slot], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["key", "score"])

    return map_arrow(docs, judge, f"key {dict(docs.dtypes)['key']}, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train_tables(spark, sf_dir: str, documents: DataFrame) -> Model:
    """The model of the query and the pipeline: held-out rows are never learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(documents, labels, use=~held_out("key"))


def drop_toxic(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with a score under 0.5; all columns stay. Null keys and repeated rows are judged by their own texts."""
    names = documents.columns
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in chunks(batches, text):
            z = np.full(batch.num_rows, model.bias)
            if len(model.features):
                doc, slot = present(pa.RecordBatch.from_arrays([batch.column(text)], ["text"]), table)
                z += np.bincount(doc, model.weights[slot], batch.num_rows)
            yield batch.filter(pa.array(z < 0))

    return map_arrow(documents.select(names), keep, documents.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train_tables(spark, sf_dir, docs))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
