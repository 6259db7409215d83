"""Audio as rows (stream_id, k, ch, v): casts, channel mixing, rate conversion, trimming and timestamps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mediaframe.functions import layouts, mdct as transform, samples
from mediaframe.functions.fir import bank
from mediaframe.session import map_arrow, ship


def cast(pcm: DataFrame, source: str, target: str) -> DataFrame:
    return pcm.withColumn("v", samples.cast(F.col("v"), source, target))


def mix(pcm: DataFrame, rows: list[list[float]]) -> DataFrame:
    """Each output channel is the weighted sum of the input channels: a broadcast join with the matrix (64 x 64 at most), and a sum over the channels of a sample."""
    flat = [(o, i, float(c)) for o, r in enumerate(rows) for i, c in enumerate(r) if c]
    m = F.broadcast(pcm.sparkSession.createDataFrame(flat, "out int, ch int, c double"))
    return pcm.join(m, "ch").groupBy("stream_id", "k", F.col("out").alias("ch")).agg(F.sum(F.col("v") * F.col("c")).alias("v"))


def mix_fixed(pcm: DataFrame, rows: list[list[int]], clip: int = 16) -> DataFrame:
    """Integer mixing with 15-bit coefficients: rounded, and clipped where a row's magnitudes exceed one."""
    flat = [(o, i, int(c)) for o, r in enumerate(rows) for i, c in enumerate(r) if c]
    m = F.broadcast(pcm.sparkSession.createDataFrame(flat, "out int, ch int, c long"))
    total = F.shiftright(F.sum(F.col("v").cast("long") * F.col("c")) + 16384, 15)
    if max(sum(map(abs, r)) for r in rows) > 1 << 15:
        total = F.greatest(F.lit(-(1 << (clip - 1))), F.least(F.lit((1 << (clip - 1)) - 1), total))
    return pcm.join(m, "ch").groupBy("stream_id", "k", F.col("out").alias("ch")).agg(total.alias("v"))


def remix(pcm: DataFrame, source: str, target: str, levels: layouts.Levels = layouts.Levels()) -> DataFrame:
    return mix(pcm, layouts.matrix(layouts.Layout.parse(source), layouts.Layout.parse(target), levels))


def select_channels(pcm: DataFrame, mapping: list[int], fmt: str = "s16") -> DataFrame:
    """Output channel i is input channel mapping[i]; -1 is silence."""
    m = F.broadcast(pcm.sparkSession.createDataFrame([(i, c) for i, c in enumerate(mapping)], "out int, src int"))
    picked = pcm.join(m, pcm["ch"] == m["src"]).select("stream_id", "k", F.col("out").alias("ch"), "v")
    if -1 not in mapping:
        return picked
    empty = F.explode(F.array(*[F.lit(i) for i, c in enumerate(mapping) if c < 0])).alias("ch")
    silent = pcm.select("stream_id", "k").distinct().select("stream_id", "k", empty, F.lit(samples.silence(fmt)).cast(pcm.schema["v"].dataType).alias("v"))
    return picked.unionByName(silent)


def interleave(pcm: DataFrame, channels: int) -> DataFrame:
    """Mono rows read as interleaved channels."""
    return pcm.select("stream_id", F.floor(F.col("k") / channels).alias("k"), F.pmod("k", F.lit(channels)).cast("int").alias("ch"), "v")


#: Output samples that a task makes at a time.
BLOCK = 1 << 16


def resample(pcm: DataFrame, in_rate: int, out_rate: int, block: int = BLOCK, **options) -> DataFrame:
    """Rate conversion, split by ranges of output samples: a block gets its source samples and as many beside them as the
    filter is long (those at a block's edge go to two blocks), so that a signal of any length is made by many tasks."""
    ship(pcm.sparkSession)
    b = bank(out_rate, in_rate, **options)
    size = pcm.groupBy("stream_id", "ch").agg(F.count("*").alias("size"))
    rows = pcm.join(size, ["stream_id", "ch"])
    tail = F.floor((F.least("size", F.lit(b.length)) + 1) / 2)
    outputs = F.ceil(((1 + F.col("size") + tail - b.length) * b.phases - b.start) * b.source_step / F.lit(b.target_step))
    # the outputs that read sample k, one more on either side for rounding; the ends are mirrored, so their blocks get them too
    of = lambda k: (k * b.phases - b.start) * b.source_step / F.lit(b.target_step)
    low = F.greatest(F.floor((of(F.col("k") - b.length) - 1) / block), F.lit(0))
    last = F.floor((outputs - 1) / block)
    high = F.when(F.col("k") >= F.col("size") - 3 * b.length, last).otherwise(F.least(F.floor((of(F.col("k") + 1) + 1) / block), last))
    low = F.when(F.col("k") <= b.length, F.lit(0)).otherwise(F.least(low, high))
    rows = rows.where(outputs > 0).select("stream_id", "ch", "k", F.col("v").cast("double").alias("v"), "size", outputs.cast("long").alias("outputs"), F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("block"))

    def work(table: pa.Table) -> pa.Table:
        column = lambda c: np.asarray(table.column(c).combine_chunks())
        k, v = column("k"), column("v")
        order = np.argsort(k, kind="stable")
        k, v = k[order], v[order]
        n, total, at = int(column("size")[0]), int(column("outputs")[0]), int(column("block")[0]) * block
        o = np.arange(at, min(total, at + block))
        out = np.empty(len(o))
        for i in range(0, len(o), 16384):
            first, phase, fraction = b.places(o[i : i + 16384])
            read = first[:, None] + np.arange(b.length)
            read = np.where(read < 0, -read, np.where(read >= n, 2 * n - 1 - read, read))
            place = np.clip(np.searchsorted(k, read), 0, len(k) - 1)
            window = np.where(k[place] == read, v[place], 0.0)  # shorter signals than the filter read zeros
            value = (window * b.taps[phase]).sum(axis=1)
            if b.blends:
                value += ((window * b.taps[phase + 1]).sum(axis=1) - value) * fraction / b.source_step
            out[i : i + len(value)] = value
        m = len(o)
        return pa.table({"stream_id": pa.array(np.full(m, column("stream_id")[0])), "k": pa.array(o), "ch": pa.array(np.full(m, column("ch")[0], np.int32)), "v": pa.array(out)})

    return rows.groupBy("stream_id", "ch", "block").applyInArrow(work, "stream_id long, k long, ch int, v double")


def resample_rows(pcm: DataFrame, in_rate: int, out_rate: int, **options) -> DataFrame:
    """resample() as joins: every output reads `length` source samples; the bank is broadcast (phases x length rows).

    With scale=15 or 30 the coefficients are integers, and so are the results, rounded and clipped to 16 or 32 bits.
    """
    b = bank(out_rate, in_rate, **options)
    scale = options.get("scale", 0)
    if b.blends:
        raise ValueError("the relational form needs exact phases")
    spark = pcm.sparkSession
    number = int if scale else float
    taps = F.broadcast(spark.createDataFrame([(p, i, number(c)) for p in range(b.phases) for i, c in enumerate(b.taps[p])], f"phase int, i int, c {'long' if scale else 'double'}"))
    size = pcm.groupBy("stream_id", "ch").agg(F.count("*").alias("size"))
    tail = F.floor((F.least("size", F.lit(b.length)) + 1) / 2)
    outputs = F.ceil(((1 + F.col("size") + tail - b.length) * b.phases - b.start) * b.source_step / F.lit(b.target_step))
    each = size.where("size > 0").select("stream_id", "ch", "size", F.explode(F.sequence(F.lit(0).cast("long"), outputs - 1)).alias("o"))
    index = F.lit(b.start) + F.expr(f"o * {b.target_step} div {b.source_step}")
    each = each.withColumn("index", index).withColumn("first", F.floor(F.col("index") / b.phases)).withColumn("phase", F.pmod("index", F.lit(b.phases)).cast("int"))
    at = F.col("first") + F.col("i")
    at = F.when(at < 0, -at).when(at >= F.col("size"), 2 * F.col("size") - 1 - at).otherwise(at)
    reads = each.join(taps, "phase").select("stream_id", "ch", "o", "i", "c", at.alias("k"))
    total = F.sum(F.col("v") * F.col("c"))
    if scale:
        most = 1 << (scale if scale == 15 else 31)
        total = F.greatest(F.lit(-most), F.least(F.lit(most - 1), F.shiftright(total + (1 << (scale - 1)), scale)))
    return reads.join(pcm, ["stream_id", "ch", "k"]).groupBy("stream_id", "ch", "o").agg(total.alias("v")).select("stream_id", F.col("o").alias("k"), "ch", "v")


def trim(pcm: DataFrame, skip: int, end: int | None = None) -> DataFrame:
    """Gapless trimming: samples before `skip` and from `end` on go, the rest is renumbered."""
    kept = pcm.where(F.col("k") >= skip)
    kept = kept.where(F.col("k") < end) if end is not None else kept
    return kept.withColumn("k", F.col("k") - skip)


def packet_times(packets: DataFrame, duration: str = "duration") -> DataFrame:
    """pts of each packet: the durations before it in its stream."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return packets.withColumn("pts", F.coalesce(F.sum(duration).over(w), F.lit(0).cast("bigint")))


def gapless(packets: DataFrame, skip: int, first_discard: int, last_discard: int) -> DataFrame:
    """skip_samples of the first packet, discard_padding of those that reach into the padding at the end."""
    end = F.col("pts") + F.col("duration")
    over = F.least(end - first_discard, F.col("duration"))
    reach = (end > first_discard) & (F.col("pts") < last_discard) & (F.lit(first_discard) > 0)
    return packets.withColumns({"skip_samples": F.when(F.col("pts") == 0, skip).otherwise(0), "discard_padding": F.when(reach, over).otherwise(F.lit(0)).cast("bigint")})


def mdct(pcm: DataFrame, size: int, window: str = "sine") -> DataFrame:
    """(stream_id, ch, frame, coefficients): frames of 2 * size samples, each half a frame on, from one that ends in the first
    half on; samples that are missing are zeros. One shuffle by frame; frames are transformed by Arrow batches."""
    into = pcm.select("stream_id", "ch", "k", "v", F.explode(F.array(F.lit(-1), F.lit(0))).alias("back"))
    into = into.withColumn("frame", F.floor(F.col("k") / size) + F.col("back"))
    frames = into.groupBy("stream_id", "ch", "frame").agg(F.collect_list(F.struct((F.col("k") - F.col("frame") * size).cast("int").alias("i"), F.col("v").cast("double").alias("v"))).alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("samples")
            flat, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            x = np.zeros((batch.num_rows, 2 * size))
            x[row, np.asarray(flat.field("i"))] = np.asarray(flat.field("v"))
            out = pa.FixedSizeListArray.from_arrays(pa.array(transform.forward(x, window).ravel()), size).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("stream_id", "ch", "frame")), out], ["stream_id", "ch", "frame", "coefficients"])

    return map_arrow(frames, run, "stream_id long, ch int, frame long, coefficients array<double>")


def overlap_add(frames: DataFrame, size: int, window: str = "sine") -> DataFrame:
    """Sample rows (stream_id, ch, k, v) of MDCT frames: a partial sum of at most two rows for each sample; k from 0 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("coefficients").flatten()).reshape(batch.num_rows, size)
            out = pa.FixedSizeListArray.from_arrays(pa.array(transform.inverse(x, window).ravel()), 2 * size).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("stream_id", "ch", "frame")), out], ["stream_id", "ch", "frame", "samples"])

    made = map_arrow(frames.select("stream_id", "ch", "frame", "coefficients"), run, "stream_id long, ch int, frame long, samples array<double>")
    each = made.select("stream_id", "ch", "frame", F.posexplode("samples").alias("i", "v")).withColumn("k", F.col("frame") * size + F.col("i"))
    return each.where("k >= 0").groupBy("stream_id", "ch", "k").agg(F.sum("v").alias("v"))
