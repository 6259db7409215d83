"""MPEG audio headers as columns: the fields of 32-bit words by bit arithmetic, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediaframe.sources.containers import BIT_RATES, MPEG_RATES


def header_columns(df: DataFrame, word: str) -> DataFrame:
    """Adds layer, lsf, sample_rate, kbits, frame_bytes, samples and channels; rows that are no header go, as do free-format ones."""
    bits = lambda shift, mask: F.shiftright(F.col(word), shift).bitwiseAND(mask).cast("int")
    ok = (bits(21, 0x7FF) == 0x7FF) & (bits(19, 3) != 1) & (bits(17, 3) != 0) & ~bits(12, 15).isin(0, 15) & (bits(10, 3) != 3)
    old = 1 - bits(20, 1)
    out = df.where(ok).withColumns({"layer": 4 - bits(17, 3), "lsf": F.when(old == 1, 1).otherwise(1 - bits(19, 1))})
    tables = F.array(*[F.array(*[F.lit(x) for x in BIT_RATES[k]]) for k in sorted(BIT_RATES)])
    rate = F.element_at(F.array(*map(F.lit, MPEG_RATES)), bits(10, 3) + 1)
    out = out.withColumns({"kbits": F.element_at(F.element_at(tables, F.col("lsf") * 3 + F.col("layer")), bits(12, 15) + 1)})
    out = out.withColumn("sample_rate", F.when(F.col("lsf") + old == 0, rate).when(F.col("lsf") + old == 1, F.shiftright(rate, 1)).otherwise(F.shiftright(rate, 2)))
    padding = bits(9, 1)
    whole = lambda factor, by: F.floor(F.col("kbits") * factor / by).cast("int")
    halved = F.when(F.col("lsf") == 1, F.col("sample_rate") * 2).otherwise(F.col("sample_rate"))
    size = F.when(F.col("layer") == 1, (whole(12000, F.col("sample_rate")) + padding) * 4).when(F.col("layer") == 3, whole(144000, halved) + padding).otherwise(whole(144000, F.col("sample_rate")) + padding)
    samples = F.when(F.col("layer") == 1, 384).when((F.col("layer") == 3) & (F.col("lsf") == 1), 576).otherwise(1152)
    return out.withColumns({"frame_bytes": size, "samples": samples, "channels": F.when(bits(6, 3) == 3, 1).otherwise(2)})
