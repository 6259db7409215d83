"""Coded pictures as rows (stream_id, seq, idr, poc): their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def display_order(coded: DataFrame) -> DataFrame:
    """Adds `shown`, the number of a picture in the order of output: pictures up to the next that starts anew, by their order
    count; those of one count as they are coded. One shuffle by stream."""
    stream = Window.partitionBy("stream_id").orderBy("seq")
    epoch = coded.withColumn("__epoch", F.sum(F.col("idr").cast("long")).over(stream))
    shown = F.row_number().over(Window.partitionBy("stream_id").orderBy("__epoch", "poc", "seq")) - 1
    return epoch.withColumn("shown", shown.cast("long")).drop("__epoch")
