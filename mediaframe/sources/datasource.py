"""A Python data source for local or mounted files of fixed-size records: `spark.read.format("mediaframe")`.

Options: path, kind (y4m or rawvideo), and for raw video pix_fmt, width, height; records_per_partition. A partition is a
range of frames that reads only its own bytes, so a large file is read by many tasks. Y4M files need frame lines without
parameters, which is checked at every frame.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mediaframe.functions.picture import Video
from mediaframe.plans.graph import FRAME
from mediaframe.sources import containers as c


class FrameRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind") or c.EXTENSIONS.get(options["path"].rsplit(".", 1)[-1], "rawvideo")
        self.each = int(options.get("records_per_partition", 256))
        if self.kind == "y4m":
            with open(self.path, "rb") as f:
                self.video, self.start = c.y4m_header(f.read(256))
            self.line = b"FRAME\n"
        else:
            self.video, self.start, self.line = Video(options.get("pix_fmt", "yuv420p"), int(options["width"]), int(options["height"])), 0, b""
        self.size = self.video.format.frame_bytes(self.video.width, self.video.height) + len(self.line)

    def partitions(self) -> list[InputPartition]:
        body = os.path.getsize(self.path) - self.start
        if body % self.size:
            raise c.ContainerError("the file does not hold whole frames of one size")
        count = body // self.size
        return [FrameRange(a, min(a + self.each, count)) for a in range(0, count, self.each)] or [FrameRange(0, 0)]

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(self.start + partition.first * self.size)
            for n in range(partition.first, partition.last):
                record = f.read(self.size)
                if not record.startswith(self.line):
                    raise c.ContainerError(f"frame {n} has a line with parameters")
                yield 0, n, n, 1, [bytearray(p) for p in c.planes_of(record[len(self.line) :], self.video)]


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mediaframe"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(dict(self.options))


def register(spark: SparkSession) -> None:
    from mediaframe.session import ship

    ship(spark)
    spark.dataSource.register(MediaSource)
