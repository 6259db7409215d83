"""Streams of audio blocks with a clock: late or missing data is repaired, state is kept for each stream.

Every block has a pts and a number of samples. The clock expects the next block right after the last one. A gap or an overlap
beyond ``hard`` ticks is made good by as much silence, or by dropping as many samples; smaller ones pass, and move the clock
by no more than the block's length. Blocks of a stream must arrive in order of pts within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mediaframe.session import ship

OUT = "stream_id long, pts long, samples long, silence long, dropped long"


def step(expected: int | None, pts: int, samples: int, hard: int) -> tuple[int, int, int]:
    """(silence before the block, samples dropped from its start, expected next pts)."""
    if expected is None:
        return 0, 0, pts + samples
    drift = pts - expected
    if drift > hard:
        return drift, 0, pts + samples
    if drift < -hard:
        lost = min(-drift, samples)
        return 0, lost, max(expected, pts + samples)
    return 0, 0, expected + samples


def repair(blocks: DataFrame, hard: int = 0) -> DataFrame:
    """From (stream_id, pts, samples): blocks with their repairs; batch and streaming alike, pts as repaired."""
    ship(blocks.sparkSession)

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("pts", kind="stable")
        out = []
        for pts, samples in zip(rows["pts"], rows["samples"]):
            begin = expected
            silence, dropped, expected = step(expected, int(pts), int(samples), hard)
            at = int(pts) if begin is None or silence else begin
            out.append((key[0], at, int(samples) - dropped, silence, dropped))
        state.update((expected,))
        yield pd.DataFrame(out, columns=["stream_id", "pts", "samples", "silence", "dropped"])

    return blocks.groupBy("stream_id").applyInPandasWithState(work, OUT, "expected long", "append", GroupStateTimeout.NoTimeout)
