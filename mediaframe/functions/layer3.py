"""Arithmetic of MPEG audio's layer III between its codes and its filter bank: levels, stereo, order, aliases, transforms."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F

from mediaframe.functions import mdct

#: Lines of a granule, bands, and lines of a band.
LINES, BANDS, WIDTH = 576, 32, 18
#: The butterflies' ratios across the edge of two bands, and additions to scale factors of the upper bands.
ALIASES = (-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037)
EMPHASIS = (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 2, 0)
#: Kinds of blocks: long, first and last before and after short ones, and three short ones.
LONG, START, SHORT, STOP = range(4)


def line_value(level: Column, gain: Column, lowered: Column | None = None) -> Column:
    """A line from its level: its power of 4/3, with the gain in quarters of a factor of two from 210 on; lowered: halvings by scale factors."""
    scale = F.pow(F.lit(2.0), (gain - 210) / 4 - (lowered if lowered is not None else F.lit(0.0)))
    return F.signum(level.cast("double")) * F.pow(F.abs(level).cast("double"), F.lit(4.0 / 3.0)) * scale


def halvings(factor: Column, band: Column, coarse: Column, emphasis: Column) -> Column:
    """What line_value lowers a band of long blocks by."""
    more = F.element_at(F.array(*[F.lit(v) for v in EMPHASIS]), (band + 1).cast("int"))
    return F.when(coarse, 1.0).otherwise(0.5) * (factor + F.when(emphasis, more).otherwise(0))


def middle_side(middle: Column, side: Column) -> tuple[Column, Column]:
    """(left, right)."""
    half = F.sqrt(F.lit(0.5))
    return (middle + side) * half, (middle - side) * half


def intensity(value: Column, position: Column) -> tuple[Column, Column]:
    """(left, right) of a line that both share, by its position from 0 (right only) to 6 (left only); at 7 it is the left's alone, as coded."""
    ratio = F.tan(position * F.lit(np.pi / 12))
    left = F.when(position == 6, value).when(position == 7, value).otherwise(value * ratio / (1 + ratio))
    return left, F.when(position >= 6, 0.0).otherwise(value / (1 + ratio))


def by_frequency(lines: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """Lines of short blocks [..., n], coded as three runs for each band of a width, in the order of frequency."""
    order, at = [], 0
    for width in widths:
        order.append((at + np.arange(3 * width).reshape(3, width)).T.ravel())
        at += 3 * width
    if at != lines.shape[-1]:
        raise ValueError(f"the bands have {at} lines, not {lines.shape[-1]}")
    return lines[..., np.concatenate(order)]


def without_aliases(lines: np.ndarray, edges: int = BANDS - 1) -> np.ndarray:
    """Lines [..., 576] after the butterflies over the first edges between bands."""
    c = np.array(ALIASES)
    keep, cross = 1 / np.sqrt(1 + c * c), c / np.sqrt(1 + c * c)
    out = np.array(lines, float)
    middle = WIDTH * np.arange(1, edges + 1)[:, None]
    low, high = middle - 1 - np.arange(len(c)), middle + np.arange(len(c))
    below, above = out[..., low], out[..., high]
    out[..., low], out[..., high] = below * keep - above * cross, above * keep + below * cross
    return out


@lru_cache(maxsize=None)
def window(kind: int) -> np.ndarray:
    """36 weights of a block that is not short."""
    long, short = mdct.window("sine", WIDTH), mdct.window("sine", WIDTH // 3)
    half = np.concatenate([np.ones(6), short[6:], np.zeros(6)])
    if kind == START:
        return np.concatenate([long[:WIDTH], half])
    return np.concatenate([half[::-1], long[WIDTH:]]) if kind == STOP else long


def samples(lines: np.ndarray, kind: int) -> np.ndarray:
    """Windowed samples [..., 36] of bands' lines [..., 18]; three short blocks overlap in the middle, their lines lying by turns."""
    if kind != SHORT:
        return lines @ mdct.basis(WIDTH) * window(kind)
    n = WIDTH // 3
    out = np.zeros((*lines.shape[:-1], 2 * WIDTH))
    for turn in range(3):
        out[..., n * (turn + 1) : n * (turn + 3)] += lines[..., turn::3] @ mdct.basis(n) * mdct.window("sine", n)
    return out


def bands(granules: np.ndarray, kinds: list[int]) -> np.ndarray:
    """Samples [granule, 18, 32] of the bands, out of lines [granule, 576] of one channel: each block's first half on the last half
    of the one before it; every other sample of every other band is turned, as the filter bank wants it."""
    parts = np.stack([samples(g.reshape(BANDS, WIDTH), kind) for g, kind in zip(granules, kinds, strict=True)]) if len(kinds) else np.zeros((0, BANDS, 2 * WIDTH))
    out = parts[..., :WIDTH].copy()
    out[1:] += parts[:-1, :, WIDTH:]
    out[:, 1::2, 1::2] *= -1
    return out.swapaxes(1, 2)
