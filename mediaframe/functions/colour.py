"""BT.601 conversion of 8-bit planar YUV and gray to packed RGB, in single precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# Gains (V to red, U to green, V to green, U to blue) of full and of limited range.
FULL = (1.402, 0.344136, 0.714136, 1.772)
LIMITED = (1.59603, 0.39176, 0.81297, 2.01723)


def gains(full: bool) -> tuple[float, float, float, float]:
    return FULL if full else LIMITED


def to_byte(x: np.ndarray) -> np.ndarray:
    """Rounded, halves away from zero, and clamped to a byte."""
    return np.clip(np.trunc(x + np.copysign(np.float32(0.5), x)), 0, 255).astype(np.uint8)


def expand(y: np.ndarray, full: bool) -> np.ndarray:
    y = y.astype(np.float32)
    return y if full else (y - np.float32(16)) * (np.float32(255) / np.float32(219))


def rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Red, green and blue bytes from samples of one size; chroma is not yet centred."""
    rv, gu, gv, bu = (np.float32(g) for g in gains(full))
    y = expand(y, full)
    u, v = u.astype(np.float32) - np.float32(128), v.astype(np.float32) - np.float32(128)
    return to_byte(y + rv * v), to_byte(y - gu * u - gv * v), to_byte(y + bu * u)


def rgb_columns(y: Column, u: Column, v: Column, full: bool) -> tuple[Column, Column, Column]:
    """rgb() as columns of FLOAT arithmetic."""
    lit = lambda x: F.lit(float(np.float32(x))).cast("float")
    f = lambda c: c.cast("float")
    rv, gu, gv, bu = (lit(g) for g in gains(full))
    y = f(y) if full else (f(y) - lit(16)) * lit(np.float32(255) / np.float32(219))
    u, v = f(u) - lit(128), f(v) - lit(128)
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(x.cast("double"), 0).cast("int")))
    return byte(y + rv * v), byte(y - gu * u - gv * v), byte(y + bu * u)
