"""Arithmetic of H.264 pictures, over whole arrays: prediction from moved pictures, and residuals from coefficients."""

from __future__ import annotations

import numpy as np

#: The interpolation filter of luma.
TAPS = (1, -5, 20, 20, -5, 1)
#: Scale of coefficients by qp % 6, for places with both indexes even, both odd, and others.
SCALES = ((10, 16, 13), (11, 18, 14), (13, 20, 16), (14, 23, 18), (16, 25, 20), (18, 29, 23))


def _filtered(a: np.ndarray, axis: int) -> np.ndarray:
    n = a.shape[axis] - len(TAPS) + 1
    return sum(t * np.take(a, np.arange(i, i + n), axis) for i, t in enumerate(TAPS))


def _byte(a: np.ndarray, shift: int) -> np.ndarray:
    return np.clip((a + (1 << shift - 1)) >> shift, 0, 255)


def _region(plane: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """Part of a picture [..., y, x] whose border goes on for ever."""
    ys, xs = (np.clip(np.arange(a, a + n), 0, size - 1) for a, n, size in ((y, height, plane.shape[-2]), (x, width, plane.shape[-1])))
    return plane[..., ys[:, None], xs[None, :]].astype(np.int64)


def moved_luma(plane: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """The block at (x, y), in quarters of a pixel, of pictures [..., y, x]: half places by six taps, quarters as means of the two nearest."""
    part = _region(plane, (x >> 2) - 2, (y >> 2) - 2, width + 6, height + 6)
    across = _filtered(part, -1)
    whole = part[..., 2:-3, 2:-3]
    half_x, half_y = _byte(across, 5)[..., 2:-3, :], _byte(_filtered(part, -2), 5)[..., 2:-3]
    centre = _byte(_filtered(across, -2), 10)
    here = lambda a: a[..., :height, :width]
    right = lambda a: a[..., :height, 1 : width + 1]
    below = lambda a: a[..., 1 : height + 1, :width]
    fx, fy = x & 3, y & 3
    if fx % 2 == 0 and fy % 2 == 0:
        return here({(0, 0): whole, (2, 0): half_x, (0, 2): half_y, (2, 2): centre}[fx, fy])
    if fy == 0:
        pair = (here(whole) if fx == 1 else right(whole)), here(half_x)
    elif fx == 0:
        pair = (here(whole) if fy == 1 else below(whole)), here(half_y)
    elif fy == 2:
        pair = (here(half_y) if fx == 1 else right(half_y)), here(centre)
    elif fx == 2:
        pair = (here(half_x) if fy == 1 else below(half_x)), here(centre)
    else:
        pair = (here(half_x) if fy == 1 else below(half_x)), (here(half_y) if fx == 1 else right(half_y))
    return (pair[0] + pair[1] + 1) >> 1


def moved_chroma(plane: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """The block at (x, y), in eighths of a pixel, of pictures [..., y, x], by weights of the four nearest."""
    part = _region(plane, x >> 3, y >> 3, width + 1, height + 1)
    fx, fy = x & 7, y & 7
    rows = (8 - fx) * part[..., :-1] + fx * part[..., 1:]
    return ((8 - fy) * rows[..., :-1, :] + fy * rows[..., 1:, :] + 32) >> 6


def scaled(coefficients: np.ndarray, qp: int) -> np.ndarray:
    """Levels [..., 4, 4] to coefficients, with flat scaling lists."""
    even, odd, other = SCALES[qp % 6]
    i, j = np.indices((4, 4))
    return coefficients * np.where((i % 2 == 0) & (j % 2 == 0), even, np.where((i % 2 == 1) & (j % 2 == 1), odd, other)) << qp // 6


def residual(coefficients: np.ndarray) -> np.ndarray:
    """The inverse transform of [..., 4, 4]: integer butterflies along rows, then columns, rounded by 64."""
    out = coefficients.astype(np.int64)
    for axis in (-1, -2):
        a, b, c, d = np.moveaxis(out, axis, 0)
        even, odd = (a + c, a - c), ((b >> 1) - d, b + (d >> 1))
        out = np.stack([even[0] + odd[1], even[1] + odd[0], even[1] - odd[0], even[0] - odd[1]], axis)
    return (out + 32) >> 6
