"""Prediction of H.264 blocks from the pixels left of them and above them. A side that is not there is None."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from mediaframe.errors import MediaError

#: The place of the corner pixel in a border: pixels left of the block go down before it, those above go on behind it.
CORNER = 8


@lru_cache(maxsize=None)
def _places(mode: int) -> np.ndarray:
    """For each pixel of a 4x4 block its place in the border's means of two (from 0) or of three (from 32)."""
    pair, triple = 0, 32
    y, x = np.indices((4, 4))
    if mode == 3:
        return triple + CORNER + 2 + x + y
    if mode == 4:
        return triple + CORNER + x - y
    if mode in (5, 6):  # one is the other, mirrored
        a, b, sign = (x, y, 1) if mode == 5 else (y, x, -1)
        z, k = 2 * a - b, a - (b >> 1)
        mean = pair + (CORNER + k if mode == 5 else CORNER - 1 - k)
        return np.select([z < -1, z == -1, z % 2 == 0], [triple + CORNER - sign * (b - 1), np.full((4, 4), triple + CORNER), mean], triple + CORNER + sign * k)
    if mode == 7:
        return np.where(y % 2 == 0, pair + CORNER + 1, triple + CORNER + 2) + x + (y >> 1)
    return np.where(x % 2 == 0, pair, triple) + CORNER - 2 - y - (x >> 1)


def predict_4x4(mode: int, left, above, corner, right) -> np.ndarray:
    """left, above: four pixels; right: the four behind those above (None: the last one of above goes on)."""
    needs = {0: (above,), 1: (left,), 2: (), 3: (above,), 7: (above,), 8: (left,)}.get(mode, (left, above, corner))
    if any(v is None for v in needs):
        raise MediaError("a block is predicted from pixels that are not there")
    if mode == 0:
        return np.tile(above, (4, 1))
    if mode == 1:
        return np.repeat(left, 4).reshape(4, 4)
    if mode == 2:
        return np.full((4, 4), mean(left, above))
    e = np.zeros(32, np.int64)
    if left is not None:
        e[CORNER - 4 : CORNER] = left[::-1]
        e[: CORNER - 4] = left[3]
    if corner is not None:
        e[CORNER] = corner
    if above is not None:
        e[CORNER + 1 : CORNER + 5] = above
        e[CORNER + 5 : CORNER + 9] = above[3] if right is None else right
        e[CORNER + 9 :] = e[CORNER + 8]
    both = np.zeros(64, np.int64)
    both[:31] = (e[:-1] + e[1:] + 1) >> 1
    both[33:63] = (e[:-2] + 2 * e[1:-1] + e[2:] + 2) >> 2
    return both[_places(mode)]


def mean(left, above) -> int:
    """The rounded mean of the sides that are there; 128 without any."""
    sides = [s for s in (left, above) if s is not None]
    if not sides:
        return 128
    n = sum(len(s) for s in sides)
    return int((sum(int(np.sum(s)) for s in sides) + n // 2) // n)


def plane(left: np.ndarray, above: np.ndarray, corner: int) -> np.ndarray:
    """A slope through the border of a block of 16 or 8."""
    n = len(left)
    half, weight, shift = (8, 5, 6) if n == 16 else (4, 34, 6)

    def slope(side: np.ndarray) -> int:
        whole = np.concatenate([[corner], side]).astype(np.int64)
        steps = np.arange(1, half + 1)
        return (weight * int((steps * (whole[half + steps] - whole[half - steps])).sum()) + 32) >> shift

    centre = np.arange(n) - (half - 1)
    value = 16 * (int(left[-1]) + int(above[-1])) + slope(above) * centre[None, :] + slope(left) * centre[:, None]
    return np.clip((value + 16) >> 5, 0, 255)


def predict_16x16(mode: int, left, above, corner) -> np.ndarray:
    """0: from above, 1: from the left, 2: the mean, 3: a slope."""
    if (mode in (0, 3) and above is None) or (mode in (1, 3) and left is None) or (mode == 3 and corner is None):
        raise MediaError("a block is predicted from pixels that are not there")
    if mode == 0:
        return np.tile(above, (16, 1))
    if mode == 1:
        return np.repeat(left, 16).reshape(16, 16)
    return np.full((16, 16), mean(left, above)) if mode == 2 else plane(left, above, corner)


def predict_chroma(mode: int, left, above, corner) -> np.ndarray:
    """8x8 pixels. 0: means of each 4x4, 1: from the left, 2: from above, 3: a slope."""
    if (mode in (2, 3) and above is None) or (mode in (1, 3) and left is None) or (mode == 3 and corner is None):
        raise MediaError("a block is predicted from pixels that are not there")
    if mode == 1:
        return np.repeat(left, 8).reshape(8, 8)
    if mode == 2:
        return np.tile(above, (8, 1))
    if mode == 3:
        return plane(left, above, corner)
    out = np.empty((8, 8), np.int64)
    for y in (0, 1):
        for x in (0, 1):
            row, column = (None if s is None else s[4 * k : 4 * k + 4] for s, k in ((left, y), (above, x)))
            if x != y:  # these look at one side only, if it is there
                first = column if x else row
                row, column = (first, None) if first is not None else (row, column)
            out[4 * y : 4 * y + 4, 4 * x : 4 * x + 4] = mean(row, column)
    return out
