"""Smoothing of the edges between H.264 blocks, on arrays of lines across an edge."""

from __future__ import annotations

import numpy as np

#: Thresholds of the step at an edge and beside it, by quality from 16 on (0 below), and the most a pixel is moved
#: for strengths 1, 2 and 3, by quality from 17 on (0 below).
ALPHA = (4, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 17, 20, 22, 25, 28, 32, 36, 40, 45, 50, 56, 63, 71, 80, 90, 101, 113, 127, 144, 162, 182, 203, 226, 255, 255)
BETA = (2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16, 17, 17, 18, 18)
MOVES = (
    (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 1, 1), (0, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 2), (1, 1, 2),
    (1, 1, 2), (1, 1, 2), (1, 2, 3), (1, 2, 3), (2, 2, 3), (2, 2, 4), (2, 3, 4), (2, 3, 4), (3, 3, 5), (3, 4, 6), (3, 4, 6), (4, 5, 7),
    (4, 5, 8), (4, 6, 9), (5, 7, 10), (6, 8, 11), (6, 8, 13), (7, 10, 14), (8, 11, 16), (9, 12, 18), (10, 13, 20), (11, 15, 23), (13, 17, 25),
)


def smoothed(lines: np.ndarray, strength: np.ndarray, qp: int, alpha_offset: int, beta_offset: int, luma: bool) -> np.ndarray:
    """lines [n, 8] (luma) or [n, 4] (chroma) across an edge in the middle, strengths 0 to 4 of each; the pixels afterwards."""
    index_a, index_b = (min(max(qp + o, 0), 51) for o in (alpha_offset, beta_offset))
    if index_a < 16 or index_b < 16:
        return lines
    alpha, beta = ALPHA[index_a - 16], BETA[index_b - 16]
    half = lines.shape[1] // 2
    p, q = [lines[:, half - 1 - i] for i in range(half)], [lines[:, half + i] for i in range(half)]
    on = (strength > 0) & (abs(p[0] - q[0]) < alpha) & (abs(p[1] - p[0]) < beta) & (abs(q[1] - q[0]) < beta)
    if not on.any():
        return lines
    out = lines.copy()
    moves = np.array((0, *(MOVES[index_a - 17] if index_a > 16 else (0, 0, 0)), 0))[strength]
    near_p, near_q = (abs(p[2] - p[0]) < beta, abs(q[2] - q[0]) < beta) if luma else (False, False)
    most = moves + near_p + near_q if luma else moves + 1
    delta = np.clip(((q[0] - p[0]) * 4 + p[1] - q[1] + 4) >> 3, -most, most)
    flat = abs(p[0] - q[0]) < (alpha >> 2) + 2
    for side, other, near, place, sign in ((p, q, near_p, lambda i: half - 1 - i, 1), (q, p, near_q, lambda i: half + i, -1)):
        weak = on & (strength < 4)
        out[:, place(0)] = np.where(weak, np.clip(side[0] + sign * delta, 0, 255), side[0])
        strong = on & (strength == 4)
        short = (2 * side[1] + side[0] + other[1] + 2) >> 2
        if not luma:
            out[strong, place(0)] = short[strong]
            continue
        middle = (p[0] + q[0] + 1) >> 1
        out[:, place(1)] = np.where(weak & near, side[1] + np.clip((side[2] + middle - 2 * side[1]) >> 1, -moves, moves), side[1])
        long = strong & near & flat
        out[strong & ~long, place(0)] = short[strong & ~long]
        total = side[0] + other[0]
        out[long, place(0)] = ((side[2] + 2 * side[1] + 2 * total + other[1] + 4) >> 3)[long]
        out[long, place(1)] = ((side[2] + side[1] + total + 2) >> 2)[long]
        out[long, place(2)] = ((2 * side[3] + 3 * side[2] + side[1] + total + 4) >> 3)[long]
    return out
