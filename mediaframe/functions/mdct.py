"""The modified discrete cosine transform of frames that overlap by half, and its windows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WINDOWS = ("sine", "kbd")


@lru_cache(maxsize=16)
def window(name: str, size: int, alpha: float = 4.0) -> np.ndarray:
    """2 * size weights whose squares, half a window apart, sum up to one; kbd: derived from a Kaiser window of alpha."""
    if name == "sine":
        return np.sin(np.pi * (np.arange(2 * size) + 0.5) / (2 * size))
    if name != "kbd":
        raise ValueError("the window is one of " + ", ".join(WINDOWS))
    total = np.cumsum(np.kaiser(size + 1, np.pi * alpha))
    half = np.sqrt(total[:-1] / total[-1])
    return np.concatenate([half, half[::-1]])


@lru_cache(maxsize=16)
def basis(size: int) -> np.ndarray:
    """[coefficient, sample] cosines."""
    k, n = np.arange(size)[:, None] + 0.5, np.arange(2 * size)[None, :] + 0.5 + size / 2
    return np.cos(np.pi / size * n * k)


def forward(frames: np.ndarray, name: str = "sine") -> np.ndarray:
    """Rows of 2 * size samples to rows of size coefficients."""
    size = frames.shape[1] // 2
    return (frames * window(name, size)) @ basis(size).T


def inverse(coefficients: np.ndarray, name: str = "sine") -> np.ndarray:
    """Rows of coefficients to rows of windowed samples; where frames overlap, their sums are the signal."""
    size = coefficients.shape[1]
    return coefficients @ basis(size) * (2.0 / size) * window(name, size)
