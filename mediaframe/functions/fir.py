"""The polyphase filter bank of the rate converter, and the conversion of a whole signal."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from mediaframe.functions.rational import INT_MAX, reduce


def bessel_i0(x: np.ndarray) -> np.ndarray:
    return np.i0(x)


@dataclass(frozen=True)
class Bank:
    """taps[phase] are the coefficients of a phase; one more phase than `phases`, for blending."""

    taps: np.ndarray
    phases: int
    length: int
    source_step: int
    target_step: int
    in_rate: int
    out_rate: int

    @property
    def start(self) -> int:
        return -self.phases * ((self.length - 1) // 2)

    @property
    def blends(self) -> bool:
        return self.target_step % self.source_step != 0

    def places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For output numbers: the first source sample, the phase, and the fraction (in source steps) to the next phase."""
        at = k.astype(np.int64) * self.target_step
        index = self.start + at // self.source_step
        return index // self.phases, index % self.phases, at % self.source_step

    def outputs(self, samples: int) -> int:
        """How many outputs a signal gives, its mirrored tail included."""
        total = samples + self.tail(samples)
        return max(0, -(-((1 + total - self.length) * self.phases - self.start) * self.source_step // self.target_step))

    def tail(self, samples: int) -> int:
        return (min(samples, self.length) + 1) // 2


WINDOWS = ("kaiser", "blackman_nuttall", "cubic")


@lru_cache(maxsize=64)
def bank(out_rate: int, in_rate: int, size: int = 32, shift: int = 10, cutoff: float = 0.97, window: str = "kaiser", beta: float = 9.0, exact: bool = True, scale: int = 0) -> Bank:
    """scale: bits of integer coefficients (15 or 30), or 0 for floats."""
    if window not in WINDOWS or min(out_rate, in_rate) <= 0:
        raise ValueError("rates must be positive and the window one of " + ", ".join(WINDOWS))
    factor = min(out_rate * cutoff / in_rate, 1.0)
    length = max(math.ceil(size / factor), 1)
    length += length % 2 if length > 1 else 0
    phases = 1 << shift
    if exact:
        num = reduce(out_rate, in_rate)[0].num
        phases = num if num <= phases else phases
    center = (length - 1) // 2
    offset = (np.arange(length)[None, :] - center) - np.arange(phases)[:, None] / phases
    x = math.pi * offset * factor
    if window == "cubic":
        a = np.abs(offset * factor)
        y = np.where(a < 1, 1 - 3 * a**2 + 2 * a**3 - 0.5 * (-(a**2) + a**3), -0.5 * (-4 + 8 * a - 5 * a**2 + a**3))
    else:
        with np.errstate(invalid="ignore", divide="ignore"):
            y = np.where(x == 0, 1.0, np.sin(x) / x)
        w = 2 * x / (factor * length)
        if window == "blackman_nuttall":
            t = -np.cos(w)
            y = y * (0.3635819 - 0.4891775 * t + 0.1365995 * (2 * t * t - 1) - 0.0106411 * (4 * t**3 - 3 * t))  # fixed values
        else:
            y = y * bessel_i0(beta * np.sqrt(np.maximum(1 - (w / math.pi) ** 2, 0)))
    taps = y / y[0].sum()
    if scale:
        taps = np.clip(np.rint(taps * (1 << scale)), -(1 << scale), (1 << scale) - 1)
    if phases % 2 == 0:  # the second half mirrors the first
        for ph in range(phases // 2 + 1, phases):
            taps[ph] = taps[phases - ph][::-1]
    taps = np.vstack([taps, np.roll(taps[0], 1)])
    ratio, whole = reduce(out_rate, in_rate * phases, INT_MAX // 2)
    if not whole:
        raise ValueError(f"resampling ratio {out_rate}/{in_rate} is not exact")
    source, target = ratio.num, ratio.den
    while source < 1 << 20 and target < 1 << 20:
        source, target = source * 2, target * 2
    return Bank(taps, phases, length, source, target, in_rate, out_rate)


def extended(x: np.ndarray, b: Bank) -> tuple[np.ndarray, int]:
    """The signal with its mirrored head and tail, and where its first sample is."""
    head = min(b.length, max(len(x) - 1, 0))
    tail = b.tail(len(x))
    return np.concatenate([x[1 : head + 1][::-1], x, x[::-1][:tail]]), head


def resample(x: np.ndarray, b: Bank) -> np.ndarray:
    """The whole signal at the other rate, in double precision."""
    if not len(x):
        return x.astype(np.float64)
    n = b.outputs(len(x))
    padded, head = extended(x.astype(np.float64), b)
    padded = np.concatenate([padded, np.zeros(b.length)])
    out = np.empty(n)
    for at in range(0, n, 65536):
        first, phase, fraction = b.places(np.arange(at, min(n, at + 65536)))
        window = padded[np.maximum(first + head, 0)[:, None] + np.arange(b.length)]
        value = (window * b.taps[phase]).sum(axis=1)
        if b.blends:
            value += ((window * b.taps[phase + 1]).sum(axis=1) - value) * fraction / b.source_step
        out[at : at + len(value)] = value
    return out
