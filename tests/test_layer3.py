"""Layer III's arithmetic against the standard's formulas, line by line, and against what transforms must give back."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import layer3, mdct


def test_lines_and_stereo(spark):
    rows = [(v, g, f, b, p) for v in (-8191, -8, -1, 0, 1, 27) for g, f, b, p in ((210, 0, 0, 0), (214, 3, 12, 3), (100, 2, 20, 6), (206, 1, 21, 7))]
    df = spark.createDataFrame(rows, "v int, g int, f int, b int, p int")
    left, right = layer3.intensity(F.col("v").cast("double"), F.col("p"))
    one, two = layer3.middle_side(F.col("v"), F.col("f"))
    lowered = layer3.halvings(F.col("f"), F.col("b"), F.col("p") > 3, F.lit(True))
    got = df.select("*", layer3.line_value(F.col("v"), F.col("g"), lowered).alias("line"), left.alias("l"), right.alias("r"), one.alias("one"), two.alias("two")).collect()
    assert len(got) == len(rows)
    for r in got:
        halvings = (1.0 if r.p > 3 else 0.5) * (r.f + layer3.EMPHASIS[r.b])
        assert r.line == pytest.approx(math.copysign(abs(r.v) ** (4 / 3), r.v) * 2 ** ((r.g - 210) / 4 - halvings), rel=1e-12)
        ratio = math.tan(r.p * math.pi / 12) if r.p < 6 else 0
        want = (r.v, 0) if r.p >= 6 else (r.v * ratio / (1 + ratio), r.v / (1 + ratio))
        assert (r.l, r.r) == pytest.approx(want, abs=1e-9) and (r.one, r.two) == pytest.approx(((r.v + r.f) / math.sqrt(2), (r.v - r.f) / math.sqrt(2)))


def test_order_of_short_blocks():
    assert layer3.by_frequency(np.arange(15), (2, 3)).tolist() == [0, 2, 4, 1, 3, 5, 6, 9, 12, 7, 10, 13, 8, 11, 14]
    with pytest.raises(ValueError):
        layer3.by_frequency(np.arange(16), (2, 3))


def test_aliases():
    x = np.random.default_rng(1).normal(size=layer3.LINES)
    want = x.copy()
    for band in range(1, 32):
        for i, c in enumerate(layer3.ALIASES):
            a, b = want[18 * band - 1 - i], want[18 * band + i]
            keep, cross = 1 / math.sqrt(1 + c * c), c / math.sqrt(1 + c * c)
            want[18 * band - 1 - i], want[18 * band + i] = a * keep - b * cross, b * keep + a * cross
    got = layer3.without_aliases(x)
    assert np.allclose(got, want) and np.isclose((got**2).sum(), (x**2).sum())
    assert (layer3.without_aliases(x, 1)[26:] == x[26:]).all()


def test_windows_give_back():
    """Squares of halves that overlap sum up to one: long into long, start into short, short into stop."""
    for before, after in ((layer3.LONG, layer3.LONG), (layer3.LONG, layer3.START), (layer3.STOP, layer3.LONG)):
        assert np.allclose(layer3.window(before)[18:] ** 2 + layer3.window(after)[:18] ** 2, 1)
    assert np.allclose(layer3.window(layer3.START)[:6] ** 2 + layer3.window(layer3.START)[17:11:-1] ** 2, 1)
    short = mdct.window("sine", 6)
    assert np.allclose(layer3.window(layer3.START)[24:30] ** 2 + short[:6] ** 2, 1) and np.allclose(layer3.window(layer3.STOP)[6:12] ** 2 + short[6:] ** 2, 1)
    assert (layer3.window(layer3.START)[18:24] == 1).all() and (layer3.window(layer3.START)[30:] == 0).all()


def literal(lines, n):
    return [sum(lines[k] * math.cos(math.pi / (2 * n) * (2 * i + 1 + n / 2) * (2 * k + 1)) for k in range(n // 2)) for i in range(n)]


def test_transforms():
    x = np.random.default_rng(2).normal(size=18)
    assert np.allclose(layer3.samples(x, layer3.LONG), np.array(literal(x, 36)) * np.sin(np.pi / 36 * (np.arange(36) + 0.5)))
    want = np.zeros(36)
    for turn in range(3):
        want[6 * turn + 6 : 6 * turn + 18] += np.array(literal(x[turn::3], 12)) * np.sin(np.pi / 12 * (np.arange(12) + 0.5))
    assert np.allclose(layer3.samples(x, layer3.SHORT), want)


def test_bands_give_back_a_signal():
    """Lines of a known signal, through all kinds of blocks, give that signal again."""
    rng = np.random.default_rng(3)
    kinds = [layer3.LONG, layer3.START, layer3.SHORT, layer3.STOP, layer3.LONG]
    signal = rng.normal(size=18 * 6)
    granules = np.zeros((5, 32, 18))
    for g, kind in enumerate(kinds):
        part = signal[18 * g : 18 * g + 36]
        if kind == layer3.SHORT:
            for turn in range(3):
                granules[g, 3, turn::3] = (part[6 * turn + 6 : 6 * turn + 18] * mdct.window("sine", 6)) @ mdct.basis(6).T / 3
        else:
            granules[g, 3] = (part * layer3.window(kind)) @ mdct.basis(18).T / 9
    out = layer3.bands(granules.reshape(5, 576), kinds)
    turned = out[1:, :, 3].copy()
    turned[:, 1::2] *= -1
    assert np.allclose(turned.ravel(), signal[18 : 18 * 5]) and (out[:, :, 4] == 0).all()
    assert layer3.bands(np.zeros((0, 576)), []).shape == (0, 18, 32)
