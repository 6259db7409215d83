"""Makes small H.264 streams for tests: bits are chosen by the caller, and codes are taken from the standard's tables."""

from __future__ import annotations

import numpy as np

from mediaframe.functions import avc, cavlc
from mediaframe.sources.nal import Writer, units


def sequence(across, down, crop=None, references=1, order_type=2):
    w = Writer()
    w.write(8, 66), w.write(8, 0), w.write(8, 30), w.ue(0), w.ue(0), w.ue(order_type)
    if order_type == 0:
        w.ue(2)
    w.ue(references), w.write(1, 0), w.ue(across - 1), w.ue(down - 1), w.write(1, 1), w.write(1, 1)
    w.write(1, 1 if crop else 0)
    for v in crop or ():
        w.ue(v)
    w.write(1, 0)
    return w.unit(7)


def picture(qp=26, control=1, constrained=0, references=1, weighted=0):
    w = Writer()
    w.ue(0), w.ue(0), w.write(1, 0), w.write(1, 0), w.ue(0), w.ue(references - 1), w.ue(0), w.write(1, weighted), w.write(2, 0)
    w.se(qp - 26), w.se(0), w.se(0), w.write(1, control), w.write(1, constrained), w.write(1, 0)
    return w.unit(8)


def slice_start(kind, frame, idr, first=0, smoothing=1, qp_change=0, order=None, active=None, weights=None):
    w = Writer()
    w.ue(first), w.ue(5 + {"P": 0, "I": 2}[kind]), w.ue(0), w.write(4, frame)
    if idr:
        w.ue(0)
    if order is not None:
        w.write(6, order)
    if kind == "P":
        w.write(1, active is not None)
        if active is not None:
            w.ue(active - 1)
        w.write(1, 0)
        if weights:  # denominators, and (weight, offset) of luma and both of chroma
            w.ue(weights[0]), w.ue(weights[1])
            w.write(1, 1), w.se(weights[2][0]), w.se(weights[2][1]), w.write(1, 1)
            for pair in weights[3:]:
                w.se(pair[0]), w.se(pair[1])
    w.write(2 if idr else 1, 0)
    w.se(qp_change), w.ue(smoothing)
    if smoothing != 1:
        w.se(0), w.se(0)
    return w


def plain(w, y, u, v, kind="I"):
    """A macroblock of bytes."""
    w.ue(25 + 5 * (kind == "P"))
    w.align()
    for a in (y, u, v):
        for byte in np.asarray(a).ravel():
            w.write(8, int(byte))


def block(w, levels, context):
    """Writes levels as the standard codes them."""
    code = {s: (n, b) for s, n, b in cavlc.token_codes(context)}
    at = [i for i, v in enumerate(levels) if v]
    values = [levels[i] for i in reversed(at)]
    ones = 0
    while ones < min(3, len(values)) and abs(values[ones]) == 1:
        ones += 1
    w.write(*code[4 * len(values) + ones])
    if not values:
        return
    size = 1 if len(values) > 10 and ones < 3 else 0
    for i, v in enumerate(values):
        if i < ones:
            w.write(1, v < 0)
            continue
        number = 2 * v - 2 if v > 0 else -2 * v - 1
        number -= 2 if i == ones and ones < 3 else 0
        level(w, number, size)
        size = size or 1
        if abs(v) > 3 << size - 1 and size < 6:
            size += 1
    left = at[-1] + 1 - len(at)
    if len(at) < len(levels):
        w.write(*{s: (n, b) for s, n, b in cavlc.zero_codes(len(at), context < 0)}[left])
    for k in range(len(at) - 1, 0, -1):
        if left:
            run = at[k] - at[k - 1] - 1
            w.write(*{s: (n, b) for s, n, b in cavlc.run_codes(left)}[run])
            left -= run


def level(w, number, size):
    if size == 0 and number < 14:
        w.write(number + 1, 1)
    elif size == 0 and number < 30:
        w.write(15, 1), w.write(4, number - 14)
    elif size and number < 15 << size:
        w.write((number >> size) + 1, 1), w.write(size, number & ((1 << size) - 1))
    else:
        number -= (15 << size) + (15 if size == 0 else 0)
        prefix = 15
        while number - ((1 << prefix - 3) - 4096 if prefix > 15 else 0) >= 1 << prefix - 3:
            prefix += 1
        number -= (1 << prefix - 3) - 4096 if prefix > 15 else 0
        w.write(prefix + 1, 1), w.write(prefix - 3, number)


def frames(data):
    return list(avc.Decoder().decode((t, i, p) for _, t, i, p in units(data)))
