"""Channel layouts: named channels as bits of a mask, standard layouts, and the default mixing matrix between two layouts."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

# Channel names by bit number.
CHANNELS = {
    0: "FL", 1: "FR", 2: "FC", 3: "LFE", 4: "BL", 5: "BR", 6: "FLC", 7: "FRC", 8: "BC", 9: "SL", 10: "SR", 11: "TC", 12: "TFL",
    13: "TFC", 14: "TFR", 15: "TBL", 16: "TBC", 17: "TBR", 29: "DL", 30: "DR", 31: "WL", 32: "WR", 33: "SDL", 34: "SDR",
    35: "LFE2", 36: "TSL", 37: "TSR", 38: "BFC", 39: "BFL", 40: "BFR", 41: "SSL", 42: "SSR", 43: "TTL", 44: "TTR", 61: "BIL", 62: "BIR",
}
BIT = {name: bit for bit, name in CHANNELS.items()}
# Standard layouts, in the order in which they are looked up.
STANDARD = {
    "mono": "FC",
    "stereo": "FL+FR",
    "2.1": "FL+FR+LFE",
    "3.0": "FL+FR+FC",
    "3.0(back)": "FL+FR+BC",
    "4.0": "FL+FR+FC+BC",
    "quad": "FL+FR+BL+BR",
    "quad(side)": "FL+FR+SL+SR",
    "3.1": "FL+FR+FC+LFE",
    "5.0": "FL+FR+FC+BL+BR",
    "5.0(side)": "FL+FR+FC+SL+SR",
    "4.1": "FL+FR+FC+LFE+BC",
    "5.1": "FL+FR+FC+LFE+BL+BR",
    "5.1(side)": "FL+FR+FC+LFE+SL+SR",
    "6.0": "FL+FR+FC+BC+SL+SR",
    "6.0(front)": "FL+FR+FLC+FRC+SL+SR",
    "3.1.2": "FL+FR+FC+LFE+TFL+TFR",
    "hexagonal": "FL+FR+FC+BL+BR+BC",
    "6.1": "FL+FR+FC+LFE+BC+SL+SR",
    "6.1(back)": "FL+FR+FC+LFE+BL+BR+BC",
    "6.1(front)": "FL+FR+LFE+FLC+FRC+SL+SR",
    "7.0": "FL+FR+FC+BL+BR+SL+SR",
    "7.0(front)": "FL+FR+FC+FLC+FRC+SL+SR",
    "7.1": "FL+FR+FC+LFE+BL+BR+SL+SR",
    "7.1(wide)": "FL+FR+FC+LFE+BL+BR+FLC+FRC",
    "7.1(wide-side)": "FL+FR+FC+LFE+FLC+FRC+SL+SR",
    "5.1.2": "FL+FR+FC+LFE+SL+SR+TFL+TFR",
    "5.1.2(back)": "FL+FR+FC+LFE+BL+BR+TFL+TFR",
    "octagonal": "FL+FR+FC+BL+BR+BC+SL+SR",
    "cube": "FL+FR+BL+BR+TFL+TFR+TBL+TBR",
    "5.1.4": "FL+FR+FC+LFE+SL+SR+TFL+TFR+TBL+TBR",
    "7.1.2": "FL+FR+FC+LFE+BL+BR+SL+SR+TFL+TFR",
    "7.1.4": "FL+FR+FC+LFE+BL+BR+SL+SR+TFL+TFR+TBL+TBR",
    "7.2.3": "FL+FR+FC+LFE+BL+BR+SL+SR+TFL+TFR+TBC+LFE2",
    "9.1.4": "FL+FR+FC+LFE+BL+BR+SL+SR+TFL+TFR+TBL+TBR+FLC+FRC",
    "9.1.6": "FL+FR+FC+LFE+BL+BR+SL+SR+TFL+TFR+TBL+TBR+FLC+FRC+TSL+TSR",
    "hexadecagonal": "FL+FR+FC+BL+BR+BC+SL+SR+WL+WR+TBL+TBR+TBC+TFC+TFL+TFR",
    "binaural": "BIL+BIR",
    "downmix": "DL+DR",
    "22.2": "FL+FR+FC+LFE+BL+BR+SL+SR+TFL+TFR+TBL+TBR+FLC+FRC+TSL+TSR+BC+LFE2+TFC+TC+TBC+BFC+BFL+BFR",
}


@dataclass(frozen=True)
class Layout:
    """order 'native' has a mask; 'unspecified' has only a count."""

    order: str
    count: int
    mask: int = 0

    @staticmethod
    def of_mask(mask: int) -> Layout:
        return Layout("native", mask.bit_count(), mask)

    @staticmethod
    def default(count: int) -> Layout:
        for names in STANDARD.values():
            if names.count("+") + 1 == count:
                return Layout.of_mask(mask_of(names))
        return Layout("unspecified", count)

    @staticmethod
    def parse(text: str) -> Layout:
        """A standard name, channel names joined by '+', a mask in hex, octal or decimal, '6c' or '6 channels'."""
        if text in STANDARD:
            return Layout.of_mask(mask_of(STANDARD[text]))
        if all(p in BIT for p in text.split("+")):
            return Layout.of_mask(mask_of(text))
        if re.fullmatch(r"0[xX][0-9a-fA-F]+|[0-9]+", text):
            mask = int(text, 16) if text[:2].lower() == "0x" else int(text, 8) if text[0] == "0" and len(text) > 1 else int(text)
            if mask:
                return Layout.of_mask(mask)
        if m := re.fullmatch(r"(\d+)\s*c", text):
            return Layout.default(int(m[1]))
        if m := re.fullmatch(r"(\d+) channels", text):
            return Layout("unspecified", int(m[1]))
        raise ValueError(f"unknown channel layout {text!r}")

    def channels(self) -> list[str]:
        return [CHANNELS.get(b, f"USR{b}") for b in range(64) if self.mask >> b & 1]

    def index(self, name: str) -> int:
        bit = BIT[name]
        return (self.mask & ((1 << bit) - 1)).bit_count() if self.mask >> bit & 1 else -1

    def describe(self) -> str:
        if self.order != "native":
            return f"{self.count} channels"
        for name, parts in STANDARD.items():
            if mask_of(parts) == self.mask:
                return name
        return f"{self.count} channels ({'+'.join(self.channels())})"


def mask_of(names: str) -> int:
    return sum(1 << BIT[n] for n in set(names.split("+")))


HALF = math.sqrt(0.5)
THIRD, TWO_THIRDS, BIG = math.sqrt(1 / 3), math.sqrt(2 / 3), math.sqrt(3) / 2

# Where a channel that the output lacks goes: for each channel (with its right twin, if it has one), the first rule whose
# output channels are all there. A rule: needed outputs, {(output, input): gain}. Gains may name a level: c (center),
# s (surround), l (low frequency), times a factor. 'L>' and 'R>' stand for the pair and its twin.
PAIRS = {"BL": "BR", "SL": "SR", "FLC": "FRC", "TFL": "TFR", "TBL": "TBR", "TSL": "TSR", "BFL": "BFR", "FL": "FR"}


@dataclass(frozen=True)
class Levels:
    center: float = HALF
    surround: float = HALF
    lfe: float = 0.0
    encoding: str = "none"


def matrix(source: Layout, target: Layout, levels: Levels = Levels(), most: float = 1.0) -> list[list[float]]:
    """Rows by output channel, columns by input channel; rows are scaled so that the largest sum of magnitudes is `most`, if above."""
    have, want = set(source.channels()), set(target.channels())
    if not {"FL", "FR"} <= want and "FC" not in want:
        raise ValueError(f"output layout {target.describe()} has no front channels")
    c, s, l = levels.center, levels.surround, levels.lfe  # noqa: E741
    m: dict[tuple[str, str], float] = {(x, x): 1.0 for x in have & want}
    gone = have - want

    def add(gains: dict[tuple[str, str], float]) -> None:
        for k, v in gains.items():
            m[k] = m.get(k, 0.0) + v

    def pair(left: str, to: str, gain: float) -> dict:
        """A pair into a pair of outputs, side by side."""
        return {(to, left): gain, (PAIRS[to], PAIRS[left]): gain}

    def into(name: str, to: str, gain: float) -> dict:
        """A channel, or a pair, into one output; or a channel into a pair of outputs."""
        if name in PAIRS:
            return {(to, name): gain, (to, PAIRS[name]): gain}
        return {(to, name): gain, (PAIRS[to], name): gain} if to in PAIRS else {(to, name): gain}

    def matrixed(left: str) -> dict:
        """A surround pair into the front pair, with the phases of a matrix encoding."""
        r = PAIRS[left]
        if levels.encoding == "dolby":
            return {("FL", left): -s * HALF, ("FL", r): -s * HALF, ("FR", left): s * HALF, ("FR", r): s * HALF}
        if levels.encoding == "dplii":
            return {("FL", left): -s * BIG, ("FL", r): -s * HALF, ("FR", left): s * HALF, ("FR", r): s * BIG}
        return pair(left, "FL", s)

    def first(*rules: tuple[str, dict]) -> None:
        for needs, gains in rules:
            if set(needs.split("+")) <= want:
                add(gains)
                return
        raise ValueError(f"no place for a channel in {target.describe()}")

    def keep_center(name: str) -> None:
        if name in have:
            m[(name, name)] = c * math.sqrt(2)

    if "FC" in gone:
        first(("FL+FR", into("FC", "FL", c if have & {"FL", "FR"} else HALF)))
    if gone & {"FL", "FR"}:
        first(("FC", into("FL", "FC", HALF)))
        keep_center("FC")
    if "BC" in gone:
        surround = s * HALF
        if levels.encoding in ("dolby", "dplii"):
            g = s * HALF if gone & {"BL", "SL"} else s
            front = {("FL", "BC"): -g, ("FR", "BC"): g}
        else:
            front = into("BC", "FL", surround)
        first(("BL", into("BC", "BL", HALF)), ("SL", into("BC", "SL", HALF)), ("FL", front), ("FC", into("BC", "FC", surround)))
    if "BL" in gone:
        first(("BC", into("BL", "BC", HALF)), ("SL", pair("BL", "SL", HALF if "SL" in have else 1.0)), ("FL", matrixed("BL")), ("FC", into("BL", "FC", s * HALF)))
    if "SL" in gone:
        first(("BL", pair("SL", "BL", HALF if "BL" in have else 1.0)), ("BC", into("SL", "BC", HALF)), ("FL", matrixed("SL")), ("FC", into("SL", "FC", s * HALF)))
    if "FLC" in gone:
        first(("FL", pair("FLC", "FL", 1.0)), ("FC", into("FLC", "FC", HALF)))
    if "TFL" in gone:
        if "TFC" in want:
            add(into("TFL", "TFC", HALF))
            keep_center("TFC")
        else:
            first(("FL", pair("TFL", "FL", 1.0)), ("FC", into("TFL", "FC", HALF)))
    if "TFC" in gone:
        first(("TFL", into("TFC", "TFL", HALF)), ("FC", into("TFC", "FC", 1.0)), ("FL", into("TFC", "FL", c)))
    if "TBL" in gone:
        first(("TBC", into("TBL", "TBC", HALF)), ("TFL", pair("TBL", "TFL", HALF)), ("BL", pair("TBL", "BL", 1.0)), ("SL", pair("TBL", "SL", 1.0)), ("FL", pair("TBL", "FL", s)), ("FC", into("TBL", "FC", s * HALF)))
    if "TBC" in gone:
        first(("TBL", into("TBC", "TBL", HALF)), ("BL", into("TBC", "BL", HALF)), ("SL", into("TBC", "SL", HALF)), ("FL", into("TBC", "FL", 0.5)), ("FC", into("TBC", "FC", 0.5)))
    if "TSL" in gone:
        back = pair("TSL", "BL", HALF) if "BL" in want else {}
        first(
            ("TFL+TBC", pair("TSL", "TFL", TWO_THIRDS) | into("TSL", "TBC", THIRD)),
            ("TFL+TBL", pair("TSL", "TFL", HALF) | pair("TSL", "TBL", HALF)),
            ("TFL+BL", pair("TSL", "TFL", HALF) | pair("TSL", "BL", HALF)),
            ("TFL+SL", pair("TSL", "TFL", HALF) | pair("TSL", "SL", HALF)),
            ("SL", pair("TSL", "SL", 1.0)),
            ("FL", pair("TSL", "FL", s) | back),
            ("FC", into("TSL", "FC", s * HALF)),
        )
    if "TC" in gone:
        rear = into("TC", "BL", 0.5) if "BL" in want else into("TC", "SL", 0.5) if "SL" in want else {}
        first(
            ("TFL+TBL", into("TC", "TFL", 0.5) | into("TC", "TBL", 0.5)),
            ("TFL+TBC", into("TC", "TFL", THIRD) | into("TC", "TBC", THIRD)),
            *([("TFL", into("TC", "TFL", 0.5) | rear)] if rear else []),
            ("FL", into("TC", "FL", 0.5) | rear),
            ("FC", into("TC", "FC", 0.5)),
        )
    if "BFC" in gone:
        first(("FC", into("BFC", "FC", 1.0)), ("FL", into("BFC", "FL", c)))
    if "BFL" in gone:
        if "BFC" in want:
            add(into("BFL", "BFC", HALF))
            keep_center("BFC")
        else:
            first(("FL", pair("BFL", "FL", 1.0)), ("FC", into("BFL", "FC", HALF)))
    if "LFE" in gone:
        first(("FC", into("LFE", "FC", l)), ("FL", into("LFE", "FL", l * HALF)))
    if "LFE2" in gone:
        first(("LFE", into("LFE2", "LFE", HALF)), ("FC", into("LFE2", "FC", l)), ("FL", into("LFE2", "FL", l * HALF)))
    rows = [[m.get((o, i), 0.0) for i in source.channels()] for o in target.channels()]
    largest = max(sum(map(abs, r)) for r in rows)
    return [[v / (largest / most) for v in r] for r in rows] if largest > most else rows


def quantized(rows: list[list[float]], bits: int = 15) -> list[list[int]]:
    """Integer coefficients, the rounding error of each passed on along the row (accumulated as the target carries it)."""
    out = []
    for r in rows:
        rest, done = 0.0, []
        for v in r:
            aim = v * (1 << bits) + rest
            q = round(aim)
            rest += aim - q
            done.append(q)
        out.append(done)
    return out
