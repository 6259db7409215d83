"""H.264's context-adaptive variable-length codes: levels of blocks of coefficients, out of bits."""

from __future__ import annotations

from functools import lru_cache

from mediaframe.errors import MediaError

# Fixed values of the standard's code tables follow: lengths and bits of each code.
# Tokens: by number of levels (0 to 16), and in each by trailing ones (0 to 3); a length of 0 stands where no code is.

TOKEN_LENGTHS = (
    (
        1, 0, 0, 0, 6, 2, 0, 0, 8, 6, 3, 0, 9, 8, 7, 5, 10, 9, 8, 6, 11, 10, 9, 7, 13, 11, 10, 8, 13, 13, 11, 9, 13, 13, 13, 10,
        14, 14, 13, 11, 14, 14, 14, 13, 15, 15, 14, 14, 15, 15, 15, 14, 16, 15, 15, 15, 16, 16, 16, 15, 16, 16, 16, 16, 16, 16, 16, 16,
    ),
    (
        2, 0, 0, 0, 6, 2, 0, 0, 6, 5, 3, 0, 7, 6, 6, 4, 8, 6, 6, 4, 8, 7, 7, 5, 9, 8, 8, 6, 11, 9, 9, 6, 11, 11, 11, 7,
        12, 11, 11, 9, 12, 12, 12, 11, 12, 12, 12, 11, 13, 13, 13, 12, 13, 13, 13, 13, 13, 14, 13, 13, 14, 14, 14, 13, 14, 14, 14, 14,
    ),
    (
        4, 0, 0, 0, 6, 4, 0, 0, 6, 5, 4, 0, 6, 5, 5, 4, 7, 5, 5, 4, 7, 5, 5, 4, 7, 6, 6, 4, 7, 6, 6, 4, 8, 7, 7, 5,
        8, 8, 7, 6, 9, 8, 8, 7, 9, 9, 8, 8, 9, 9, 9, 8, 10, 9, 9, 9, 10, 10, 10, 10, 10, 10, 10, 10, 10, 10, 10, 10,
    ),
)
TOKEN_BITS = (
    (
        1, 0, 0, 0, 5, 1, 0, 0, 7, 4, 1, 0, 7, 6, 5, 3, 7, 6, 5, 3, 7, 6, 5, 4, 15, 6, 5, 4, 11, 14, 5, 4, 8, 10, 13, 4,
        15, 14, 9, 4, 11, 10, 13, 12, 15, 14, 9, 12, 11, 10, 13, 8, 15, 1, 9, 12, 11, 14, 13, 8, 7, 10, 9, 12, 4, 6, 5, 8,
    ),
    (
        3, 0, 0, 0, 11, 2, 0, 0, 7, 7, 3, 0, 7, 10, 9, 5, 7, 6, 5, 4, 4, 6, 5, 6, 7, 6, 5, 8, 15, 6, 5, 4, 11, 14, 13, 4,
        15, 10, 9, 4, 11, 14, 13, 12, 8, 10, 9, 8, 15, 14, 13, 12, 11, 10, 9, 12, 7, 11, 6, 8, 9, 8, 10, 1, 7, 6, 5, 4,
    ),
    (
        15, 0, 0, 0, 15, 14, 0, 0, 11, 15, 13, 0, 8, 12, 14, 12, 15, 10, 11, 11, 11, 8, 9, 10, 9, 14, 13, 9, 8, 10, 9, 8, 15, 14, 13, 13,
        11, 14, 10, 12, 15, 10, 13, 12, 11, 14, 9, 12, 8, 10, 13, 8, 13, 7, 9, 12, 9, 12, 11, 10, 5, 8, 7, 6, 1, 4, 3, 2,
    ),
)
#: Tokens of the four constant levels of chroma, by number of levels (0 to 4) and trailing ones.
CHROMA_TOKEN_LENGTHS = (2, 0, 0, 0, 6, 1, 0, 0, 6, 6, 3, 0, 6, 7, 7, 6, 6, 8, 8, 7)
CHROMA_TOKEN_BITS = (1, 0, 0, 0, 7, 1, 0, 0, 4, 6, 1, 0, 3, 3, 2, 5, 2, 3, 2, 0)
#: Zeros before the last level, by number of levels (from 1).
ZERO_LENGTHS = (
    (1, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 9), (3, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 6, 6, 6, 6), (4, 3, 3, 3, 4, 4, 3, 3, 4, 5, 5, 6, 5, 6),
    (5, 3, 4, 4, 3, 3, 3, 4, 3, 4, 5, 5, 5), (4, 4, 4, 3, 3, 3, 3, 3, 4, 5, 4, 5), (6, 5, 3, 3, 3, 3, 3, 3, 4, 3, 6), (6, 5, 3, 3, 3, 2, 3, 4, 3, 6),
    (6, 4, 5, 3, 2, 2, 3, 3, 6), (6, 6, 4, 2, 2, 3, 2, 5), (5, 5, 3, 2, 2, 2, 4), (4, 4, 3, 3, 1, 3), (4, 4, 2, 1, 3), (3, 3, 1, 2), (2, 2, 1), (1, 1),
)
ZERO_BITS = (
    (1, 3, 2, 3, 2, 3, 2, 3, 2, 3, 2, 3, 2, 3, 2, 1), (7, 6, 5, 4, 3, 5, 4, 3, 2, 3, 2, 3, 2, 1, 0), (5, 7, 6, 5, 4, 3, 4, 3, 2, 3, 2, 1, 1, 0),
    (3, 7, 5, 4, 6, 5, 4, 3, 3, 2, 2, 1, 0), (5, 4, 3, 7, 6, 5, 4, 3, 2, 1, 1, 0), (1, 1, 7, 6, 5, 4, 3, 2, 1, 1, 0), (1, 1, 5, 4, 3, 3, 2, 1, 1, 0),
    (1, 1, 1, 3, 3, 2, 2, 1, 0), (1, 0, 1, 3, 2, 1, 1, 1), (1, 0, 1, 3, 2, 1, 1), (0, 1, 1, 2, 1, 3), (0, 1, 1, 1, 1), (0, 1, 1, 1), (0, 1, 1), (0, 1),
)
CHROMA_ZERO_LENGTHS = ((1, 2, 3, 3), (1, 2, 2), (1, 1))
CHROMA_ZERO_BITS = ((1, 1, 1, 0), (1, 1, 0), (1, 0))
#: Zeros before a level, by zeros left (from 1; 7 stands for more).
RUN_LENGTHS = ((1, 1), (1, 2, 2), (2, 2, 2, 2), (2, 2, 2, 3, 3), (2, 2, 3, 3, 3, 3), (2, 3, 3, 3, 3, 3, 3), (3, 3, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11))
RUN_BITS = ((1, 0), (1, 1, 0), (3, 2, 1, 0), (3, 2, 1, 1, 0), (3, 2, 3, 2, 1, 0), (3, 0, 1, 3, 2, 5, 4), (7, 6, 5, 4, 3, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1))

Codes = tuple[tuple[int, int, int], ...]


def codes(lengths: tuple[int, ...], bits: tuple[int, ...]) -> Codes:
    """(symbol, length, bits) of each code."""
    return tuple((i, n, b) for i, (n, b) in enumerate(zip(lengths, bits, strict=True)) if n)


def token_codes(context: int) -> Codes:
    """Symbols are 4 * levels + trailing ones; context is the expected number of levels, or -1 for constant levels of chroma."""
    if context < 0:
        return codes(CHROMA_TOKEN_LENGTHS, CHROMA_TOKEN_BITS)
    if context >= 8:  # six bits each: levels less one and trailing ones, and what is left for none
        return ((0, 6, 3), *((4 * n + t, 6, 4 * (n - 1) + t) for n in range(1, 17) for t in range(min(n, 3) + 1)))
    table = 0 if context < 2 else 1 if context < 4 else 2
    return codes(TOKEN_LENGTHS[table], TOKEN_BITS[table])


def zero_codes(levels: int, chroma: bool) -> Codes:
    lengths, bits = (CHROMA_ZERO_LENGTHS, CHROMA_ZERO_BITS) if chroma else (ZERO_LENGTHS, ZERO_BITS)
    return codes(lengths[levels - 1], bits[levels - 1])


def run_codes(left: int) -> Codes:
    return codes(RUN_LENGTHS[min(left, 7) - 1], RUN_BITS[min(left, 7) - 1])


def _lookup(table: Codes) -> tuple[int, list[tuple[int, int]]]:
    """Longest length, and (symbol, length) by the next so many bits."""
    longest = max(n for _, n, _ in table)
    found = [(-1, 0)] * (1 << longest)
    for symbol, n, bits in table:
        rest = longest - n
        found[bits << rest : (bits + 1) << rest] = [(symbol, n)] * (1 << rest)
    return longest, found


@lru_cache(maxsize=None)
def _tokens(context: int):
    return _lookup(token_codes(context))


@lru_cache(maxsize=None)
def _zeros(levels: int, chroma: bool):
    return _lookup(zero_codes(levels, chroma))


@lru_cache(maxsize=None)
def _runs(left: int):
    return _lookup(run_codes(left))


def _symbol(b, lookup: tuple[int, list[tuple[int, int]]]) -> int:
    longest, found = lookup
    symbol, n = found[b.peek(longest)]
    if not n:
        raise MediaError("no code of the table fits")
    b.read(n)
    return symbol


def _level(b, size: int) -> tuple[int, int]:
    """(code of a level, prefix) after a prefix of zeros, with so many bits behind it."""
    prefix = 0
    while not b.read(1):
        prefix += 1
        if prefix > 25:
            raise MediaError("invalid level")
    bits = prefix - 3 if prefix >= 15 else 4 if prefix == 14 and size == 0 else size
    code = (min(prefix, 15) << size) + (b.read(bits) if bits else 0)
    if prefix >= 15 and size == 0:
        code += 15
    if prefix >= 16:
        code += (1 << prefix - 3) - 4096
    return code, prefix


def block(b, context: int, most: int) -> tuple[int, list[int]]:
    """(number of levels, `most` levels in the order of coding) of one block."""
    out = [0] * most
    chroma = context < 0
    n, ones = divmod(_symbol(b, _tokens(-1 if chroma else 0 if context < 2 else 2 if context < 4 else 4 if context < 8 else 8)), 4)
    if n > most:
        raise MediaError("more levels than the block has places")
    if not n:
        return 0, out
    levels, size = [], 1 if n > 10 and ones < 3 else 0
    for i in range(n):
        if i < ones:
            levels.append(1 - 2 * b.read(1))
            continue
        code, _ = _level(b, size)
        if i == ones and ones < 3:
            code += 2
        level = (code + 2) >> 1 if code % 2 == 0 else (-code - 1) >> 1
        levels.append(level)
        size = size or 1
        if abs(level) > 3 << size - 1 and size < 6:
            size += 1
    left = _symbol(b, _zeros(n, chroma)) if n < most else 0
    at = n - 1 + left
    if at >= most:
        raise MediaError("more zeros than the block has places")
    for i, level in enumerate(levels):
        out[at] = level
        run = left if i == n - 1 else _symbol(b, _runs(min(left, 7))) if left else 0
        if run > left:
            raise MediaError("more zeros than are left")
        left -= run
        at -= run + 1
    return n, out
