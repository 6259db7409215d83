"""URL filter: a bit-parallel automaton runs all glob rules at once over each canonical URL.

Every rule is a pair of globs, one over ``.host`` and one over the path. The canonical form is a sequence of symbols: the bytes of
``.host``, a separator that is no byte, the bytes of the path; so a host's glob never reaches into a path, whatever bytes
that has. ``*`` stands for any bytes, ``?`` for one byte. All globs are packed into 64-bit words, one bit for each symbol and one
for the start; a batch of URLs of about one length is a padded byte matrix, and the state of a URL is a row of words:
``D = ((D << 1) & B[byte]) | (D & loops)``, where loops marks the states that a ``*`` follows. A rule matches if its last
bit is set after the last byte. The cost of a byte is a few operations on the words, whatever the number of matches.

Null urls and urls without ``://`` have an empty host and an empty path; no host rule fits them. Urls of any length are
read to their end. Repeated rows give repeated verdicts, an empty table none. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediaframe.llm.common import LOWER, chunks, one_column, utf8
from mediaframe.session import map_arrow

#: The symbol between host and path.
SEPARATOR = 256
Glob = str | tuple[str, str]


@dataclass(frozen=True)
class Rule:
    """A host rule: fits the host and its subdomains where the path starts with the rule's path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> Glob:
        return (f"*.{self.host}", f"{self.path}*")


#: The fixed rules of the contract.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: Globs of ``.host`` and path that block a URL no rule decides; any other URL is allowed.
BLOCK_GLOBS = (("*casino*", "*"), ("*spam*", "*"), ("*phish*", "*"), ("*.xxx", "*"), ("*", "*/wp-login.???"))


STAR, ANY = 0x2A, 0x3F


def symbols_of(glob: Glob) -> list[int]:
    return list(glob.encode()) if isinstance(glob, str) else [*glob[0].encode(), SEPARATOR, *glob[1].encode()]


class Automaton:
    """All globs packed into words of 64 bits."""

    def __init__(self, globs: tuple[Glob, ...]):
        symbols: list[tuple[int, int]] = []  # (bit, symbol or -1 for any byte)
        loops, starts, finals, bit = [], [], [], 0
        for glob in globs:
            starts.append(bit)
            for c in symbols_of(glob):
                if c == STAR:
                    loops.append(bit)
                else:
                    bit += 1
                    symbols.append((bit, -1 if c == ANY else c))
            finals.append(bit)
            bit += 1
        self.words = (bit + 63) // 64
        self.finals = finals
        self.table = np.zeros((SEPARATOR + 1, self.words), np.uint64)
        for at, c in symbols:
            mask = np.uint64(1 << (at % 64))
            if c < 0:
                self.table[:SEPARATOR, at // 64] |= mask
            else:
                self.table[c, at // 64] |= mask
        self.start, self.loops = (self._mask(x) for x in (starts, loops))

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for at in bits:
            out[at // 64] |= np.uint64(1 << (at % 64))
        return out

    def run(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A boolean for each text and glob."""
        n, length = len(at) - 1, np.diff(at)
        out = np.zeros((n, len(self.finals)), bool)
        order = np.argsort(length, kind="stable")
        pos = 0
        while pos < n:
            # texts up to twice as long as the shortest of the bucket, in matrices of bounded size
            low = max(int(length[order[pos]]), 8)
            stop = int(np.searchsorted(length[order], 2 * low, "right"))
            width = int(length[order[stop - 1]])
            stop = min(stop, pos + max(1, (8 << 20) // max(width, 1)))
            rows = order[pos:stop]
            width = int(length[rows[-1]])
            state = np.tile(self.start, (len(rows), 1))
            size = length[rows]
            live = 0  # rows before this one have ended: they are sorted by length
            for k in range(width):
                live = int(np.searchsorted(size, k, "right"))
                now = state[live:]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[live:] = (moved & self.table[raw[at[rows[live:]] + k]]) | (now & self.loops)
            for g, bit in enumerate(self.finals):
                out[rows, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
            pos = stop
        return out


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host, with A-Z lower-cased, and path of a url; both empty without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(`url`, instr(`url`, '://') + 3)"), "#", 1)).otherwise(F.lit(""))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, globs: tuple[Glob, ...] = BLOCK_GLOBS) -> DataFrame:
    """Verdict for each url: (key, host, path, rule, verdict).

    The longest host rule that fits decides (the first listed among equals); without one, a matching glob blocks.
    """
    found = one_column(pages, key=key, url=url)
    host, path = split_url(F.col("url"))
    found = found.select("key", host.alias("host"), path.alias("path"))
    auto = tuple(r.glob for r in rules) + tuple(globs)
    by_length = sorted(range(len(rules)), key=lambda i: (len(rules[i].name), -i))  # later ones win
    names, verdicts = [r.name for r in rules], [r.verdict for r in rules]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(auto)
        for batch in chunks(batches, "path"):
            (hraw, hat), (praw, pat) = utf8(batch.column("host")), utf8(batch.column("path"))
            raw, at = join_parts(hraw, hat, praw, pat)
            hit = automaton.run(raw, at)
            rule = np.full(batch.num_rows, -1)
            for i in by_length:
                rule[hit[:, i]] = i
            blocked = hit[:, len(names) :].any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("host"), batch.column("path"), pa.array([names[i] if i >= 0 else None for i in rule], pa.string()), pa.array([verdicts[i] if i >= 0 else ("block" if b else "allow") for i, b in zip(rule, blocked)], pa.string())],
                ["key", "host", "path", "rule", "verdict"],
            )

    kind = dict(found.dtypes)["key"]
    return map_arrow(found, judge, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


def join_parts(hraw: np.ndarray, hat: np.ndarray, praw: np.ndarray, pat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """'.', host, separator, path of every row as one buffer of symbols with offsets."""
    hlen, plen = np.diff(hat), np.diff(pat)
    at = np.zeros(len(hlen) + 1, np.int64)
    np.cumsum(hlen + plen + 2, out=at[1:])
    raw = np.empty(at[-1], np.uint16)
    raw[at[:-1]] = 0x2E
    raw[np.arange(len(hraw)) + np.repeat(at[:-1] + 1 - hat[:-1], hlen)] = LOWER[hraw]
    raw[at[:-1] + 1 + hlen] = SEPARATOR
    raw[np.arange(len(praw)) + np.repeat(at[:-1] + 2 + hlen - pat[:-1], plen)] = praw
    return raw, at


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM parts),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM cut)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN host LIKE '%casino%' OR host LIKE '%spam%' OR host LIKE '%phish%' OR ('.' || host) LIKE '%.xxx' OR path LIKE '%/wp-login.___' THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
