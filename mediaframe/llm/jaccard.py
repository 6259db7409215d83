r"""N-gram Jaccard join with set-relation skipping: exact components of documents whose shingle sets are similar.

Words are runs of ``[^\x20\x09-\x0D]`` after A-Z are lower-cased; a document's set is that of its distinct shingles of
``size`` words (with fewer words, the whole sequence as one; without words, empty). Sets link when
``den * intersection >= num * union``. Shingles are 64-bit hashes. The stages:

1. Sets: a pass over the texts gives each document the size and two hashes of its set. Equal sets are one set from here on,
   named by the first hash (two sets of one name would be noticed and reported, not merged). The same pass counts shingles.
2. Inverted lists: only a set's prefix is indexed, its first ``n - ceil(t n) + 1`` shingles in an order that puts frequent
   ones last. The broadcast list of frequent shingles has at most ``FREQUENT`` entries, since their counts sum up to no more
   than the sizes of all sets; it only orders, so it never changes a result. Lists of one set are dropped.
3. Block skipping by position: a list is sorted by the sets' size n and the shingle's position in the set, so that sets of one
   size are a block. For a set, the blocks of sizes that cannot link are skipped by a search, and of each other block the
   tail from the first position that leaves too few shingles for the overlap: ``skipping`` makes the pairs that are left,
   and touches no other. Of those, pairs whose parity sketches differ in more bits than the sets may differ in elements go
   (a sketch's bit is the parity of the shingles that fall on it: the difference of two sketches is a lower bound).
4. Set relations: a list first looks for a set in the middle of highly similar ones (the nearest to the majority of the
   sketches' bits); all sets that the bounds leave beside it are one group with it, and are not compared with each other. A
   list emits a spanning forest, and how many sets each such middle has. The connected components of the forests are
   groups of highly similar sets; all links lie within groups.
5. Answers from answers: in a group, the answers of a central set, the pivot, are computed, with its difference from each set.
   Sets that link to it are one component, and links between them are not looked at. For two sets of different components the
   differences from the pivots bound their own from both sides: |d(p, x) - d(p, y)| <= d(x, y) <= d(p, x) + d(p, y); pairs
   that this leaves open are decided by the shingles in which the open sets differ. A group emits a spanning forest.

A group of more than ``GROUP_BLOCK`` sets or ``GROUP_TOKENS`` shingles is never in one task: its sets are dealt over tasks that
each compare theirs with the group's pivots (the middles of most sets); only sets outside the largest component that comes of
that, usually few, are compared with the group's others, in blocks. Lists of more than ``LIST_BLOCK`` sets are dealt as pairs
of blocks.

Null and empty texts: n_shingles 0, their own component. Null ids are kept, without links. Repeated rows have equal sets and
the same component. Texts of any length are taken whole. Rows of one id with other texts are sets of their own that share the
id. An empty table gives no rows. Extra columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediaframe.llm.common import LOWER, blocks, chunks, components, discard, grouped, materialize, maybe_broadcast, mix, one_column, pack_groups, utf8, word_hashes, words_of
from mediaframe.session import map_arrow

SIZE, NUM, DEN = 3, 90, 100
FREQUENT = 1_000_000
#: Shingles among which a task counts those that occur twice or more.
COUNTED = 2_000_000
#: Rows of a list, sets of a group, and shingles of a group's sets, that a task takes as one block.
LIST_BLOCK, GROUP_BLOCK, GROUP_TOKENS = 4096, 512, 2_000_000
#: Rows from which a list looks for middles; middles of a list, pivots in a block of a group, and of a large group.
CROWD, MIDDLES, PIVOTS, STARS = 8, 6, 16, 4
#: log2 of a sketch's bits, at least and at most.
LEAST_BITS, MOST_BITS = 6, 16


def shingle_sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, at = utf8(batch.column("text"))
    raw = LOWER[raw]
    start, end, first = words_of(raw, at)
    words = word_hashes(raw, start, end)
    n = len(words)
    out = []
    if n >= size:
        rolled = words[: n - size + 1].copy()
        for j in range(1, size):
            rolled = mix(rolled) + words[j : n - size + 1 + j]
        rolled = mix(rolled + np.uint64(size))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            h = words[a : a + 1].copy()
            for j in range(a + 1, b):
                h = mix(h) + words[j]
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(x: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        a = mix(np.array([mix(x + np.uint64(0x51)).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64))
        b = mix(np.array([mix(x ^ np.uint64(0xA5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def needed(nx, ny, num: int, den: int):
    """The least overlap of linked sets: den * o >= num * (nx + ny - o)."""
    return -((-num * (nx + ny)) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -((-num * n) // den) + 1


def bits(n: int, num: int, den: int) -> int:
    """log2 of the bits of a set's sketch: about a bit for each shingle, or for two where linked sets differ in few."""
    return min(MOST_BITS, max(LEAST_BITS, int(n - 1).bit_length() - (8 * num >= 7 * den)))


def sketch(x: np.ndarray, num: int, den: int) -> bytes:
    b = bits(len(x), num, den)
    at = (mix(x + np.uint64(0x77)) & np.uint64((1 << b) - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << b) & 1).astype(np.uint8)).tobytes()


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest (node, smallest node of its tree) that connects what the edges connect."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, old[i], low)
        np.minimum.at(label, old[j], low)
        label = label[label]
        if (label == old).all() and (label[i] == label[j]).all():
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


SETS = "row int, key long, n long, name long, check long, sketch binary"


def describe(documents: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Rows 0: a document's set (key, n, name, check, sketch). Rows 1: a shingle (name) and its count (n) in some of the texts."""

    def rows(kind: int, key, n, name, check, sketches) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(name), kind, np.int32)), key, pa.array(n), pa.array(name), pa.array(check), pa.array(sketches, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["row", "key", "n", "name", "check", "sketch"])

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        token, count = token[count > 1].view(np.int64), count[count > 1]
        zero = np.zeros(len(token), np.int64)
        return rows(1, pa.array(zero), count, token, zero, [None] * len(token))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in chunks(batches, "text"):
            sets = shingle_sets(batch, size)
            names = [set_name(x) for x in sets]
            length = np.array([len(x) for x in sets], np.int64)
            yield rows(0, batch.column("key"), length, np.array([a for a, _ in names], np.int64), np.array([b for _, b in names], np.int64), [sketch(x, num, den) if len(x) else None for x in sets])
            held += sets
            size_held += int(length.sum())
            if size_held > COUNTED:
                yield counts(held)
                held, size_held = [], 0
        if held:
            yield counts(held)

    return map_arrow(documents, run, SETS)


def postings(documents: DataFrame, size: int, num: int, den: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, name, n, position): the prefix of every set, once for each task that has the set."""
    shared = documents.sparkSession.sparkContext.broadcast((frequent, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        seen: set[int] = set()
        for batch in chunks(batches, "text"):
            token, name, length, position = [], [], [], []
            for x in shingle_sets(batch, size):
                n = len(x)
                if not n:
                    continue
                own = set_name(x)[0]
                if own in seen:
                    continue
                seen.add(own)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                    order = np.where(frequent[at] == x, counts[at], 0)
                    x = x[np.argsort(order, kind="stable")]
                k = prefix_length(n, num, den)
                token.append(x[:k].view(np.int64))
                name.append(np.full(k, own, np.int64)), length.append(np.full(k, n, np.int64)), position.append(np.arange(k, dtype=np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, name, length, position)], ["token", "name", "n", "position"])

    return map_arrow(documents, run, "token long, name long, n long, position int")


def shared_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token and name: distinct rows of the tokens that two sets have. A batch's last row waits."""
    held = None
    last_token = None  # of the row before the held one, if it was given out
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        token, name = (np.asarray(table.column(c).combine_chunks()) for c in ("token", "name"))
        n = len(token)
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
        keep = np.flatnonzero(new)
        rows = table.take(pa.array(keep)).combine_chunks().to_batches()[0]
        token, name = token[keep], name[keep]
        same = np.zeros(len(keep), bool)
        same[1:] |= token[1:] == token[:-1]
        same[:-1] |= token[1:] == token[:-1]
        if last_token is not None and token[0] == last_token:
            same[0] = True
        held = rows.slice(len(keep) - 1, 1)
        out = np.flatnonzero(same[:-1])
        if len(out):
            yield rows.take(pa.array(out))
        # the held row's token may have been given out before
        if len(keep) > 1:
            last_token = token[-2] if same[-2] else None
    if held is not None and last_token is not None and held.column("token")[0].as_py() == last_token:
        yield held


def skipping(owner: np.ndarray, n: np.ndarray, position: np.ndarray, probes: np.ndarray, num: int, den: int, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (probe, row) of a list that the sizes and positions leave; rows are sorted by list (owner), n and position.

    Blocks of one size are found by binary search, and so is the place in each where positions become too high.
    """
    new = np.ones(len(n), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (n[1:] != n[:-1])
    block = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    sizes, wide = n[first], int(n.max(initial=0)) + 2
    by_size, by_position = owner[first] * wide + sizes, block * wide + position
    low = np.searchsorted(by_size, owner[probes] * wide + -((-num * n[probes]) // den), "left")
    high = np.searchsorted(by_size, owner[probes] * wide + np.minimum(den * n[probes] // num, wide - 1), "right")
    edges = np.concatenate([[0], np.cumsum(high - low)])
    i = 0
    while i < len(probes):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, "right")) - 1)
        times = high[i:j] - low[i:j]
        probe = np.repeat(probes[i:j], times)
        b = np.arange(len(probe)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[i:j], times)
        least = needed(n[probe], sizes[b], num, den)
        count = np.searchsorted(by_position, b * wide + (sizes[b] - least), "right") - first[b]
        count[n[probe] - position[probe] < least] = 0
        ends = np.concatenate([[0], np.cumsum(count)])
        k = 0
        while k < len(probe):
            m = max(k + 1, int(np.searchsorted(ends, ends[k] + most, "right")) - 1)
            left = np.repeat(probe[k:m], count[k:m])
            yield left, np.arange(len(left)) - np.repeat(ends[k:m] - ends[k], count[k:m]) + np.repeat(first[b[k:m]], count[k:m])
            k = m
        i = j


class Sketches:
    """The sketches of sets as rows of words, folded to the widths that comparisons ask for."""

    def __init__(self, sketches: list[bytes]):
        self.sketches, self.width, self.made = sketches, np.array([len(x) for x in sketches]), {}

    def at(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.made:
            self.made[size] = folded(self.sketches, self.width, size)
        return self.made[size]

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of sets of like sizes, the bits in which their sketches differ."""
        out = np.zeros(len(a), np.int64)
        width = np.minimum(self.width[a], self.width[b])
        for size in np.unique(width).tolist():
            some = np.flatnonzero(width == size)
            m, row = self.at(size)
            step = max(1, (4 << 20) // size)
            for s in range(0, len(some), step):
                k = some[s : s + step]
                out[k] = np.bitwise_count(m[row[a[k]]] ^ m[row[b[k]]]).sum(axis=1, dtype=np.int64)
        return out

    def middle(self, sets: np.ndarray) -> int:
        """The place in `sets`, of like sizes, of the one nearest to the majority of their bits."""
        size = int(self.width[sets].min())
        m, row = self.at(size)
        words = np.ascontiguousarray(m[row[sets]])
        bits = np.unpackbits(words.view(np.uint8).reshape(len(sets), size), axis=1)
        most = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(sets)).view(np.uint64)
        return int(np.bitwise_count(words ^ most).sum(axis=1, dtype=np.int64).argmin())


def candidates(num: int, den: int):
    """For mapInArrow over list rows: spanning forests (a, b) of what the bounds leave; rows (a, a, votes) of middles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["token", "low_block", "high_block"]
        for table, at in pack_groups(t for t in grouped(batches, keys) if t.num_rows > 1):
            name, n, position, own, low, high = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("name", "n", "position", "own_block", "low_block", "high_block"))
            nodes, index = np.unique(name, return_index=True)
            number = np.searchsorted(nodes, name)
            sketches = Sketches(table.column("sketch").combine_chunks().take(pa.array(index)).to_pylist())
            length = n[index]
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))

            def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return sketches.differ(a, b) <= length[a] + length[b] - 2 * needed(length[a], length[b], num, den)

            label, probes = np.arange(len(name)), np.ones(len(name), bool)
            a_all, b_all, middles, votes = [], [], [], []
            for i in np.flatnonzero(np.diff(at) >= CROWD):
                rows = np.arange(at[i], at[i + 1])
                alone = np.ones(len(rows), bool)
                for _ in range(MIDDLES):
                    left = rows[alone]
                    if len(left) < CROWD:
                        break
                    centre = n[left[len(left) // 2]]
                    like = left[(den * n[left] >= num * centre) & (den * centre >= num * n[left])]
                    middle = like[sketches.middle(number[like])]
                    fits = (den * n[rows] >= num * n[middle]) & (den * n[middle] >= num * n[rows])
                    some = rows[fits]
                    least = needed(n[some], n[middle], num, den)
                    some = some[np.minimum(n[some] - position[some], n[middle] - position[middle]) >= least]
                    some = some[near(number[some], np.full(len(some), number[middle]))]
                    joined = np.isin(label[rows], label[some]) | (rows == middle)
                    label[rows[joined]] = middle
                    alone &= ~joined
                    alone[middle - at[i]] = False
                    a_all.append(number[some]), b_all.append(np.full(len(some), number[middle]))
                    middles.append(name[middle]), votes.append(len(some))
                    if len(some) < CROWD // 2:
                        break
                which, count = np.unique(label[rows], return_counts=True)
                if count.max() > 1:  # the largest is compared with others, not with itself
                    probes[rows[label[rows] == which[count.argmax()]]] = False
            for left, right in skipping(owner, n, position, np.flatnonzero(probes), num, den):
                ok = (label[left] != label[right]) & ((left < right) | ~probes[right]) & ((low[left] == high[left]) | (own[left] != own[right]))
                a, b = number[left[ok]], number[right[ok]]
                ab = np.unique(np.minimum(a, b) * len(nodes) + np.maximum(a, b))
                a, b = ab // len(nodes), ab % len(nodes)
                ok = near(a, b)
                a_all.append(a[ok]), b_all.append(b[ok])
            if a_all and sum(map(len, a_all)):
                child, root = forest_of(np.concatenate(a_all), np.concatenate(b_all))
                a, b = np.concatenate([nodes[child], np.array(middles, np.int64)]), np.concatenate([nodes[root], np.array(middles, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([np.zeros(len(child), np.int64), np.array(votes, np.int64)]))], ["a", "b", "votes"])

    return run


def folded(sketches: list[bytes], width: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of `size` bytes and of more, folded to that size, as rows of words; and each set's row."""
    rows = np.full(len(sketches), -1)
    some = np.flatnonzero((width >= size) & (width <= 4 * size))
    rows[some] = np.arange(len(some))
    out = np.zeros((len(some), size), np.uint8)
    for r, i in enumerate(some):
        out[r] = np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint8).reshape(-1, size), axis=0)
    return out.view(np.uint64), rows


def relations(tokens: np.ndarray, at: np.ndarray, num: int, den: int, label: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, int]]:
    """Component labels of the sets tokens[at[i]:at[i + 1]] (numbers of sets), and how many pairs were decided in which way.

    label: components known before; sets of one of them are not compared with each other.
    """
    m, n = len(at) - 1, np.diff(at)
    token, inverse, often = np.unique(tokens, return_inverse=True, return_counts=True)
    label = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1]
    told = {"pairs": m * (m - 1) // 2, "pivots": 0, "bounds": 0, "exact": 0}
    # the sum of a set's differences from all others
    total = np.add.reduceat(often[inverse], at[:-1])
    order = np.argsort(m * n - 2 * total, kind="stable")
    open_, away = np.ones(m, bool), []

    def unite(linked: np.ndarray) -> None:
        label[np.isin(label, label[linked])] = label[linked[0]]

    for p in order:
        if len(away) == PIVOTS or (label == label[0]).all():
            break
        if not open_[p]:
            continue
        has = np.zeros(len(token), bool)
        has[inverse[at[p] : at[p + 1]]] = True
        overlap = np.add.reduceat(has[inverse].astype(np.int64), at[:-1])
        away.append(n[p] + n - 2 * overlap)
        linked = np.flatnonzero(den * overlap >= num * (n[p] + n - overlap))
        unite(linked)
        open_[linked] = False
    told["pivots"] = len(away)
    if (label == label[0]).all():
        return label, told
    allowed = n[:, None] + n[None, :] - 2 * needed(n[:, None], n[None, :], num, den)
    below, above = np.zeros((m, m), np.int64), np.full((m, m), np.iinfo(np.int64).max)
    for d in away:
        np.maximum(below, np.abs(d[:, None] - d[None, :]), out=below)
        np.minimum(above, d[:, None] + d[None, :], out=above)
    sure = np.triu((above <= allowed) & (label[:, None] != label[None, :]), 1)
    for i, j in zip(*np.nonzero(sure)):
        if label[i] != label[j]:
            unite(np.array([i, j]))
    undecided = np.triu((below <= allowed) & (label[:, None] != label[None, :]), 1)
    told["exact"] = int(undecided.sum())
    told["bounds"] = told["pairs"] - told["exact"]
    some = np.flatnonzero(undecided.any(axis=0) | undecided.any(axis=1))
    if len(some):
        overlap = overlaps([inverse[at[i] : at[i + 1]] for i in some])
        size = n[some]
        linked = undecided[np.ix_(some, some)] & (den * overlap >= num * (size[:, None] + size[None, :] - overlap))
        for i, j in zip(*np.nonzero(linked)):
            if label[some[i]] != label[some[j]]:
                unite(some[[i, j]])
    return label, told


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, from the tokens in which the sets differ; those that all have are counted once."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    token, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = (count > 1) & (count < m)
    column = np.cumsum(use) - 1
    keep = use[inverse]
    rows, cols = owner[keep], column[inverse[keep]]
    by = np.argsort(cols, kind="stable")
    rows, cols = rows[by], cols[by]
    out = np.zeros((m, m))
    for c in range(0, int(use.sum()), 4096):
        i, j = np.searchsorted(cols, [c, c + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[rows[i:j], cols[i:j] - c] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64) + int((count == m).sum())


def edges_of(batches: Iterator[pa.RecordBatch], keys: list[str], decide) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) that decide(table, key, flat tokens, offsets) gives for each run of keys, put together."""
    a_all, b_all, held = [], [], 0
    for group in grouped(batches, keys):
        if group.num_rows < 2:
            continue
        group = group.combine_chunks()
        lists = group.column("tokens").combine_chunks()
        offsets = np.asarray(lists.offsets).astype(np.int64)
        a, b = decide(group, np.asarray(group.column("key").combine_chunks()), np.asarray(lists.flatten()), offsets - offsets[0])
        a_all.append(a), b_all.append(b)
        held += len(a)
        if held > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_all)), pa.array(np.concatenate(b_all))], ["a", "b"])
            a_all, b_all, held = [], [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_all)), pa.array(np.concatenate(b_all))], ["a", "b"])


def star(key: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each set to the smallest key of its label."""
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, label, key)
    some = np.flatnonzero(least[label] != key)
    return key[some], least[label[some]]


def verify(num: int, den: int, keys: list[str], labelled: bool = False):
    """For mapInArrow over the sets of groups or of pairs of blocks: spanning forests (a, b) of the links, by document ids."""

    def decide(table, key, tokens, at):
        label = np.asarray(table.column("label").combine_chunks()) if labelled else None
        return star(key, relations(tokens, at, num, den, label)[0])

    return lambda batches: edges_of(batches, keys, decide)


def stars(num: int, den: int):
    """For mapInArrow over parts of large groups, the pivots (role 0) first: edges from sets to pivots."""

    def decide(table, key, tokens, at):
        role = np.asarray(table.column("role").combine_chunks())
        n, owner, a, b = np.diff(at), np.repeat(np.arange(len(key)), np.diff(at)), [], []
        for p in np.flatnonzero(role == 0):
            pivot = np.sort(tokens[at[p] : at[p + 1]])
            has = pivot[np.minimum(np.searchsorted(pivot, tokens), len(pivot) - 1)] == tokens
            overlap = np.bincount(owner, has, len(key)).astype(np.int64)
            linked = np.flatnonzero((den * overlap >= num * (n + n[p] - overlap)) & (key != key[p]))
            a.append(key[linked]), b.append(np.full(len(linked), key[p]))
        return (np.concatenate(a), np.concatenate(b)) if a else (key[:0], key[:0])

    return lambda batches: edges_of(batches, ["group", "part"], decide)


def parts(count: F.Column, weight: F.Column) -> F.Column:
    """How many blocks so many sets of so many shingles make."""
    return F.greatest(F.ceil(count / GROUP_BLOCK), F.ceil(weight / GROUP_TOKENS)).cast("int")


def link_large(sets: DataFrame, member: DataFrame, large: DataFrame, votes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect the components of large groups.

    sets: (key, group, tokens); member: (key, group, name, n); large: (group, parts); votes: (name, votes).
    """
    dealt = lambda df, salt, by: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(by)).cast("int")
    sets = materialize(sets, "sets_of_large")
    large = materialize(large, "large")
    inside = member.join(maybe_broadcast(large), "group")
    # the middles of most sets, and the first
    best = inside.join(maybe_broadcast(votes), "name", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    tops = best.where("votes > 0").groupBy("group").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "key")), False), 1, STARS).alias("top")).select("group", F.explode("top.key").alias("key"))
    pivots = materialize(tops.unionByName(inside.groupBy("group").agg(F.min("key").alias("key"))).distinct(), "pivots")
    rows = sets.join(maybe_broadcast(large), "group")
    own = rows.select("group", dealt(rows, 17, "parts").alias("part"), F.lit(1).alias("role"), "key", "tokens")
    every = rows.join(maybe_broadcast(pivots), ["group", "key"]).select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "key", "tokens")
    full = ["group", "part"]
    edges = map_arrow(own.unionByName(every).repartition(*full).sortWithinPartitions(*full, "role", "key"), stars(num, den), "a long, b long")
    edges = materialize(edges, "stars")
    label = components(edges).select(F.col("node").alias("key"), F.col("component").alias("label"))
    label = materialize(inside.join(maybe_broadcast(label), "key", "left").select("group", "key", "n", F.coalesce("label", "key").alias("label")), "labels")
    main = label.groupBy("group", "label").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("label", "c").alias("main"))
    rest = materialize(label.join(maybe_broadcast(main), "group").where("label <> main").select("group", "key", "n"), "rest")
    if rest.isEmpty():
        return edges
    sizes = rest.groupBy("group").agg(parts(F.count("*"), F.sum("n")).alias("others")).join(large, "group")
    rows = sets.join(maybe_broadcast(materialize(sizes, "others")), "group").join(maybe_broadcast(label.select("key", "label")), "key")
    first = rows.join(maybe_broadcast(rest.select("key")), "key", "left_semi").withColumn("low", dealt(rows, 19, "others")).withColumn("high", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    second = rows.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("high", dealt(rows, 17, "parts"))
    full = ["group", "low", "high"]
    columns = [*full, "key", "label", "tokens"]
    both = first.select(columns).unionByName(second.select(columns)).repartition(*full).sortWithinPartitions(*full, "key")
    return edges.unionByName(map_arrow(both, verify(num, den, full, True), "a long, b long"))


def similar_sets(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(key, n_shingles, component_id) for every document."""
    docs = one_column(documents, key=key, text=text).withColumn("key", F.col("key").cast("long"))
    told = materialize(describe(docs, size, num, den), "sets")
    own = told.where("row = 0").select("key", "n", "name", "check", "sketch")
    some = own.where("n > 0 AND key IS NOT NULL")
    reps = some.groupBy("name").agg(F.min("key").alias("rep"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = materialize(reps, "reps")
    if not reps.where("c0 <> c1").isEmpty():
        raise RuntimeError("two sets have one 64-bit name; choose other constants in set_name")
    total = own.agg(F.sum("n")).first()[0] or 0
    often = told.where("row = 1").groupBy("name").agg(F.sum("n").alias("c")).where(F.col("c") * FREQUENT > F.greatest(F.lit(total), F.lit(15 * FREQUENT)))
    pairs = often.toArrow()  # at most FREQUENT rows of two longs, by the sum of all counts
    frequent = np.asarray(pairs.column("name")).view(np.uint64)
    order = np.argsort(frequent)
    lists = postings(docs, size, num, den, frequent[order], np.asarray(pairs.column("c"))[order])
    lists = map_arrow(lists.repartition("token").sortWithinPartitions("token", "name"), shared_postings, lists.schema)
    lists = materialize(lists, "lists")
    rows = blocks(lists, ["token"], "name", LIST_BLOCK).join(reps.select("name", "sketch"), "name")
    full = ["token", "low_block", "high_block"]
    rows = rows.repartition(*full).sortWithinPartitions(*full, "n", "position", "name")
    near = materialize(map_arrow(rows, candidates(num, den), "a long, b long, votes long"), "near")
    discard(lists)
    groups = components(near.select("a", "b"))
    member = materialize(groups.join(reps.select("name", "rep", "n"), groups["node"] == reps["name"]).select(F.col("rep").alias("key"), F.col("component").alias("group"), "name", "n"), "members")
    large = materialize(member.groupBy("group").agg(F.count("*").alias("c"), F.sum("n").alias("s")).where(f"c > {GROUP_BLOCK} OR (s > {GROUP_TOKENS} AND c > 2)").select("group", parts(F.col("c"), F.col("s")).alias("parts")), "large")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = shingle_sets(batch, size)
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("group"), lists], ["key", "group", "tokens"])

    def sets_of(some: DataFrame) -> DataFrame:
        # rows of one id with other texts: the set that is the member's
        sent = docs.join(maybe_broadcast(some.select("key", "group")), "key").select("key", "group", "text")
        return map_arrow(sent, tokens, "key long, group long, tokens array<long>")

    small_groups = member.join(maybe_broadcast(large), "group", "left_anti")
    sent = sets_of(small_groups).repartition("group").sortWithinPartitions("group", "key")
    edges = map_arrow(sent, verify(num, den, ["group"]), "a long, b long")
    if not large.isEmpty():
        votes = near.where("votes > 0").groupBy(F.col("a").alias("name")).agg(F.sum("votes").alias("votes"))
        edges = edges.unionByName(link_large(sets_of(member.join(maybe_broadcast(large), "group", "left_semi")), member, large, votes, num, den))
    found = components(edges)
    joined = reps.join(found, F.col("rep") == F.col("node"), "left").select(F.col("name").alias("s"), F.coalesce("component", "rep").alias("component"))
    out = own.join(joined, (F.col("name") == F.col("s")) & (F.col("n") > 0) & F.col("key").isNotNull(), "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def keep_first(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents that are the smallest id of their component; all columns stay. Repeated rows of a kept id stay."""
    found = similar_sets(documents, key, text, size, num, den).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__key")).distinct()
    dropped = materialize(found, "dropped")
    return documents.join(maybe_broadcast(dropped), F.col(key) == F.col("__key"), "left_anti")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
rare AS (SELECT s FROM shingle GROUP BY 1 HAVING count(*) > 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingle a JOIN shingle b USING (s) JOIN rare USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
sym AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN sym b ON r.y = b.x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM word w LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY 1) r ON r.x = w.doc_id
"""
