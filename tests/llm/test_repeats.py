"""Both substring dedups against brute force."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from mediaframe.llm import lpf_dedup, repeats, tree_dedup
from mediaframe.llm.lpf_dedup import longest_previous


def covered(rows, length):
    """For each document, a mask of the symbols that windows of earlier documents cover."""
    first = {}
    for i, s in rows:
        for k in range(len(s) - length + 1):
            w = tuple(s[k : k + length])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, s in rows:
        mask = [False] * len(s)
        for k in range(len(s) - length + 1):
            if first[tuple(s[k : k + length])] < i:
                mask[k : k + length] = [True] * length
        out[i] = mask
    return out


def test_bytes_as_brute_force(documents, corpus):
    rows = [(i, (t or "").encode()) for i, t in corpus]
    masks = covered(rows, 50)
    got = {r.doc_id: r for r in lpf_dedup.remove_repeats(documents).collect()}
    for i, raw in rows:
        kept = bytes(b for b, m in zip(raw, masks[i]) if not m)
        runs = sum(m and not (k and masks[i][k - 1]) for k, m in enumerate(masks[i]))
        assert (got[i].n_bytes, bytes(got[i].kept), len(got[i].spans)) == (len(raw), kept, runs), i
    assert bytes(got[None].kept) == b"a row without an id " * 20
    assert len(got) == len(rows) + 1


def test_words_as_brute_force(documents, corpus):
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in corpus]
    masks = covered(rows, 13)
    got = {r.doc_id: r for r in tree_dedup.remove_repeats(documents).collect()}
    for i, words in rows:
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(words), sum(masks[i]), " ".join(w for w, m in zip(words, masks[i]) if not m)), i


@pytest.mark.parametrize("name, value", [("GROUP", 3), ("GROUP", 0)])
def test_long_prefixes(documents, corpus, monkeypatch, name, value):
    monkeypatch.setattr(tree_dedup, name, value)
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in corpus]
    masks = covered(rows, 13)
    got = {r.doc_id: r.n_removed for r in tree_dedup.remove_repeats(documents).collect()}
    assert all(got[i] == sum(masks[i]) for i, _ in rows)


@pytest.mark.parametrize("limit, value", [("WIDE", 0), ("HOT", 0), ("HOT", 2)])
def test_wide_anchors(documents, corpus, monkeypatch, limit, value):
    monkeypatch.setattr(repeats, limit, value)
    monkeypatch.setattr(repeats, "HELD", 500)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4000)
    rows = [(i, (t or "").encode()) for i, t in corpus]
    masks = covered(rows, 50)
    got = {r.doc_id: r for r in lpf_dedup.op6_columns(lpf_dedup.remove_repeats(documents)).collect()}
    for i, raw in rows:
        kept = bytes(b for b, m in zip(raw, masks[i]) if not m)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(masks[i]), hashlib.sha256(kept).hexdigest()), i


def test_spans_are_joined_by_a_shuffle(documents, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_SPANS", 0)
    masks = covered([(i, (t or "").encode()) for i, t in corpus], 50)
    got = {r.doc_id: len(r.kept) for r in lpf_dedup.remove_repeats(documents).collect()}
    assert all(got[i] == len(m) - sum(m) for i, m in masks.items())


def test_windows_that_differ_in_one_place(spark):
    """Twelve shared words, then one of 1024 letters and the one with every letter changed: no window repeats; in the third all do."""
    morse = lambda flip: "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024))
    shared = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{shared} {morse(0)}"), (2, f"{shared} {morse(1)}"), (3, f"{shared} {morse(0)}")]
    got = {r.doc_id: r.n_removed for r in tree_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_empty_tables(empty):
    assert lpf_dedup.remove_repeats(empty).count() == 0
    assert tree_dedup.remove_repeats(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.text("ab", min_size=1, max_size=12)), min_size=1, max_size=30))
def test_longest_previous_factor(items):
    width = max(len(s) for _, s in items)
    rows = np.zeros((len(items), width), np.uint8)
    for r, (_, s) in enumerate(items):
        rows[r, : len(s)] = np.frombuffer(s.encode(), np.uint8)
    size, doc = np.array([len(s) for _, s in items]), np.array([d for d, _ in items])
    got = longest_previous(rows, size, np.zeros(len(items), np.int64), doc)

    def common(a, b):
        return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))

    assert got.tolist() == [max((common(s, t) for e, t in items if e < d), default=0) for d, s in items]


def test_packed_columns_round_trip():
    rng = np.random.default_rng(1)
    part = {"anchor": rng.integers(0, 1 << 40, 50).astype(np.uint64), "content": rng.integers(0, 1 << 63, 50).astype(np.uint64), "doc": rng.integers(-9, 9, 50), "first": rng.integers(0, 1 << 31, 50), "count": rng.integers(-1, 30, 50)}
    got = repeats.unpack(repeats.pack(part))
    assert all((got[c].astype(np.int64) == part[c].astype(np.int64)).all() for c in part)
