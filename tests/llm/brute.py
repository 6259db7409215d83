"""Plain versions of operators, for small tables; nothing here is distributed or quick."""

import math
import re
from collections import defaultdict

from mediaframe.llm import pii

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def similar(rows, size, num):
    """id -> component of (id, text) rows."""
    sets = {i: shingles(t, size) for i, t in rows}
    return components(sorted(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]))


def benchmark_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER)) if w]


def windows(items, size=10):
    """window -> items, of (item, text) rows."""
    out = defaultdict(set)
    for i, t in items:
        w = benchmark_words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            out[tuple(w[k : k + n])].add(i)
    return out


def contamination(text, windows):
    """(number of words, sorted spans, items) of a text."""
    w, spans, items = benchmark_words(text), [], set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if (x := tuple(w[k : k + n])) in windows:
                spans.append((k, k + n))
                items |= windows[x]
    return len(w), sorted(spans), items


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in twice) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def bootstrap(texts, rounds=pii.ROUNDS):
    """text -> sorted added spans: seeds and patterns scored as sums over dictionaries."""
    found = {t: pii.occurrences(t) for t in set(texts) if t}
    having, seeds, unknown = defaultdict(set), set(), set()
    for rows in found.values():
        for kind, _, _, value, patterns in rows:
            for p in patterns:
                having[p].add(value)
            seeds.add((value, kind)) if kind >= 0 else unknown.add(value)
    of = defaultdict(set)
    for p, values in having.items():
        for v in values:
            of[v].add(p)
    trust = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        live = {}
        for p, values in having.items():
            for kind in range(4):
                given = [trust[v, kind] for v in values if (v, kind) in trust]
                conf = min(1.0, sum(given) / len(values))
                if sum(t >= pii.TRUST for t in given) >= pii.SUPPORT and conf >= pii.CONFIDENCE:
                    live[p, kind] = conf
        trust = dict.fromkeys(seeds, 1.0)
        for v in unknown:
            for kind in range(4):
                confs = [live[p, kind] for p in of[v] if (p, kind) in live]
                if confs and (v, kind) not in trust:
                    trust[v, kind] = 1 - math.prod(max(1 - c, 1e-12) for c in confs)
    out = {}
    for t, rows in found.items():
        out[t] = []
        for kind, a, b, value, _ in rows:
            best = max((trust.get((value, k), 0.0), -k) for k in range(4))
            if kind < 0 and best[0] >= pii.TRUST:
                out[t].append((-best[1], a, b))
        out[t].sort()
    return out
