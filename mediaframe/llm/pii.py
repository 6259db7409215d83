r"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Base spans, leftmost and non-overlapping within a kind (offsets in code points, end exclusive): email, ip (parts up to 255),
card (13 to 19 digits that pass Luhn's test), phone (9 to 15 digits). Each finder is linear in the text: emails are found from
their '@', digit runs are taken possessively, so that no run is scanned twice.

Bootstrapping: an occurrence is a base span, or an unknown candidate outside all base spans: a run around an '@', a number of
groups of up to five digits with spaces, dots, dashes or brackets between them, or a run of letters, digits, ``_`` and ``-``;
without an '@' it has ``MIN_DIGITS`` digits at least. Candidates are cut out of text with or without spaces, of any length.

An occurrence has a shape (digits as 0, runs of letters as one a or A) and lies between words (runs of ``\w``, lower-cased,
digits as 0). Its lexical patterns, from narrow to wide, ``*`` being any word or value:

    l2 l1 *      l1 * r1      l1 <shape>      <shape> r1      l2 * <shape>      * <shape> *

Patterns and distinct values (lower-cased) make a bipartite graph, scored from either side for ``ROUNDS`` rounds:

* seeds (values of base spans) have trust 1 in their kind; other values have none at first;
* a pattern is live in a kind if ``SUPPORT`` distinct values of trust ``TRUST`` or more in that kind have it, whether they
  are seeds or were found in an earlier round: found values bring in patterns of their own. Its confidence is the trust of
  its values in the kind, summed and divided by the number of its distinct values;
* the trust of a value in a kind is the noisy-or of the confidences, those of at least ``CONFIDENCE``, of its live patterns.

Unknown occurrences whose value reaches ``TRUST`` are added, each in the kind of highest trust (the first listed among equals).
A round is a join on the value, a partial aggregation by pattern, a join on the pattern and a partial aggregation by value;
patterns of one value only, or of seeds only, cannot add anything and are left out before.

Null and empty texts have no spans. Repeated rows get the same spans each, and count once in every score. Rows of one id
with different texts are judged by their own texts. Null ids are kept. Extra columns are ignored; an empty table gives none.
Very long texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mediaframe.llm.common import chunks, discard, materialize, maybe_broadcast, one_column
from mediaframe.session import map_arrow

KINDS = ("email", "ip", "card", "phone")
MIN_DIGITS = 6
ROUNDS = 3
SUPPORT = 3
CONFIDENCE = 0.5
TRUST = 0.8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
DIGIT = re.compile(r"[0-9]")
#: Numbers in groups, or runs of letters, digits and dashes; a start has no such character before it, so each run is tried once.
RUNS = re.compile(
    r"(?<![A-Za-z0-9_])(?=[+(]?[A-Za-z_-]*+[0-9])(?:\+?\(?[0-9]{1,5}(?![A-Za-z0-9_])(?:[\x20().-]{1,2}[0-9]{1,5}(?![A-Za-z0-9_]))++|[A-Za-z0-9_]++(?:-[A-Za-z0-9_]++)*+)"
)
#: What ends a run around an '@'.
OUTSIDE = frozenset(" \t\n\r\x0b\x0c@<>()[]{},;:\"'|")
WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (g.lstrip("0") or "0" for g in m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def around_at(text: str) -> list[tuple[int, int]]:
    """Runs around each '@', as far as no character of OUTSIDE, without dots at their ends; of some text on both sides."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start, end, n = at, at + 1, len(text)
        while start > low and text[start - 1] not in OUTSIDE:
            start -= 1
        while end < n and text[end] not in OUTSIDE:
            end += 1
        low = end
        while end > at + 1 and text[end - 1] in ".!?":
            end -= 1
        if start < at and end > at + 1:
            out.append((start, end))
        at = text.find("@", low)
    return out


def shape(value: str) -> str:
    """Digits as 0, runs of upper-case letters as A, of other letters as a."""
    out = []
    for c in value:
        k = "0" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c
        if k not in "aA" or not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def number(text: str) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def patterns(text: str, starts: list[int], ends: list[int], start: int, end: int) -> list[str]:
    """The lexical patterns of text[start:end], from the places of the text's words; words that overlap it are passed over."""
    clean = lambda i: DIGIT.sub("0", text[starts[i] : ends[i]].lower())
    i, j = bisect.bisect_right(ends, start) - 1, bisect.bisect_left(starts, end)
    l1, l2 = clean(i) if i >= 0 else "", clean(i - 1) if i >= 1 else ""
    r1 = clean(j) if j < len(starts) else ""
    s = shape(text[start:end])
    out = [f"S {s}"]
    if l1:
        out.append(f"L {l1} {s}")
    if r1:
        out.append(f"R {r1} {s}")
    if l2:
        out += [f"LL {l2} {l1}", f"LW {l2} {s}"]
    if l1 and r1:
        out.append(f"LR {l1} {r1}")
    return out


def occurrences(text: str) -> list[tuple[int, int, int, str, list[str]]]:
    """(kind number or -1, start, end, value, patterns); base spans come first."""
    base = base_spans(text)
    found = list(base)
    if any(c in text for c in "0123456789@"):
        lows, highs = [], []  # the union of base spans
        for a, b in sorted((a, b) for _, a, b in base):
            if lows and a < highs[-1]:
                highs[-1] = max(highs[-1], b)
            else:
                lows.append(a), highs.append(b)
        runs = [(m.start(), m.end()) for m in RUNS.finditer(text) if m.end() - m.start() >= MIN_DIGITS and len(NOT_DIGIT.sub("", m[0])) >= MIN_DIGITS]
        last = 0
        for a, b in sorted(around_at(text) + runs):
            k = bisect.bisect_right(highs, a)
            if a >= last and (k == len(lows) or lows[k] >= b):
                found.append((-1, a, b))
                last = b
    if not found:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    starts, ends = [a for a, _ in places], [b for _, b in places]
    return [(kind, a, b, text[a:b].lower(), patterns(text, starts, ends, a, b)) for kind, a, b in found]


FOUND = "array<struct<kind:int,start:int,end:int,value:long,patterns:array<long>>>"


def scan(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(uid, key, found) for every document, where uid is a hash of the text; values and patterns as hashes."""
    docs = one_column(documents, key=key, text=text).select(F.xxhash64("text").alias("uid"), "key", "text")
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = [[{"kind": k, "start": a, "end": b, "value": number(v), "patterns": [number(p) for p in ps]} for k, a, b, v, ps in occurrences(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("key"), pa.array(rows, kind)], ["uid", "key", "found"])

    return map_arrow(docs, run, f"uid long, key {dict(docs.dtypes)['key']}, found {FOUND}")


ADDED = "array<struct<kind:int,start:int,end:int>>"


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(key, uid, added array<struct<kind,start,end>>): unknown occurrences that the graph makes out to be personal data."""
    o = found.where(F.size("found") > 0).select("key", "uid", F.explode("found").alias("o")).select("key", "uid", "o.*")
    nodes = materialize(o.select("value", "kind", F.explode("patterns").alias("pattern")).distinct(), "nodes")
    edges = nodes.groupBy("value", "pattern").agg(F.max("kind").alias("known"))
    # patterns that two values have, one of them not a seed
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count(F.when(F.col("known") < 0, 1)).alias("open")).where("n > 1 AND open > 0").select("pattern", "n")
    size = materialize(size, "patterns")
    edges = materialize(edges.join(maybe_broadcast(size), "pattern").select("value", "pattern", "n"), "edges")
    seeds = materialize(nodes.where("kind >= 0").select("value", "kind").distinct().withColumn("trust", F.lit(1.0)), "seeds")
    trust = seeds
    for _ in range(rounds):
        given = edges.join(maybe_broadcast(trust), "value").groupBy("pattern", "kind")
        live = given.agg(F.count(F.when(F.col("trust") >= TRUST, 1)).alias("support"), F.sum("trust").alias("sum"), F.first("n").alias("n"))
        live = live.where(F.col("support") >= SUPPORT).select("pattern", "kind", F.least(F.col("sum") / F.col("n"), F.lit(1.0)).alias("conf"))
        live = materialize(live.where(F.col("conf") >= CONFIDENCE), "live")
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-12)))))
        gained = edges.select("value", "pattern").join(maybe_broadcast(live), "pattern").groupBy("value", "kind").agg((1 - miss).alias("trust"))
        before, trust = trust, materialize(gained.unionByName(seeds).groupBy("value", "kind").agg(F.max("trust").alias("trust")), "trust")
        discard(live, *([] if before is seeds else [before]))
    best = trust.where(F.col("trust") >= TRUST).groupBy("value").agg(F.max(F.struct("trust", (-F.col("kind")).alias("k"))).alias("b")).select("value", (-F.col("b.k")).alias("named"))
    unknown = o.where("kind < 0").select("key", "uid", "start", "end", "value")
    places = unknown.join(maybe_broadcast(materialize(best, "values")), "value")
    return places.groupBy("key", "uid").agg(F.sort_array(F.collect_set(F.struct(F.col("named").alias("kind"), "start", "end"))).alias("added"))


def find_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, uid, base, added) for every row: arrays of (kind number, start, end), sorted; uid is a hash of the text."""
    found = materialize(scan(documents, key, text), "found")
    base = F.transform(F.filter("found", lambda x: x["kind"] >= 0), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    added = maybe_broadcast(materialize(bootstrap(found), "added").select(F.col("key").alias("k"), F.col("uid").alias("u"), "added"), 50_000)
    none = F.expr(f"cast(array() AS {ADDED})")
    return found.select("key", "uid", base.alias("base")).join(added, F.col("key").eqNullSafe(F.col("k")) & (F.col("uid") == F.col("u")), "left").select("key", "uid", "base", F.coalesce("added", none).alias("added"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, of overlapping ones the first, replaced by its kind in brackets; the rest of an overlapping one goes too."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(documents: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """The documents with personal data in `text` masked; all columns stay, and `length`, if named, is set anew."""
    found = find_spans(documents, key, text).where((F.size("base") > 0) | (F.size("added") > 0))
    found = found.select(F.col("key").alias("__key"), F.col("uid").alias("__uid"), F.array_union("base", "added").alias("__spans")).dropDuplicates(["__key", "__uid"])
    spans = maybe_broadcast(materialize(found, "spans"), 50_000)
    names = documents.columns
    same = F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__uid"))
    rows = documents.join(spans, same, "left").select(*[F.col(f"`{n}`") for n in names], "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            spans = batch.column("__spans").to_pylist()
            new = [masked(t, [(s["kind"], s["start"], s["end"]) for s in x]) if x and t else t for t, x in zip(batch.column(text).to_pylist(), spans)]
            columns = [pa.array(new, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = map_arrow(rows, run, documents.schema)
    return out.withColumn(length, F.char_length(text).cast(documents.schema[length].dataType)) if length else out


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("key").alias("doc_id"),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.sort_array(F.array_union("base", "added"))).alias("spans"),
    )
