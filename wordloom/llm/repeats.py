"""Repeated windows of a fixed number of units (words or bytes), by seeds and extension.

Every window of `window` units has an anchor: the rightmost least hash among its runs of `gram` units.
Equal windows have equal anchors at equal places, so only windows on the same anchor need to be
compared. Consecutive windows on the same anchor form a stretch; one row a stretch is shuffled, with
hashes of the anchor and of the whole stretch.

1. An anchor seen once: none of its windows repeat.
2. All stretches of an anchor are the same (and there are two): all its windows repeat.
3. Otherwise each different stretch, once, is fetched from its text and extended to both sides of
   the anchor against the others; a window repeats if it is in two different stretches or in one
   that is there twice.

A hot anchor, stretch or group of copies is counted with partial sums, and the joins that bring
counts back have one row a key on one side, so adaptive execution can split the other. Stretches of
an anchor meet in one task up to `most` of them; beyond that their windows are dealt out one by one.

Texts are known by a 96-bit hash, so copies have one set of results. Anchors, stretches and windows
are compared by hashes of 128 bits taken together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = 0x9E3779B97F4A7C15
_B, _BINV = np.uint64(BASE), np.uint64(pow(BASE, -1, 2**64))
CHUNK = 400_000
MOST = 20_000


class _WordHash(dict):
    def __missing__(self, word):
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


class Words:
    """Units are words, split at ASCII white space."""

    def __init__(self):
        self.known = _WordHash()

    def hashes(self, raw: bytes) -> np.ndarray:
        w = raw.split()
        return np.fromiter(map(self.known.__getitem__, w), np.uint64, len(w))

    def cut(self, raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        w = raw.split()
        return [b" ".join(w[a:b]) for a, b in spans]


class Bytes:
    """Units are bytes of the UTF-8 text."""

    table = np.array([xxhash.xxh64_intdigest(bytes([k]), 7) for k in range(256)], np.uint64)

    def hashes(self, raw: bytes) -> np.ndarray:
        return self.table[np.frombuffer(raw, np.uint8)]

    def cut(self, raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        return [raw[a:b] for a, b in spans]


UNITS = {"words": Words, "bytes": Bytes}


def grams(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g *= _B
        g += h[j : j + n]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return g


def least(g: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (the rightmost) and value of the least of each w consecutive values."""
    v, p, size = g, np.arange(len(g), dtype=np.int32), 1
    while size < w:
        d = min(size, w - size)
        a, b = v[:-d], v[d:]
        right = b <= a
        p = np.where(right, p[d:], p[:-d])
        v = np.where(right, b, a)
        size += d
    return p, v


def prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(h) + 1
    power, inverse = np.full(n, _B, np.uint64), np.full(n, _BINV, np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    p = np.zeros(n, np.uint64)
    np.cumsum(h * power[:-1], out=p[1:])
    return p, inverse


def stretches(h: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text number, start, windows, anchor, content hash and anchor's place of each stretch."""
    none = np.empty(0, np.int64)
    if len(h) < window:
        return (none,) * 6
    place, value = least(grams(h, gram), window - gram + 1)
    starts = np.arange(len(place))
    text = np.searchsorted(ends, starts, side="right")
    ok = np.flatnonzero(starts + window <= ends[text])
    if not len(ok):
        return (none,) * 6
    place, value, text = place[ok], value[ok], text[ok]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(ok) != 1) | (np.diff(text) != 0)]))
    count = np.diff(np.append(first, len(ok)))
    s = ok[first]
    p, inverse = prefix(h)
    content = (p[s + count - 1 + window] - p[s]) * inverse[s] + (place[first] - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    begin = np.concatenate([[0], ends[:-1]])[text[first]]
    return text[first], s - begin, count, value[first].view(np.int64), content.view(np.int64), place[first] - s


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _seed_rows(unit: str, window: int, gram: int):
    def run(batches):
        units = UNITS[unit]()
        for batch in batches:
            k1, k2, owner = (batch.column(c).to_pylist() for c in ("k1", "k2", "owner"))
            once: dict[tuple[int, int], list] = {}  # copies in a batch are one text, counted
            for i, key in enumerate(zip(k1, k2, strict=True)):
                once.setdefault(key, [i, 0])[1] += 1
            texts = batch.column("text")
            hs, at, size = [], [], 0
            todo = list(once.values())
            for k, (i, n) in enumerate(todo):
                h = units.hashes(_raw(texts[i].as_py()))
                if len(h) >= window:
                    hs.append(h)
                    at.append((i, n))
                    size += len(h)
                if hs and (size >= CHUNK or k == len(todo) - 1):
                    t, s, m, a, r, o = stretches(np.concatenate(hs), np.cumsum([len(x) for x in hs]), window, gram)
                    row = np.array([x for x, _ in at])[t]
                    copies = np.array([x for _, x in at])[t]
                    pick = lambda v: pa.array(np.array(v, np.int64)[row])  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(r), pick(k1), pick(k2), pick(owner), pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(copies.astype(np.int64))], names=["a", "r", "k1", "k2", "owner", "s", "m", "o", "c"])
                    hs, at, size = [], [], 0

    return run


def _contents(unit: str, window: int):
    def run(batches):
        units = UNITS[unit]()
        for batch in batches:
            a, r, c, o, out = [], [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                out += units.cut(_raw(text), [(x["s"], x["s"] + x["m"] - 1 + window) for x in runs])
                a += [x["a"] for x in runs]
                r += [x["r"] for x in runs]
                c += [x["c"] for x in runs]
                o += [x["o"] for x in runs]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(out, pa.binary()), pa.array(o, pa.int32())], names=["a", "r", "c", "content", "o"])

    return run


def _window_hashes(units, contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the content, place within it, and hash of every window."""
    hs = [units.hashes(x) for x in contents]
    n = np.array([len(x) for x in hs], np.int64)
    p, inverse = prefix(np.concatenate(hs) if hs else np.empty(0, np.uint64))
    which = np.repeat(np.arange(len(hs)), n - window + 1)
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    j = np.arange(len(which)) - np.repeat(np.cumsum(n - window + 1) - (n - window + 1), n - window + 1)
    s = begin[which] + j
    return which, j, ((p[s + window] - p[s]) * inverse[s]).view(np.int64)


def _refined(classes: np.ndarray, units: np.ndarray, many: int) -> np.ndarray:
    """Classes of those that agree in their class and in the next unit; a class or unit below 0 gives -1."""
    out = np.full(len(classes), -1, np.int64)
    ok = np.flatnonzero((classes >= 0) & (units >= 0))
    out[ok] = np.unique(classes[ok] * many + units[ok], return_inverse=True)[1]
    return out


def _extended(flat, begin, size, anchor, classes, step: int, most: int):
    """Classes of contents that agree in k units from the anchor on (step 1) or before it (step -1), for k = 0 to most."""
    many = int(flat.max()) + 1 if len(flat) else 1
    found = [classes]
    for k in range(most):
        at = anchor + k if step > 0 else anchor - 1 - k
        there = (at >= 0) & (at < size)
        unit = np.full(len(anchor), -1, np.int64)
        unit[there] = flat[(begin + at)[there]]
        found.append(_refined(found[-1], unit, many))
    return found


def _compare(unit: str, window: int, limit: int = 6_000_000):
    """Which windows of an anchor's stretches repeat; rows come sorted by anchor and stretch.

    All stretches of an anchor are matched at once. From the anchor on, and before it, matches are
    extended unit by unit: stretches that agree so far are a class, and the next unit splits it. The
    window that begins x units before the anchor repeats if another stretch agrees in x units to the
    left and in the window's others to the right. No pairs of stretches are made.
    """

    def solve(units, a, r, c, contents, anchor):
        keep = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(r) != 0)]))  # copies of a text give the same
        copies = np.maximum.reduceat(c, keep)
        a, r, anchor, contents = a[keep], r[keep], anchor[keep], [contents[i] for i in keep]
        hs = [units.hashes(x) for x in contents]
        size = np.array([len(x) for x in hs], np.int64)
        begin = np.cumsum(size) - size
        flat = np.unique(np.concatenate(hs), return_inverse=True)[1].astype(np.int64)
        same = np.unique(a, return_inverse=True)[1].astype(np.int64)
        right = _extended(flat, begin, size, anchor, same, 1, window)
        left = _extended(flat, begin, size, anchor, same, -1, int(anchor.max()))
        which, at = [], []
        for x in range(int(anchor.max()) + 1):
            j = anchor - x
            ok = np.flatnonzero((j >= 0) & (j + window <= size))
            both = np.unique(left[x][ok] * len(a) + right[window - x][ok], return_inverse=True)[1]
            hit = (np.bincount(both)[both] > 1) | (copies[ok] > 1) if len(ok) else ok.astype(bool)
            which.append(ok[hit])
            at.append(j[ok[hit]])
        which, at = np.concatenate(which), np.concatenate(at)
        order = np.lexsort((at, which))
        which, at = which[order], at[order]
        first = np.concatenate([[True], (np.diff(which) != 0) | (np.diff(at) != 1)])[: len(at)]
        last = np.concatenate([first[1:], [True]])[: len(at)]
        return pa.RecordBatch.from_arrays([pa.array(a[which[first]]), pa.array(r[which[first]]), pa.array(at[first].astype(np.int32)), pa.array((at[last] + 1).astype(np.int32))], names=["a", "r", "j", "e"])

    def run(batches):
        units = UNITS[unit]()
        none = np.empty(0, np.int64)
        a, r, c, o, x, size = none, none, none, none, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                a, r, c, o = (np.concatenate([u, part.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for u, k in zip((a, r, c, o), ("a", "r", "c", "o"), strict=True))
                new = part.column("content").to_pylist()
                x += new
                size += sum(map(len, new))
                if size >= limit and a[0] != a[-1]:
                    cut = int(np.flatnonzero(a != a[-1])[-1]) + 1
                    yield solve(units, a[:cut], r[:cut], c[:cut], x[:cut], o[:cut])
                    a, r, c, x, o = a[cut:], r[cut:], c[cut:], x[cut:], o[cut:]
                    size = sum(map(len, x))
        if len(a):
            yield solve(units, a, r, c, x, o)

    return run


def _single_windows(unit: str, window: int):
    def run(batches):
        units = UNITS[unit]()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                a, r, c = (v.to_numpy(zero_copy_only=False) for v in part.columns[:3])
                which, j, h = _window_hashes(units, part.column(3).to_pylist(), window)
                yield pa.RecordBatch.from_arrays([pa.array(a[which]), pa.array(r[which]), pa.array(c[which]), pa.array(j.astype(np.int32)), pa.array(h)], names=["a", "r", "c", "j", "h"])

    return run


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and the text's key; owner tells apart rows with equal texts where that saves work."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("k1"), F.hash(t).cast("long").alias("k2"), F.coalesce(F.xxhash64(F.col(doc_id)), F.lit(0)).alias("owner"))


def repeated_windows(docs: DataFrame, unit: str, window: int, gram: int, compare=None, most: int = MOST) -> DataFrame:
    """(k1, k2, spans): of texts of keyed() docs, the starts [b, e) of windows that occur elsewhere too.

    compare, if given, takes the place of the comparison of an anchor's stretches by window hashes.
    """
    tables = common.Scratch(docs.sparkSession)
    seeds = docs.select("k1", "k2", "owner", "text").mapInArrow(_seed_rows(unit, window, gram), "a long, r long, k1 long, k2 long, owner long, s int, m int, o int, c long")
    seeds = tables.write(seeds, "seeds")
    anchors = seeds.groupBy("a").agg(F.sum("c").alias("n"), (F.min("r") != F.max("r")).alias("mixed")).where("n > 1").select("a", "mixed")
    anchors = tables.write(anchors, "anchors")  # so that the join that follows may split a hot anchor
    rows = tables.write(seeds.join(anchors, "a"), "repeated")
    tables.drop("seeds", "anchors")
    whole = rows.where("not mixed").select("k1", "k2", F.col("s").alias("b"), (F.col("s") + F.col("m")).alias("e"))
    different = rows.where("mixed").groupBy("a", "r").agg(F.sum("c").alias("c"), F.min(F.struct("k1", "k2", "owner", "s", "m", "o")).alias("x"))
    different = tables.write(different.select("a", "r", "c", "x.*"), "different")
    per_text = different.groupBy("k1", "k2", "owner").agg(F.collect_list(F.struct("a", "r", "c", "s", "m", "o")).alias("runs"))
    contents = docs.join(per_text, ["k1", "k2", "owner"]).select("text", "runs").mapInArrow(_contents(unit, window), "a long, r long, c long, content binary, o int")
    sizes = different.groupBy("a").count().where(F.col("count") > most).select("a", F.lit(True).alias("large"))
    sizes = tables.write(sizes, "sizes")
    contents = contents.join(sizes, "a", "left")
    contents = tables.write(contents, "contents")
    tables.drop("different")
    small = contents.where("large is null").select("a", "r", "c", "content", "o").repartition("a").sortWithinPartitions("a", "r")
    found = small.mapInArrow(compare or _compare(unit, window), "a long, r long, j int, e int")
    large = contents.where("large").select("a", "r", "c", "content").mapInArrow(_single_windows(unit, window), "a long, r long, c long, j int, h long")
    twice = large.groupBy("a", "h").agg((F.min("r") != F.max("r")).alias("d"), F.max("c").alias("c")).where("d or c > 1").select("a", "h")
    found = found.union(large.join(twice, ["a", "h"]).select("a", "r", "j", (F.col("j") + 1).alias("e")).distinct())
    found = tables.write(found, "found")
    tables.drop("contents", "sizes")
    spans = rows.where("mixed").select("a", "r", "k1", "k2", "s").join(found, ["a", "r"]).select("k1", "k2", (F.col("s") + F.col("j")).alias("b"), (F.col("s") + F.col("e")).alias("e"))
    both = whole.union(spans).groupBy("k1", "k2").agg(F.collect_set(F.struct("b", "e")).alias("spans"))
    both = common.materialize(both, "spans")
    tables.drop("repeated", "found")
    return both


def covered(spans: list[dict], window: int) -> list[tuple[int, int]]:
    """Maximal runs of units that lie in windows starting in the spans."""
    out: list[list[int]] = []
    for b, e in sorted((x["b"], x["e"] - 1 + window) for x in spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def with_spans(docs: DataFrame, unit: str, window: int, gram: int, compare=None) -> DataFrame:
    """keyed() docs with spans (null where nothing repeats)."""
    return docs.join(repeated_windows(docs, unit, window, gram, compare), ["k1", "k2"], "left")
