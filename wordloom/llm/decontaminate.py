"""Benchmark decontamination with an FM-index over each training shard.

Every task cuts its documents into shards of bounded size. A shard's words become symbols of the
benchmark's vocabulary; words outside it can't lie in an occurrence of a test phrase and end a
segment, as do document ends, and segments shorter than the shortest phrase can't hold one, so only
the others are indexed (this is exact). The index is a Burrows-Wheeler transform with a wavelet
matrix for ranks and a sampled suffix array. All test phrases are searched backwards at once,
occurrences are located by walking to the next sampled suffix, and overlapping ones merge into
removal spans.

The test phrases go out with the tasks. A pass takes at most `max_phrases` of them, which bounds
what is sent; more phrases are dealt over several narrow passes, each adding to the spans so far.

Defined cases: a null or empty text has no words, no spans, and isn't contaminated; a null or empty
item has no phrases; a null item_id is the empty string, and items of equal ids are one; items with
equal texts are all reported; repeated rows are treated one by one; empty tables give empty results;
columns named like new ones are replaced, and only names that begin with two underscores are reserved.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
MAX_PHRASES = 500_000
SHARD_WORDS = 4_000_000
SAMPLE = 8

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytearray(b" " * 256)
for _b in _KEEP:
    _FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    _FOLD[_b] = _b + 32
_FOLD = bytes(_FOLD)


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8: runs of ASCII letters (lower-cased), digits and all non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def word_spans(text: str) -> tuple[list[int], list[int]]:
    """Start and end of every word in code points."""
    starts, ends, inside = [], [], False
    for i, c in enumerate(text):
        ok = c >= "\x80" or c.isalnum()
        if ok != inside:
            (starts if ok else ends).append(i)
            inside = ok
    if inside:
        ends.append(len(text))
    return starts, ends


class FMIndex:
    """Counts and locates phrases in a sequence of symbols 1..m; 0 is kept for the end."""

    def __init__(self, seq: np.ndarray, symbols: int):
        s = np.append(seq, 0).astype(np.int64)
        n = self.n = len(s)
        rank, k = s.copy(), 1
        while True:  # prefix doubling, up to distinct ranks
            shifted = np.zeros(n, np.int64)
            shifted[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (n + symbols + 2) + shifted
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, np.int64)
            fresh[0] = 0
            np.cumsum(np.diff(key[order]) != 0, out=fresh[1:])
            rank[order] = fresh
            if fresh[-1] == n - 1 or k >= n:
                break
            k *= 2
        bwt = s[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols + 1))])
        self.marked = order % SAMPLE == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = order[self.marked]
        self.levels, current = [], bwt
        for bit in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            one = (current >> bit) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            zeros = n - int(ones[-1])
            self.levels.append((bit, ones, zeros))
            current = np.concatenate([current[one == 0], current[one == 1]])
        first = np.full(symbols + 1, n, np.int64)  # where each symbol's block starts on the last level
        seen, at = np.unique(current, return_index=True)
        first[seen] = at
        self.first = first

    def rank(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position of the transform."""
        for bit, ones, zeros in self.levels:
            up = ones[pos]
            pos = np.where((symbol >> bit) & 1, zeros + up, pos - up)
        return pos - np.minimum(self.first[symbol], pos)

    def step(self, pos: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one to the left."""
        symbol = np.zeros(len(pos), np.int64)
        start = pos
        for bit, ones, zeros in self.levels:
            up = ones[pos]
            one = ones[pos + 1] - up
            symbol |= one.astype(np.int64) << bit
            pos = np.where(one == 1, zeros + up, pos - up)
        del start
        return self.starts[symbol] + pos - self.first[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of phrases of one length, all searched backwards together."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j]
            lo = self.starts[c] + self.rank(c, lo)
            hi = np.maximum(lo, self.starts[c] + self.rank(c, hi))
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows, by steps to the left until a sampled suffix."""
        out = np.full(len(rows), -1, np.int64)
        open_, row, walked = np.arange(len(rows)), rows, 0
        while len(open_):
            hit = self.marked[row]
            out[open_[hit]] = self.samples[self.mark_rank[row[hit]]] + walked
            open_, row = open_[~hit], row[~hit]
            if len(row):
                row = self.step(row)
                walked += 1
        return out


class Phrases:
    """Test phrases of some items as symbols, with the items that each belongs to."""

    def __init__(self, pairs: list[tuple[str, tuple[bytes, ...]]]):
        self.items = sorted({i for i, _ in pairs})
        at = {x: k for k, x in enumerate(self.items)}
        owners: dict[tuple[bytes, ...], set[int]] = {}
        for i, phrase in pairs:
            owners.setdefault(phrase, set()).add(at[i])
        self.symbol = {w: k + 2 for k, w in enumerate(sorted({w for p in owners for w in p}))}
        self.by_length = []
        for n in sorted({len(p) for p in owners}):
            own = sorted(p for p in owners if len(p) == n)
            codes = np.array([[self.symbol[w] for w in p] for p in own], np.int64)
            self.by_length.append((n, codes, [sorted(owners[p]) for p in own]))
        self.shortest = min((n for n, _, _ in self.by_length), default=0)


def phrases_of(item: str, text: str | None) -> list[tuple[str, tuple[bytes, ...]]]:
    w = words(text)
    if len(w) < WINDOW:
        return [(item, tuple(w))] if w else []
    return [(item, tuple(w[i : i + WINDOW])) for i in range(len(w) - WINDOW + 1)]


def scan(texts: list[str | None], p: Phrases) -> list[tuple[int, set[int], list[tuple[int, int]]]]:
    """For each text: number of words, items found, merged spans of word numbers (end exclusive)."""
    out = []
    shard: list[list[int]] = []
    size = 0
    get = p.symbol.get
    for text in texts:
        codes = [get(w, 0) for w in words(text)]
        shard.append(codes)
        size += len(codes)
        if size >= SHARD_WORDS:
            out += _scan_shard(shard, p)
            shard, size = [], 0
    return out + (_scan_shard(shard, p) if shard else [])


def _scan_shard(shard: list[list[int]], p: Phrases) -> list[tuple[int, set[int], list[tuple[int, int]]]]:
    lengths = np.array([len(x) for x in shard], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])  # one separator after each document
    flat = np.fromiter(chain.from_iterable(chain(x, (0,)) for x in shard), np.int64, int(begins[-1]))
    out = [(int(n), set(), []) for n in lengths]
    if not p.shortest:
        return out
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (flat != 0).astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    long = last - first >= p.shortest
    first, last = first[long], last[long]
    if not len(first):
        return out
    size = last - first + 1  # with a separator
    at = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(first - at[:-1], size) + np.arange(at[-1])
    seq = flat[where]
    seq[at[1:] - 1] = 1
    index = FMIndex(seq, len(p.symbol) + 1)
    spans: list[tuple[np.ndarray, int]] = []
    for n, codes, owners in p.by_length:
        lo, hi = index.search(codes)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        counts = (hi - lo)[found]
        rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        pos = where[index.locate(rows)]
        doc = np.searchsorted(begins, pos, side="right") - 1
        which = np.repeat(found, counts)
        for d, k in np.unique(np.stack([doc, which], 1), axis=0):
            out[d][1].update(owners[k])
        spans.append((pos, n))
    if spans:
        change = np.zeros(len(flat) + 1, np.int32)
        for pos, n in spans:
            np.add.at(change, pos, 1)
            np.add.at(change, pos + n, -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            d = int(np.searchsorted(begins, a, side="right")) - 1
            out[d][2].append((int(a - begins[d]), int(b - begins[d])))
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", _SPANS)]
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(df: DataFrame, pairs: list, text: str, again: bool, cut: str | None = None) -> DataFrame:
    """cut: a column for the texts without their spans so far."""
    phrases = Phrases(pairs)

    def work(batch):
        found = scan(batch.column(text).to_pylist(), phrases)
        items = [sorted(phrases.items[i] for i in f[1]) for f in found]
        spans = [f[2] for f in found]
        if again:
            items = [sorted({*a, *b}) for a, b in zip(items, batch.column("__hit_items").to_pylist(), strict=True)]
            old = batch.column("__hit_spans").to_pylist()
            spans = [merge([*a, *((x["start"], x["end"]) for x in b)]) for a, b in zip(spans, old, strict=True)]
        out = [
            pa.array([f[0] for f in found], pa.int64()),
            pa.array(items, pa.list_(pa.string())),
            pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _ARROW_SPANS),
        ]
        if cut:
            out.append(pa.array([_without(t, s) if s else t for t, s in zip(batch.column(text).to_pylist(), spans, strict=True)], pa.string()))
        return out

    if again:
        df = df.withColumnsRenamed({"hit_items": "__hit_items", "hit_spans": "__hit_spans"})
    fields = [*FIELDS, *([T.StructField(cut, T.StringType())] if cut else [])]
    return common.append_arrow(df, work, fields, text).drop("__hit_items", "__hit_spans")


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", cut: str | None = None, max_phrases: int = MAX_PHRASES) -> DataFrame:
    """docs with n_words, hit_items (sorted) and hit_spans (merged, in word numbers, end exclusive).

    cut: the name of another column, the texts without their hit spans.

    Test items reach the driver one partition at a time, and a pass sends max_phrases of their phrases.
    """
    pairs: list = []
    out, passes = docs, 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    for row in rows.toLocalIterator():
        pairs += phrases_of(row.i, row.t)
        while len(pairs) >= max_phrases:
            out, pairs, passes = _pass(out, pairs[:max_phrases], text, passes > 0), pairs[max_phrases:], passes + 1
    return _pass(out, pairs, text, passes > 0, cut) if pairs or not passes or cut else out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    starts, ends = word_spans(text)
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : starts[a]])
        at = ends[b - 1]
    return "".join([*kept, text[at:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """docs with the hit spans cut out of the texts, and n_words, hit_items and hit_spans; texts without hits stay as they are."""
    found = find_hits(docs, benchmark, text, cut="__without_hits", **more)
    return found.select(*[F.col("__without_hits").alias(text) if c == text else c for c in found.columns if c != "__without_hits"])


def op1_decontaminate(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (select doc_id, {_WORDS.format("text")} as w from documents),
i as (select coalesce(item_id::varchar, '') as item, {_WORDS.format("text")} as w from benchmark),
win as (select item, n, array_to_string(w[k:k + n - 1], ' ') as gram
  from (select item, w, least(len(w), {WINDOW}) as n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as k from i where len(w) > 0)),
sizes as (select distinct n from win),
spot as (select doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') as gram from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as pos from d cross join sizes where len(w) >= n)),
hit as (select doc_id, pos, spot.n, item from spot join win on win.n = spot.n and win.gram = spot.gram),
cover as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(pos, pos + n)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover using (doc_id) left join items using (doc_id)
"""
