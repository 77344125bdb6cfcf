"""Suffix-array dedup: byte runs that repeat anywhere, by merging Burrows-Wheeler transforms.

Seeds (see repeats.py) leave the stretches of text that share an anchor with different ones. To the
right of its anchor a stretch is a string of blocks of BLOCK bytes; since equal windows have their
anchors at equal places, blocks of equal windows are aligned. A task deals its strings over shards
and builds the Burrows-Wheeler transform of each. The transforms are merged by refining an
interleave: round h reads the transforms in the order of round h - 1 and sorts stably by symbol,
which gives the order by h symbols, and where two neighbours first differ gives their common prefix.
No suffixes are sorted anew. Along the merged order, strings with common prefixes of at least
400 - x bytes are intervals; members of an interval whose x bytes left of the anchor are equal too
have a repeated 400-byte string that starts x bytes before the anchor.

An anchor with very many different stretches has its windows dealt out one by one and counted by
hash (repeats.py), so no task holds an unbounded group.

Defined cases: a null or empty text is empty; texts of fewer than WINDOW bytes are never cut; equal
texts lose all bytes if they have WINDOW or more; repeated rows count as copies; matches don't cross
texts; cut texts may split a character, so what is kept is bytes; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, repeats

WINDOW = 400
GRAM = 32
BLOCK = 8
SHARDS = 4


def stable_order(codes: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative integers, by radix passes of 16 bits."""
    top = int(codes.max()) if len(codes) else 0
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if top >> 16:
        order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Transform:
    """Rows of all rotations of some strings, each closed by a 0, in order; ties stay in input order."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """codes: the strings' symbols (1 or more), end to end; lengths without the closing 0."""
        full = lengths + 1
        self.ends = np.cumsum(full)
        self.begins = self.ends - full
        n = int(self.ends[-1]) if len(full) else 0
        s = np.zeros(n, np.int64)
        s[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = codes
        owner = np.repeat(np.arange(len(full)), full)
        begin, size = self.begins[owner], full[owner]
        place = np.arange(n) - begin
        rank, k, longest = s, 1, int(full.max()) if len(full) else 0
        _, rank = np.unique(s, return_inverse=True)
        while k < longest:
            key = rank * (n + 1) + rank[begin + (place + k) % size]
            _, rank = np.unique(key, return_inverse=True)
            k *= 2
        self.rows = np.argsort(rank, kind="stable")  # the rotation of each row, by where it starts
        self.last = s[begin + (place - 1) % size][self.rows]


def merge(parts: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard and row (within the shard) at each place of the merged order, and common prefixes.

    common[i] is in how many symbols (depth at most) the rotations at i - 1 and i agree; common[0] is 0.
    """
    last = np.concatenate([p.last for p in parts])
    sizes = np.array([len(p.last) for p in parts])
    z = np.repeat(np.arange(len(parts)), sizes).astype(np.uint16)
    n = len(z)
    common_ = np.full(n, depth, np.int64)
    edge = np.zeros(n, bool)
    if n:
        edge[0], common_[0] = True, 0
    for h in range(1, depth + 1):
        where = np.argsort(z, kind="stable")
        symbol = np.empty(n, np.int64)
        symbol[where] = last
        block = np.cumsum(edge)
        order = stable_order(symbol)
        symbol, block = symbol[order], block[order]
        new = np.zeros(n, bool)
        new[:1] = True
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        z = z[order]
        common_[new & ~edge] = h - 1
        settled = bool((new == edge).all())
        edge = new
        if settled:
            break
    where = np.argsort(z, kind="stable")
    row = np.empty(n, np.int64)
    row[where] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return z.astype(np.int64), row, common_


def right_order(contents: list[bytes], anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the contents by what starts at their anchors, and bytes that neighbours have in common."""
    n = len(contents)
    right = [c[o:] for c, o in zip(contents, anchors.tolist(), strict=True)]
    size = np.array([len(x) for x in right])
    blocks = -(-size // BLOCK)
    flat = np.frombuffer(b"".join(x.ljust(-(-len(x) // BLOCK) * BLOCK, b"\0") for x in right), ">u8").astype(np.uint64)
    values, codes = np.unique(flat, return_inverse=True)
    codes = codes + 1
    at = np.concatenate([[0], np.cumsum(blocks)])
    shards = [np.arange(k, n, SHARDS) for k in range(min(SHARDS, n))]
    parts = [Transform(np.concatenate([codes[at[i] : at[i + 1]] for i in own]), blocks[own]) for own in shards]
    z, row, lcp = merge(parts, -(-WINDOW // BLOCK) + 2)
    whole = np.full(len(z), -1, np.int64)  # the content whose anchor starts the rotation at each place
    for k, (own, p) in enumerate(zip(shards, parts, strict=True)):
        start_of = np.full(len(p.last), -1, np.int64)
        start_of[p.begins] = own
        mine = z == k
        whole[mine] = start_of[p.rows[row[mine]]]
    seats = np.flatnonzero(whole >= 0)
    order = whole[seats]
    pairs = np.stack([seats[:-1] + 1, seats[1:] + 1], 1).ravel()  # up to and including the later seat
    agree = np.minimum.reduceat(np.append(lcp, 0), pairs)[::2] if len(pairs) else np.empty(0, np.int64)
    least = np.minimum(size[order[:-1]], size[order[1:]])
    agree = np.minimum(agree, np.minimum(blocks[order[:-1]], blocks[order[1:]]))
    both = agree < np.minimum(blocks[order[:-1]], blocks[order[1:]])
    a, b = np.zeros(len(agree), np.uint64), np.zeros(len(agree), np.uint64)
    a[both] = flat[at[order[:-1]][both] + agree[both]]
    b[both] = flat[at[order[1:]][both] + agree[both]]
    x = a ^ b
    zeros = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        free = (x >> np.uint64(64 - shift)) == 0
        zeros[free] += shift // 8
        x = np.where(free, x << np.uint64(shift), x)
    got = agree * BLOCK + np.where(both, zeros, 0)
    return order, np.minimum(got, least)


def _solve(a, r, c, contents, anchors):
    keep = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(r) != 0)]))
    copies = np.maximum.reduceat(c, keep)
    a, r, anchors = a[keep], r[keep], anchors[keep]
    contents = [contents[i] for i in keep]
    order, agree = right_order(contents, anchors)
    a, r, anchors, copies = a[order], r[order], anchors[order], copies[order]
    contents = [contents[i] for i in order]
    agree = np.where(a[1:] == a[:-1], agree, 0)
    lengths = np.array([len(x) for x in contents])
    windows = lengths - WINDOW + 1
    # hashes of the x bytes before the anchor, from the left end of each content
    h = repeats.Bytes.table[np.frombuffer(b"".join(contents), np.uint8)]
    p, inverse = repeats.prefix(h)
    begin = np.cumsum(lengths) - lengths
    hit: list[tuple[np.ndarray, np.ndarray]] = []
    for x in range(int(anchors.max()) + 1):
        j = anchors - x  # the window that starts x bytes before the anchor
        ok = np.flatnonzero((j >= 0) & (j < windows))
        if not len(ok):
            continue
        interval = np.concatenate([[0], np.cumsum(agree < WINDOW - x)])[ok]
        s = begin[ok] + j[ok]
        left = (p[begin[ok] + anchors[ok]] - p[s]) * inverse[s]
        by = np.lexsort((left, interval))
        same = (left[by][1:] == left[by][:-1]) & (interval[by][1:] == interval[by][:-1])
        dup = copies[ok] > 1
        dup[by[1:][same]] = True
        dup[by[:-1][same]] = True
        hit.append((ok[dup], j[ok[dup]]))
    which = np.concatenate([w for w, _ in hit]) if hit else np.empty(0, np.int64)
    j = np.concatenate([j for _, j in hit]) if hit else np.empty(0, np.int64)
    by = np.lexsort((j, which))
    which, j = which[by], j[by]
    first = np.concatenate([[True], (np.diff(which) != 0) | (np.diff(j) != 1)])[: len(j)]
    final = np.concatenate([first[1:], [True]])[: len(j)]
    return pa.RecordBatch.from_arrays([pa.array(a[which[first]]), pa.array(r[which[first]]), pa.array(j[first].astype(np.int32)), pa.array((j[final] + 1).astype(np.int32))], names=["a", "r", "j", "e"])


def compare(limit: int = 3_000_000):
    """For rows (a, r, c, content, o) sorted by a and r: the repeated windows (a, r, j, e)."""

    def run(batches):
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 4
        x: list[bytes] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                held = [np.concatenate([u, part.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for u, k in zip(held, ("a", "r", "c", "o"), strict=True)]
                new = part.column("content").to_pylist()
                x += new
                size += sum(map(len, new))
                a = held[0]
                if size >= limit and a[0] != a[-1]:
                    cut = int(np.flatnonzero(a != a[-1])[-1]) + 1
                    yield _solve(*(u[:cut] for u in held[:3]), x[:cut], held[3][:cut])
                    held, x = [u[cut:] for u in held], x[cut:]
                    size = sum(map(len, x))
        if len(held[0]):
            yield _solve(*held[:3], x, held[3])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of documents without their repeated strings."""
    return _spans(repeats.keyed(docs, doc_id, text)).mapInArrow(_keep(False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _spans(docs: DataFrame) -> DataFrame:
    return repeats.with_spans(docs, "bytes", WINDOW, GRAM, compare()).select("doc_id", "text", "spans")


def _keep(digest: bool):
    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                runs = repeats.covered(spans or [], WINDOW)
                kept, at = [], 0
                for b, e in runs:
                    kept.append(raw[at:b])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                for col, v in zip(cols, (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest() if digest else kept), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in cols[:3]), pa.array(cols[3], pa.string() if digest else pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


def op8_suffix_dedup(spark, sf_dir):
    found = _spans(repeats.keyed(common.table(spark, sf_dir, "documents")))
    return found.mapInArrow(_keep(True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE_SQL = f"""
with d as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
pieces as (select r, n, s, substr(x, s * 2 + 1, {2 * (1000 + WINDOW - 1)}) as piece from (select *, unnest(range(0, n - {WINDOW - 1}, 1000)) as s from d where n >= {WINDOW})),
starts as (select r, s + k as p, md5(substr(piece, k * 2 + 1, {2 * WINDOW})) as h from (select *, unnest(range(0, least(1000, n - {WINDOW - 1} - s))) as k from pieces)),
twice as (select r, p from (select r, p, count(*) over (partition by h) as c from starts) where c > 1),
marked as (select r, p, case when p - lag(p) over (partition by r order by p) <= {WINDOW} then 0 else 1 end as fresh from twice),
runs as (select r, min(p) as a, max(p) + {WINDOW} as e from (select r, p, sum(fresh) over (partition by r order by p) as k from marked) group by r, k),
gaps as (select r, coalesce(lag(e) over (partition by r order by a), 0) as b, a from runs union all select d.r, coalesce(max(e), 0), n from d left join runs using (r) group by d.r, n),
kept as (select r, string_agg(substr(x, b * 2 + 1, (a - b) * 2), '' order by b, a) as y from gaps join d using (r) group by r),
sums as (select r, sum(e - a)::bigint as gone, count(*)::bigint as n_spans from runs group by r)
select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(y)) as kept_sha256
from d join kept using (r) left join sums using (r)
"""
