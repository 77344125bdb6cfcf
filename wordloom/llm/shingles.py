"""Near-duplicates by similarity of word shingles: shared shingles propose, the shingle sets decide.

Texts of Jaccard similarity `least` or more share one of the first n - ceil(least * n) + 1 shingles of
their n, in any order that is the same for all texts. So texts meet in a bucket for each shingle of that prefix. The
order is by hash, but shingles found in very many prefixes come last (at most HOT of them, the most
frequent, go out with the tasks; any choice of them keeps the rule above true), which keeps passages
that many texts share out of the prefixes. In a bucket, pairs are candidates if their lengths allow the
similarity, and if the shingles from the bucket's on, in the order, are enough for it in both: a pair meets
in the bucket of the first shingle that it shares, where no more than those can be shared. Candidates
are verified on their whole sets. All counts are of distinct shingles, so how often a text repeats a
line is of no account.

A bucket over WIDE texts goes in two rounds. First each text proposes NEAREST neighbours in two
orders of the SimHashes, which ties groups of copies together. Then, over the components that the
verified pairs make, such a bucket gives every candidate pair between different components; pairs
within one can't change the result. In those rounds rows carry parities: bit b tells if an odd number of
the set's shingles fall on b. Two sets' parities differ in at most as many bits as there are shingles in just
one of the sets, so a pair that differs in more bits than the similarity allows is no candidate.

No test before the verification drops a pair that is similar enough.

With a radius, texts that simhash.py links by fingerprints within it (its balls, its distances) are one group, too: the
edges of both ways make the components. Links weigh repeats and shingles of three words, so neither way finds all that the other does.

Texts are known by XXH64, so copies are one text. A second hash tells texts apart that the first takes
for one: the one with the least second hash is compared with others, the rest stay, each with its copies as a
group of its own. So a collision may leave a near-duplicate in, but drops no document.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

WORDS = 5
LEAST = 0.8
WIDE = 64
NEAREST = 4
HOT = 500_000
OFTEN = 512
PARITIES = 4096
FOLDED = 512
PASSES = 4


def parities(shingles: np.ndarray, size: int = PARITIES) -> bytes:
    """A bit for each of `size` places: whether an odd number of the shingles fall on it."""
    odd = np.bincount((shingles % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def order_key(shingles: np.ndarray, piece: int = 100_000) -> int:
    """The SimHash of a set of shingles."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(shingles), piece):
        ones += np.unpackbits(shingles[a : a + piece].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(">i8")[0])


def _sketches(words: int):
    def run(batches):
        for batch in (x for b in batches for x in common.slices(b, "text", most=1 << 20)):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            own = [pa.array([order_key(s) for s in sets], pa.int64()), pa.array([parities(s, FOLDED) for s in sets], pa.binary()), pa.array([parities(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *own], names=["k", "fp", "folded", "parities"])

    return run


def shingle_set(text: str | None, words: int) -> np.ndarray:
    d = simhash.shingle_digests(text, words)
    return np.unique(np.frombuffer(b"".join(d), ">u8").astype(np.uint64))


def prefix_size(n: int, least: float) -> int:
    return n - int(np.ceil(round(least * n, 9))) + 1 if n else 0


def _prefixes(words: int, least: float, hot: np.ndarray):
    def run(batches):
        for batch in (x for b in batches for x in common.slices(b, "text", most=1 << 20)):
            seen: dict[int, str] = {}
            for k, t in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(k, t)
            keys, texts = list(seen), list(seen.values())
            h, k, n, p = [], [], [], []
            for i, t in enumerate(texts):
                s = shingle_set(t, words)
                if not len(s):
                    continue
                if len(hot):
                    late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                own = s[: prefix_size(len(s), least)]
                h.append(own)
                k.append(np.full(len(own), keys[i], np.int64))
                n.append(np.full(len(own), len(s), np.int32))
                p.append(np.arange(len(own), dtype=np.int32))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(k)), pa.array(np.concatenate(n)), pa.array(np.concatenate(p))], names=["h", "k", "n", "p"])

    return run


def _propose(least: float):
    """All candidate pairs of narrow buckets."""

    def pairs(h, k, n, p):
        i, j = np.triu_indices(len(k), 1)
        return _possible(k, n, p, i, j, least)

    return _by_bucket(pairs)


def _neighbours(least: float):
    """First round of wide buckets: candidate pairs of neighbours."""

    def pairs(h, k, n, p, f, folded):
        out = []
        for turned in (f, (f << np.uint64(32)) | (f >> np.uint64(32))):
            order = np.argsort(turned, kind="stable")
            for d in range(1, NEAREST + 1):
                i, j = order[:-d], order[d:]
                like = _parities_allow(folded, n, i, j, least)
                out.append(_possible(k, n, p, i[like], j[like], least))
        return np.concatenate(out)

    return _by_bucket(pairs)


def _across(least: float, block: int = 500_000):
    """Second round of wide buckets: the candidate pairs between different components."""

    def pairs(h, k, n, p, root, bits):
        roots, at, count = np.unique(root, return_inverse=True, return_counts=True)
        if len(roots) == 1:
            return np.empty((0, 2), np.int64)
        rest = np.flatnonzero(at != np.argmax(count))  # every such pair has an end outside the largest component
        out = []
        step = max(1, block // len(k))
        for a in range(0, len(rest), step):
            own = rest[a : a + step]
            i, j = np.nonzero((at[own, None] != at[None, :]) & _room(n, p, own[:, None], np.arange(len(k))[None, :], least))
            i = own[i]
            for c in range(0, len(i), 20_000):
                x, y = i[c : c + 20_000], j[c : c + 20_000]
                for places in (8, bits.shape[1]):  # a part of the bits first; fewer differ there than in all
                    like = _parities_allow(bits[:, :places], n, x, y, least)
                    x, y = x[like], y[like]
                out.append(np.unique(_possible(k, n, p, x, y, least), axis=0))
        return np.unique(np.concatenate([np.empty((0, 2), np.int64), *out]), axis=0)

    return _by_bucket(pairs, 50_000)


def _room(n, p, i, j, least: float) -> np.ndarray:
    """Whether the lengths, and what is left of both sets from the bucket's shingle on, allow the similarity."""
    lengths = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-6
    return lengths & (np.minimum(n[i] - p[i], n[j] - p[j]) * (1 + least) >= least * (n[i] + n[j]) - 1e-6)


def _parities_allow(bits, n, i, j, least: float) -> np.ndarray:
    """Whether the parities differ in no more bits than shingles may be in just one of two sets so similar."""
    return np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) * (1 + least) <= (1 - least) * (n[i] + n[j]) + 1e-6


def _possible(k, n, p, i, j, least: float) -> np.ndarray:
    ok = _room(n, p, i, j, least)
    a, b = k[i[ok]], k[j[ok]]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)


def _by_bucket(pairs, limit: int = 200_000):
    """Distinct pairs of the buckets of rows (h, k, n, p, more) that come sorted by h and k."""

    def column(c, name):
        if name in ("folded", "parities"):
            size = FOLDED if name == "folded" else PARITIES
            return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), size // 64)
        v = c.to_numpy(zero_copy_only=False)
        return v.view(np.uint64) if name == "fp" else v.astype(np.int64)

    def solve(held):
        h, k = held[:2]
        once = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(k) != 0)])
        held = [x[once] for x in held]
        h = held[0]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1, [len(h)]])
        found = [pairs(*(x[a:b] for x in held)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b - a > 1]
        found = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            new = [column(c, name) for c, name in zip(batch.columns, batch.schema.names, strict=True)]
            held = [np.concatenate([u, v]) for u, v in zip(held, new, strict=True)] if held else new
            h = held[0]
            if len(h) > limit and h[0] != h[-1]:
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1
                yield solve([u[:cut] for u in held])
                held = [u[cut:] for u in held]
        if held and len(held[0]):
            yield solve(held)

    return run


def _verify(words: int, least: float):
    def run(batches):
        for batch in (x for y in batches for x in common.slices(y, "ta", "tb", most=1 << 20)):
            a, b, s, t = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            ok = []
            last: tuple = (None, None)
            for x, y in zip(s, t, strict=True):
                if last[0] != x:
                    last = (x, shingle_set(x, words))
                p, q = last[1], shingle_set(y, words)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= least * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array([v for v, o in zip(a, ok, strict=True) if o], pa.int64()), pa.array([v for v, o in zip(b, ok, strict=True) if o], pa.int64())], names=["a", "b"])

    return run


def _verified(tables: common.Scratch, pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those pairs (a, b) whose shingle sets are as similar as that; written."""
    pairs = tables.write(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    some = texts.join(wanted, "k", "left_semi").groupBy("k").agg(F.min("text").alias("text"))
    some = tables.write(some, "texts")
    tables.drop()
    found = []
    for n in range(PASSES):  # of the pairs with their texts, one pass's share is on disk at a time
        own = pairs.where(F.pmod(F.xxhash64("a"), F.lit(PASSES)) == n)
        both = own.join(some.select(F.col("k").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("k").alias("b"), F.col("text").alias("tb")), "b")
        found.append(tables.write(both.select("a", "b", "ta", "tb").mapInArrow(_verify(words, least), "a long, b long"), "edges"))
        tables.drop()
    edges = reduce(DataFrame.union, found)
    tables.drop("pairs", "texts")
    return edges


def _fingerprints(batches):
    for batch in (x for b in batches for x in common.slices(b, "text", most=1 << 20)):
        fp = simhash.fingerprints(batch.column("text").to_pylist(), 3).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("k2"), pa.array(fp)], names=["k", "k2", "fp"])  # no texts go back


def _fingerprint_edges(tables: common.Scratch, texts: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that tie together the texts (k, k2, text) whose fingerprints are linked, directly or through others; written."""
    own = texts.mapInArrow(_fingerprints, "k long, k2 long, fp long").groupBy("k").agg(F.min_by("fp", "k2").alias("fp"))  # of keys that collide, the text that is compared
    own = tables.write(own, "fingerprints")
    tables.drop()
    groups = tables.write(own.groupBy("fp").agg(F.min("k").alias("least")), "groups")
    links = simhash.links(groups.select("fp"), radius)
    named = lambda c: groups.select(F.col("fp").alias(c), F.col("least").alias(f"k{c}"))
    across = links.join(named("a"), "a").join(named("b"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    edges = own.join(groups, "fp").select(F.col("k").alias("a"), F.col("least").alias("b")).where("a != b").union(across)
    edges = tables.write(edges, "linked")
    tables.drop("fingerprints", "groups")
    return edges


def _key(text):
    """What texts are known by, as a Column."""
    return F.xxhash64(text)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, radius: int | None = None) -> DataFrame:
    """Of each group of near-duplicates the row with the least doc_id; the columns of docs.

    Groups are what verified pairs connect and, with a radius, links of fingerprints within it. Texts without words are copies of each other; texts of
    fewer words than a shingle are compared whole. Of repeated rows with the least id one stays. A
    null doc_id is the largest. Empty tables give empty results. Columns of docs may have any names
    but those that begin with two underscores.
    """
    tables = common.Scratch(docs.sparkSession)
    bare = F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.col(text)).otherwise("")
    keyed = docs.withColumn("__k", _key(bare)).withColumn("__k2", F.xxhash64(F.lit(1), bare))  # another seed
    texts = keyed.select(F.col("__k").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    linked = None if radius is None else _fingerprint_edges(tables, keyed.select(F.col("__k").alias("k"), F.col("__k2").alias("k2"), F.coalesce(F.col(text), F.lit("")).alias("text")), radius)
    schema = "h long, k long, n int, p int"
    often = texts.mapInArrow(_prefixes(words, least, np.empty(0, np.uint64)), schema).groupBy("h").count().where(F.col("count") > OFTEN)
    rows = often.orderBy(F.desc("count"), "h").limit(HOT).collect()  # HOT rows at most
    hot = np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))
    tables.drop()
    marked = texts.mapInArrow(_prefixes(words, least, hot), schema).selectExpr("*", "count(1) over (partition by h) as m").where("m > 1")
    marked = tables.write(marked, "prefixes")
    tables.drop()
    pair = "a long, b long"
    narrow = marked.where(F.col("m") <= WIDE).select("h", "k", "n", "p").repartition("h").sortWithinPartitions("h", "k")
    wide = tables.write(marked.where(F.col("m") > WIDE).select("h", "k", "n", "p"), "wide")
    own = texts.join(wide.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.min("text").alias("text"))
    own = tables.write(own.mapInArrow(_sketches(words), "k long, fp long, folded binary, parities binary"), "sketches")
    tables.drop()
    first = wide.join(own, "k").select("h", "k", "n", "p", "fp", "folded").repartition("h").sortWithinPartitions("h", "k")
    near = narrow.mapInArrow(_propose(least), pair).union(first.mapInArrow(_neighbours(least), pair))
    near = tables.write(near.distinct(), "near")
    tables.drop("prefixes")
    edges = _verified(tables, near, texts, words, least)
    edges = edges if linked is None else edges.union(linked)
    root = tables.write(components(edges), "root")
    tables.drop("near", "linked")
    own = own.join(root, F.col("k") == F.col("node"), "left").select("k", "parities", F.coalesce("root", "k").alias("root"))
    second = wide.join(own, "k").select("h", "k", "n", "p", "root", "parities").repartition("h").sortWithinPartitions("h", "k")
    more = _verified(tables, second.mapInArrow(_across(least), "a long, b long").distinct(), texts, words, least)
    tables.drop("wide", "sketches")
    if not more.isEmpty():
        root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    ids = keyed.groupBy("__k", "__k2").agg(F.min(doc_id).alias("id"))
    ids = ids.withColumn("turn", F.row_number().over(W.partitionBy("__k").orderBy("__k2")))  # a row a text, so one but for collisions
    apart = F.when(F.col("turn") > 1, F.col("__k2")).alias("apart")
    ids = ids.join(root, F.col("__k") == F.col("node"), "left").select("__k", "__k2", "id", apart, F.coalesce("root", "__k").alias("root"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("__k"), F.col("__k2"))
    kept = ids.groupBy("root", "apart").agg(F.min(order).alias("x")).select(F.col("x.id").alias("__id"), F.col("x.__k").alias("__key"), F.col("x.__k2").alias("__key2"))
    kept = common.materialize(kept, "kept")
    tables.drop("edges", "root")
    same = (F.col("__k") == F.col("__key")) & (F.col("__k2") == F.col("__key2")) & F.col(doc_id).eqNullSafe(F.col("__id"))
    return keyed.join(kept, same, "left_semi").dropDuplicates([doc_id, "__k", "__k2"]).select(*docs.columns)
