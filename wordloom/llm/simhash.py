"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits, and links reach RADIUS = 3. Every fingerprint emits all its variants within
half the radius: all fingerprints those at one bit and itself (rounded down), and those with an odd number of
ones also variants at two bits (rounded up). Two fingerprints at one or two bits meet in the middle by the former. Of two
at three bits one has an odd number of ones; two of the three bits lie in the same half of the 64, and they
meet where this one flips these two and the other the third. So two-bit variants within a half are
enough: 992 instead of 2016.

The shuffle is on the variant, 64 bits that the corpus's size doesn't crowd. A variant's members are
distinct fingerprints of its ball, 1057 at most however many documents there are. If one of them is within one bit, all
the others are within three bits of it: it is the centre, and each other one gets a link to it, which is verified by its
distance. Members at two bits only aren't links by this variant. So there is no comparison of all pairs of a group.

Copies collapse first: only distinct fingerprints take part. Balls, meeting and links are SQL functions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

RADIUS = 3
PASSES = 4
CHUNK = 200_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_digests(text: str | None, size: int) -> list[bytes]:
    """Big-endian XXH64 (seed 42) of each run of `size` words; of the whole if it has fewer."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not w:
        return []
    h = xxhash.xxh64_digest
    line = b" ".join(w)
    if len(w) <= size:
        return [h(line, 42)]
    lengths = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(w) - size + 1].tolist()
    return [h(line[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprints(texts: list[str | None], size: int) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half the shingles' hashes."""
    out = np.zeros((len(texts), 64), bool)
    digests: list[bytes] = []
    owner: list[int] = []
    counts: list[int] = []

    def flush():
        if counts:
            bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).reshape(-1, 64)
            at = np.concatenate([[0], np.cumsum(counts)[:-1]])
            ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
            out[owner] = 2 * ones > np.array(counts)[:, None]
        digests.clear()
        owner.clear()
        counts.clear()

    for i, t in enumerate(texts):
        d = shingle_digests(t, size)
        if len(d) > CHUNK:  # in pieces, since eight bytes become 64
            ones = sum(np.unpackbits(np.frombuffer(b"".join(d[k : k + CHUNK]), np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64) for k in range(0, len(d), CHUNK))
            out[i] = 2 * ones > len(d)
        elif d:
            digests += d
            owner.append(i)
            counts.append(len(d))
            if len(digests) > CHUNK:
                flush()
    flush()
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64)


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = 3, name: str = "fp") -> DataFrame:
    """docs with a long column of fingerprints; null and empty texts have fingerprint zero."""

    def work(batch):
        return [pa.array(fingerprints(batch.column(text).to_pylist(), size).view(np.int64), pa.int64())]

    return common.append_arrow(docs, work, [T.StructField(name, T.LongType())], text)


def _masks(radius: int) -> tuple[list[int], list[int]]:
    """What to flip for variants within half the radius rounded down, and for those that rounding up adds."""
    signed = lambda m: m - (m >> 63 << 64)
    ones = [signed(1 << k) for k in range(64)]
    twos = [signed(1 << j | 1 << k) for half in (range(32), range(32, 64)) for j in half for k in half if j < k]
    return {0: ([0], []), 1: ([0], ones), 2: ([0, *ones], []), 3: ([0, *ones], twos)}[radius]


def links(fps: DataFrame, radius: int = RADIUS, variants_a_task: int = 4_000_000, passes: int = PASSES) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to connect all within the radius; written.

    Variants are dealt over passes by their hash, so that no more than a pass's share of them is on disk at a time.
    """
    if not 0 <= radius <= 3:
        raise ValueError("a radius from 0 to 3 is expected")
    near, far = _masks(radius)
    tasks = -(-fps.count() * (len(near) + len(far)) // variants_a_task // passes)
    own = fps.select("fp").repartition(min(max(1, tasks), 20_000))  # a few bytes a row become many rows
    mask = F.when(F.bit_count("fp") % 2 == 1, F.lit([*near, *far])).otherwise(F.lit(near))
    every = own.select("fp", F.explode(mask).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    distance = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    centre = F.min(F.when(distance("fp", "variant") <= radius // 2, F.col("fp"))).over(W.partitionBy("variant"))
    tables = common.Scratch(fps.sparkSession)
    found = []
    for k in range(passes):
        met = every.where(F.pmod(F.xxhash64("variant"), F.lit(passes)) == k).withColumn("centre", centre)
        met = met.where((F.col("fp") != F.col("centre")) & (distance("fp", "centre") <= radius))
        found.append(tables.write(met.select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct(), "links"))
        tables.drop()
    return reduce(DataFrame.union, found)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, root, component_id): documents linked by fingerprints within radius, directly or through others.

    component_id is the least doc_id of the component. Null and empty texts have fingerprint zero and
    link like any other; repeated rows stay; a null doc_id gets its component's id and never names it.
    """
    own = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", size).drop("text")
    own = common.materialize(own, "fingerprints")
    tables = common.Scratch(docs.sparkSession)
    fps = tables.write(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(fps.select("fp"), radius))
    member = fps.join(root, fps.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    known = common.materialize(member.join(named, "root").select("fp", "root", "component_id"), "known")
    tables.drop("distinct")
    return own.join(known, "fp").select("doc_id", "fp", "root", "component_id")


def op9_simhash(spark, sf_dir):
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
