"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the table's slots, given by an offset and a skip from two hashes
of its name. Shards take turns; each claims the next slot of its order that is free, until the
table, whose size is a prime well above the number of shards, is full. So shards hold equally many
slots, give or take one, and few slots move when a shard comes or goes. A row's slot is a hash of
its key modulo the size, and the table, of a fixed size, goes out with the tasks: placement is one
look-up, with no shuffle.

Defined cases: a null key is placed like the empty string; equal keys go to the same shard; empty
tables give empty results; columns named slot or shard are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SLOTS = 65537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that claimed it."""
    if not _is_prime(slots) or len(shards) * 100 > slots:
        raise ValueError("the number of slots must be a prime and at least 100 times that of shards")
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need distinct names")
    h = lambda kind, s: int.from_bytes(hashlib.sha256(f"{kind}:{s}".encode()).digest()[:8], "big")
    turn = sorted(range(len(shards)), key=lambda k: shards[k])
    at = [h("offset", s) % slots for s in shards]
    skip = [h("skip", s) % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in turn:
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key, slots: int = SLOTS):
    """60 bits of the MD5 of the key as text, modulo the number of slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with slot and shard. The table has `slots` rows whatever the input: it is broadcast."""
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(fill(shards, slots))), "slot_ long, n_ int")
    names = F.array(*[F.lit(s) for s in shards])
    rows = docs.select(F.struct(*docs.columns).alias("row"), slot_of(F.col(key), slots).alias("slot"))
    found = rows.join(F.broadcast(table), F.col("slot") == F.col("slot_"), "left")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("slot", "shard")]
    return found.select(*kept, "slot", F.element_at(names, F.col("n_") + 1).alias("shard"))


def op6_shard(spark, sf_dir):
    return place(common.table(spark, sf_dir, "documents").select("doc_id"))
