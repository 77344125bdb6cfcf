"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each round is written to the shared folder, so a lost executor costs no more than its round. Minima
are pre-aggregated before the shuffle and written, so that the joins that spread them have an exchange alone on
either side and one row per node on one: adaptive execution may split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the component's least node.

    Loops, repeated edges and edges in either direction are fine; rows with a null end are ignored;
    no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tables = common.Scratch(edges.sparkSession)
    e = tables.write(e, "0")
    before = _digest(e)
    for k in range(1, MAX_ROUNDS + 1):
        both = e.union(e.select("b", "a"))
        least = tables.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = tables.write(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        after = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        e = tables.write(after, str(k))
        now = _digest(e)
        tables.drop(str(k - 1), "least")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
