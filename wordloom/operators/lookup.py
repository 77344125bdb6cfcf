"""Sums over counts whose grams are looked up in a table of weights.

Most tokens are of few grams. The most frequent grams of the table, LIMIT values at most, are broadcast, and what they give is
summed where the counts are made; only the counts of other grams are sent to the rest of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

LIMIT = 800_000


def summed(counts: DataFrame, table: DataFrame, on: list[str], keys: list[str], sums: dict[str, Column], width: int = 1, limit: int | None = None) -> DataFrame:
    """(keys, a column for each of sums): sums over counts, left joined on `on` with table.

    table: one row a gram, with freq, how often it came, by which the broadcast ones are chosen; width: its values a gram.
    counts: (keys, ..., cnt), one row for each value of the others.
    """
    names = list(sums)
    table = written(table)
    size = F.floor(8 * F.log2(F.greatest(F.col("freq"), F.lit(1))))
    found = sorted(table.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["size"])  # 512 rows at most
    room, least = (LIMIT if limit is None else limit) // max(width, 4), None
    for r in found:
        room -= r.n
        if room < 0:
            break
        least = r["size"]
    if not found or room >= 0:
        return counts.join(F.broadcast(table.drop("freq")), on, "left").groupBy(*keys).agg(*[F.sum(sums[k]).alias(k) for k in names])
    often = F.lit(False) if least is None else size >= least
    known = counts.join(F.broadcast(table.where(often).drop("freq").withColumn("found_", F.lit(True))), on, "left")  # bounded by the limit
    own = [c for c in counts.columns if c not in keys and c != "cnt"]
    rare = F.when(F.col("found_").isNull(), F.struct(*own)).alias("rare_")
    first = written(known.groupBy(*keys, rare).agg(*[F.sum(F.when(F.col("found_"), sums[k])).alias(k) for k in names], F.sum("cnt").alias("cnt_")))
    rest = first.where("rare_ is not null").select(*keys, *[F.col("rare_")[c].alias(c) for c in own], F.col("cnt_").alias("cnt"))
    rest = rest.join(table.where(~often).drop("freq"), on, "left").groupBy(*keys).agg(*[F.sum(sums[k]).alias(k) for k in names])
    return first.where("rare_ is null").select(*keys, *names).unionByName(rest).groupBy(*keys).agg(*[F.sum(k).alias(k) for k in names])
