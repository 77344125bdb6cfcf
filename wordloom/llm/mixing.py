"""Mixing sources to target weights by a low-discrepancy source schedule.

A source's target, rounded, is its number of words, cut into blocks of `block` words, the last one shorter. As many
slots as there are blocks take golden-ratio points frac((i + 1) / phi), and each the source in whose share of the
cumulative numbers of blocks its point falls; slots are ranked within their source. So any stretch of the
schedule holds the sources in close to the target proportions. A point sequence gives a source its number of
blocks to within a few: slots beyond it are left out, and blocks that found none go to the end.

A source's documents, shuffled by a seeded hash, are laid end to end; the line starts over when it
ends, up to `max_repeat` times. It is cut into blocks, and the block of number r is joined to the source's slot of rank r. What
is taken of a document is the sum of its pieces in blocks that have a slot. Reruns agree.

Running sums and ranks are two-level (within a bucket, plus the bucket's offset), and joins are on
(source, block), so a source that holds a third of all rows is spread over many tasks. Only DataFrame and SQL functions are used.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its
own, the last; repeated rows each count; a source of no words has target 0; empty tables give empty
results. Targets of sources beyond what repeats allow are held at max_repeat times their size. Columns named like
new ones are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BLOCK = 1024
MAX_REPEAT = 3
CELLS = 256
STRETCH = 65536
ROWS_A_BUCKET = 250_000
PHI = 0.6180339887498949


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Weights are 1, 2, 3, repeating, by the sources' order. Sources are held at max_repeat times
    their size in the order of size / weight: the share per weight, (total - held) / weights left,
    only grows as sources are held, so a source is held if its limit per weight is not above the
    share at its place in that order.
    """
    least_first = W.partitionBy("one").orderBy(F.col("limit_per_weight"), F.col("place"))
    before = least_first.rowsBetween(W.unboundedPreceding, -1)
    s = sizes.withColumn("one", F.lit(1))
    s = s.withColumn("place", F.row_number().over(W.partitionBy("one").orderBy(F.col("source").isNull(), F.col("source"))))
    s = s.withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("double")).withColumn("limit", F.col("source_size") * float(max_repeat))
    s = s.withColumn("limit_per_weight", F.col("limit") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(W.partitionBy("one")).cast("double")).withColumn("weights", F.sum("weight").over(W.partitionBy("one")))
    held = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    gone = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("share", (F.col("total") - held) / (F.col("weights") - gone))
    s = s.withColumn("is_held", F.col("limit_per_weight") < F.col("share"))
    free_weight = F.sum(F.when(~F.col("is_held"), F.col("weight")).otherwise(0.0)).over(W.partitionBy("one"))
    held_size = F.sum(F.when(F.col("is_held"), F.col("limit")).otherwise(0.0)).over(W.partitionBy("one"))
    s = s.withColumn("target", F.when(F.col("is_held"), F.col("limit")).otherwise(F.col("weight") * (F.col("total") - held_size) / free_weight))
    return s.select("source", "source_size", "place", "weight", "target")


def schedule(targets_: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, place, rank): the source of every slot and which of the source's blocks it takes.

    A source has ceil(round(target) / block) blocks, and the schedule a slot for every block of every source.
    """
    spark = targets_.sparkSession
    tables = common.Scratch(spark)
    up_to = W.partitionBy("one").orderBy("place")
    t = targets_.withColumn("blocks", F.ceil(F.round("target") / block).cast("long")).where("blocks > 0").withColumn("one", F.lit(1))
    t = t.withColumn("hi", F.sum("blocks").over(up_to)).withColumn("lo", F.col("hi") - F.col("blocks")).withColumn("all", F.sum("blocks").over(W.partitionBy("one")))
    t = tables.write(t.select("source", "place", "blocks", "lo", "hi", "all"), "shares")
    total = t.agg(F.first("all")).first()[0] or 0
    point = ((F.col("id") + 1) * F.lit(PHI)) % 1.0
    slots = spark.range(total).select("id", (point * total).alias("at"), F.floor(point * CELLS).cast("int").alias("cell"))
    cells = F.sequence(F.floor(F.col("lo") / F.col("all") * CELLS).cast("int"), F.least(F.floor(F.col("hi") / F.col("all") * CELLS), F.lit(CELLS - 1)).cast("int"))
    found = slots.join(t.withColumn("cell", F.explode(cells)), "cell").where("at >= lo and at < hi")
    found = tables.write(found.select("id", "place", "blocks", F.floor(F.col("id") / STRETCH).alias("stretch")), "slots")
    counts = tables.write(found.groupBy("place", "stretch").agg(F.count("*").alias("n")), "counts")
    before = W.partitionBy("place").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select("place", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("place", "stretch").orderBy("id")) - 1
    ranked = found.withColumn("own", own).join(offset, ["place", "stretch"]).withColumn("rank", F.col("before") + F.col("own")).where("rank < blocks").select("id", "place", "rank")
    missing = t.join(counts.groupBy("place").agg(F.sum("n").alias("n")), "place", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks")
    earlier = F.coalesce(F.sum(F.col("blocks") - F.col("n")).over(W.partitionBy("one").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    missing = missing.withColumn("one", F.lit(1)).withColumn("earlier", earlier).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.col("n") - 1)))
    ranked = ranked.union(missing.select((total + F.col("earlier") + F.col("i")).alias("id"), "place", (F.col("n") + F.col("i")).alias("rank")))
    ranked = tables.write(ranked.withColumn("stretch", F.floor(F.col("id") / STRETCH)), "ranked")
    first = W.partitionBy("one").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    offset = ranked.groupBy("stretch").agg(F.count("*").alias("n")).withColumn("one", F.lit(1)).select("stretch", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("stretch").orderBy("id")) - 1
    dense = ranked.withColumn("own", own).join(offset, "stretch").select((F.col("before") + F.col("own")).alias("slot"), "place", "rank")
    out = common.materialize(dense.join(t.select("place", "source"), "place").select("slot", "source", "place", "rank"), "schedule")
    tables.drop("shares", "slots", "counts", "ranked")
    return out


def placed(docs: DataFrame, max_repeat: int = MAX_REPEAT, seed: int = 17) -> DataFrame:
    """(row, place, size, start, source, source_size, weight, target, words): docs (doc_id, source, size, ...) as rows, with where
    each lies in its source's shuffled line, and how many words of it are to be taken of the source; written."""
    buckets = 1 << min(20, max(10, (docs.count() // ROWS_A_BUCKET).bit_length()))
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "size", h.alias("h"), F.shiftrightunsigned(h, 65 - buckets.bit_length()).cast("int").alias("bucket"), name.alias("name"))
    per_bucket = common.materialize(rows.groupBy("name", "source", "bucket").agg(F.sum("size").alias("n")), "buckets")
    sizes = targets(per_bucket.groupBy("source").agg(F.sum("n").alias("source_size")), max_repeat)
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    sizes = sizes.withColumn("name", name).withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * max_repeat))
    order = W.partitionBy("name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    known = per_bucket.select("name", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")).join(sizes.drop("source"), "name")
    known = common.materialize(known, "offsets")
    own = F.sum("size").over(W.partitionBy("name", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    found = rows.withColumn("own", F.coalesce(own, F.lit(0))).join(known, ["name", "bucket"]).withColumn("start", F.col("before") + F.col("own"))
    return common.materialize(found.select("row", "place", "size", "start", "source", "source_size", "weight", "target", "words"), "placed")


def deliver(lines: DataFrame, max_repeat: int = MAX_REPEAT, block: int = BLOCK) -> DataFrame:
    """(slot, place, start, first, last) of placed() rows: the pieces of documents, words first to last (exclusive), in each slot's block."""
    plan = schedule(lines.select("source", "place", "target").distinct(), block)
    turn = F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))).alias("turn")
    copies = lines.where("size > 0").select("place", "start", "size", "source_size", "words", turn).withColumn("a", F.col("start") + F.col("source_size") * F.col("turn"))
    copies = copies.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words"))).where("a < b")
    pieces = copies.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    first, last = F.greatest(F.col("a"), F.col("rank") * block) - F.col("a"), F.least(F.col("b"), (F.col("rank") + 1) * block) - F.col("a")
    return pieces.withColumns({"first": first, "last": last}).join(plan.select("slot", "place", "rank"), ["place", "rank"]).select("slot", "place", "start", "first", "last")


def mix(docs: DataFrame, max_repeat: int = MAX_REPEAT, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, source, size, ...) with source_size, target and taken, the words that slots of the schedule take of the document."""
    lines = placed(docs, max_repeat, seed)
    taken = deliver(lines, max_repeat, block).groupBy("place", "start").agg(F.sum(F.col("last") - F.col("first")).alias("n"))
    taken = taken.withColumnsRenamed({"place": "its_place", "start": "its_start"})
    found = lines.join(taken, (F.col("size") > 0) & (F.col("place") == F.col("its_place")) & (F.col("start") == F.col("its_start")), "left")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("source_size", "target", "taken")]
    return found.select(*kept, "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words split at ASCII white space."""
    words = F.regexp_count(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+"))
    return docs.withColumn("size", F.coalesce(words, F.lit(0)).cast("long"))


def op5_mix_sources(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    found = mix(sized(docs).select("doc_id", "source", "size"))
    return found.select("doc_id", "size", "source_size", "target", "taken")
