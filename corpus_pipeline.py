"""A corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with all rows it keeps; each works on
what its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.llm import common, decontaminate, mixing, quality, sharding, shingles, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark, docs, sf_dir):
    """Drop documents that the classifier, learned from the labelled ones, scores under one half."""
    scored = quality.classify(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels"))
    return scored.where("score >= 0.5").select(*COLUMNS)


def near_duplicate_stage(spark, docs, sf_dir):
    """Keep of each group of near-duplicates the document with the least id, and all others whole.

    Groups are what op9's links between fingerprints connect, and pairs of shingle sets of similarity 0.8 or more.
    """
    return shingles.keep_one(docs.select(*COLUMNS), radius=simhash.RADIUS).select(*COLUMNS)


def decontamination_stage(spark, docs, sf_dir):
    """Cut occurrences of test phrases out of texts; texts that lose all their words go."""
    cut = decontaminate.remove_hits(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    cut = cut.withColumn("n_hit", hit).where("n_hit = 0 or n_hit < n_words")
    n = F.when(F.col("n_hit") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n.cast("long")).select(*COLUMNS)


def mixing_stage(spark, docs, sf_dir):
    """Repeat or leave out documents as the schedule's slots take them, to the nearest whole number of times.

    The mix is made of ids and sizes, and its counts are joined back to the documents. Rows that are equal in all
    columns are taken equally often. Null or empty texts have no words and are left out; a null source is one of its own; empty tables give empty results.
    """
    docs = docs.select(*COLUMNS).withColumn("row_hash", F.xxhash64(*COLUMNS))
    mixed = mixing.mix(mixing.sized(docs).select("doc_id", "source", "size", "row_hash"))
    share = F.when(F.sum("size") > 0, F.round(F.sum("taken") / F.sum("size"))).otherwise(0).cast("int")
    times = mixed.groupBy(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash")).agg(share.alias("times")).where("times > 0")
    times = common.materialize(times, "times")
    found = docs.join(times, (F.col("row_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return found.withColumn("copy", F.explode(F.expr("sequence(1, times)"))).select(*COLUMNS)


def sharding_stage(spark, docs, sf_dir):
    """Every row with its slot and shard."""
    return sharding.place(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("sharding", sharding_stage),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, "stage")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {}
