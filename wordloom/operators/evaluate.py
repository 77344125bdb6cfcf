"""Ranking of documents against a model, and evaluation of classifiers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import score


def rank_scores(scores: DataFrame, tokens_per_doc: float = 100.0, law: DataFrame | None = None) -> DataFrame:
    """scores of one model with s0 (description length with its length's Poisson cost), s1 (mean), s2 (divergence).

    law: (model, alpha, beta) of fit.gamma_law gives s3, the divergence's p-value in hundredths too.
    """
    n = F.col("complexity").cast("int")
    ln_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, k: a + F.log(k))
    poisson = n * math.log(tokens_per_doc) - tokens_per_doc - ln_factorial
    if law is not None:
        scores = score.p_value(scores, law).withColumn("s3", F.floor(F.col("p_value") / 10)).drop("p_value")
    return scores.withColumn("s0", -F.col("score") - poisson).withColumn("s1", -F.col("score") / F.col("complexity")).withColumn("s2", F.col("div"))


def ranked(scored: DataFrame, by: str = "s1", reverse: bool = False, k: int | None = None, key: str = "doc_id") -> DataFrame:
    """Documents in order; only the first k if asked for."""
    order = F.col(by).desc() if reverse else F.col(by).asc()
    out = scored.orderBy(order, key)
    return out.limit(k) if k else out


def describe(mails: DataFrame, raw: str = "raw") -> DataFrame:
    """mails with description: the sender's first 20 characters in brackets, and 60 of the subject; blanks for line breaks."""
    field = lambda name: F.trim(F.regexp_replace(F.regexp_extract(F.split(F.regexp_replace(raw, "\r\n", "\n"), "\n\n", 2)[0], rf"(?im)^{name}:((?:[^\n]|\n[ \t])*)", 1), r"\s+", " "))
    return mails.withColumn("description", F.concat(F.lit("["), F.substring(field("From"), 1, 20), F.lit("] "), F.substring(field("Subject"), 1, 60)))


def tagged(docs: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with tagged: whether the row's key is among those chosen."""
    own = chosen.select(F.col(key).alias("__key")).distinct().withColumn("__tag", F.lit(True))
    return docs.join(own, F.col(key) == F.col("__key"), "left").withColumn("tagged", F.coalesce("__tag", F.lit(False))).drop("__key", "__tag")


def categorize(docs: DataFrame, best: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write each document to the folder of its best model."""
    docs.join(best.select(key, "best"), key).write.partitionBy("best").mode("append").parquet(path)


def marked(docs: DataFrame, rules: list[tuple[bool, str]], text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """docs with `limited`: whether the last rule (include, pattern) that a line matches includes it; all are, before any rule that includes."""
    flag = F.lit(not any(inc for inc, _ in rules))
    for include, pattern in rules:
        flag = F.when(F.col(text).rlike(("" if case_sensitive else "(?i)") + "(?m)" + pattern), F.lit(include)).otherwise(flag)
    return docs.withColumn("limited", flag)


def fold_of(key: str, k: int):
    """A fold by the hash of the key, the same in every run."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % k).cast("int")


def training_sets(counts: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Counts (..., fold, cnt) of each fold's training set: all the others. By difference from the whole, not by k copies."""
    keys = [c for c in counts.columns if c not in (fold, "cnt")]
    whole = counts.groupBy(*keys).agg(F.sum("cnt").alias("whole"), F.collect_list(F.struct(fold, "cnt")).alias("own"))  # k elements at most
    grid = whole.withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    own = F.aggregate(F.filter("own", lambda x: x[fold] == F.col(fold)), F.lit(0).cast("long"), lambda a, x: a + x["cnt"])
    return grid.select(fold, *keys, (F.col("whole") - own).alias("cnt")).where("cnt > 0")


def confusion(predictions: DataFrame, true: str = "truth", predicted: str = "best") -> DataFrame:
    """(truth, predicted, n, recall, precision) in percent; nulls count as a class of their own."""
    g = predictions.groupBy(F.col(true).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    rows, cols = W.partitionBy("truth"), W.partitionBy("predicted")  # a row a pair of classes
    return g.select("truth", "predicted", "n", (100.0 * F.col("n") / F.sum("n").over(rows)).alias("recall"), (100.0 * F.col("n") / F.sum("n").over(cols)).alias("precision"))


def accuracy(predictions: DataFrame, true: str = "truth", predicted: str = "best") -> DataFrame:
    return predictions.agg(F.count("*").alias("n"), (100.0 * F.avg((F.col(true) == F.col(predicted)).cast("double"))).alias("correct"))


def review(predictions: DataFrame, truth: str, predicted: str, true: str = "truth", best: str = "best") -> DataFrame:
    return predictions.where((F.col(true) == truth) & (F.col(best) == predicted))


def biplot(scores: DataFrame, a: str, b: str, key: str = "doc_id") -> DataFrame:
    """(key, a, b): mean scores a token under two models, and their difference."""
    pick = lambda m: F.max(F.when(F.col("model") == m, -F.col("score") / F.col("complexity")))
    g = scores.groupBy(key).agg(pick(a).alias("a"), pick(b).alias("b"))
    return g.withColumn("difference", F.col("b") - F.col("a"))


def cumulative_errors(predictions: DataFrame, order: str, stretch: int = 65536, true: str = "truth", predicted: str = "best") -> DataFrame:
    """(order, n, errors): running counts along an integer order, from sums of stretches, so that no task holds all rows."""
    p = predictions.select(F.col(order).alias("at"), (~F.col(true).eqNullSafe(F.col(predicted))).cast("long").alias("wrong"))
    p = p.withColumn("stretch", F.floor(F.col("at") / stretch))
    sums = p.groupBy("stretch").agg(F.count("*").alias("k"), F.sum("wrong").alias("w"))
    before = W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)  # a row a stretch
    sums = sums.select("stretch", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    within = W.partitionBy("stretch").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return p.join(sums, "stretch").select(F.col("at").alias(order), (F.col("k0") + F.count("*").over(within)).alias("n"), (F.col("w0") + F.sum("wrong").over(within)).alias("errors"))


def interleave(docs: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """docs with `draw`, a fixed random order of all streams taken together."""
    return docs.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))


def integrity(features: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a model: whether its weights are none negative, and its features as many as its figures say and distinct."""
    f = features.groupBy("model").agg(F.min("lam").alias("least"), F.count("*").alias("n"), F.count_distinct("ord", "gram").alias("types"))
    j = meta.select("model", "n_features").join(f, "model", "left")
    return j.select("model", (F.col("least") >= 0).alias("weights_ok"), (F.col("n") == F.col("n_features")).alias("count_ok"), (F.col("n") == F.col("types")).alias("distinct_ok"))
