"""Distances between two unigram models, in bits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def pairs(features: DataFrame, meta: DataFrame) -> DataFrame:
    """(model_a, model_b, z_a, z_b, gram, la, lb, dref): the grams of each pair of models a < b, with missing weights 0."""
    m = meta.select("model", "log_z")
    both = m.select(F.col("model").alias("model_a"), F.col("log_z").alias("z_a")).join(m.select(F.col("model").alias("model_b"), F.col("log_z").alias("z_b")), F.col("model_a") < F.col("model_b"))
    both = F.broadcast(both)  # models are few
    f = features.where("ord = 1").select("model", "gram", "lam", "dref")
    a = f.join(both, f.model == both.model_a).select("model_a", "model_b", "z_a", "z_b", "gram", F.col("lam").alias("la"), F.lit(0.0).alias("lb"), "dref")
    b = f.join(both, f.model == both.model_b).select("model_a", "model_b", "z_a", "z_b", "gram", F.lit(0.0).alias("la"), F.col("lam").alias("lb"), "dref")
    # a full outer join of the two sides as one union and sum: a row of each side at most
    return a.unionByName(b).groupBy("model_a", "model_b", "z_a", "z_b", "gram").agg(F.sum("la").alias("la"), F.sum("lb").alias("lb"), F.max("dref").alias("dref"))


def kl(features: DataFrame, meta: DataFrame) -> DataFrame:
    """(model_a, model_b, d_ab, d_ba): relative entropies both ways."""
    p = pairs(features, meta)
    g = p.groupBy("model_a", "model_b", "z_a", "z_b").agg(
        F.sum((F.col("la") - F.col("lb")) * F.exp(F.col("la") + F.col("dref") - F.col("z_a"))).alias("x"),
        F.sum((F.col("lb") - F.col("la")) * F.exp(F.col("lb") + F.col("dref") - F.col("z_b"))).alias("y"),
    )
    return g.select("model_a", "model_b", ((F.col("z_b") - F.col("z_a") + F.col("x")) / LN2).alias("d_ab"), ((F.col("z_a") - F.col("z_b") + F.col("y")) / LN2).alias("d_ba"))


def sweep(features: DataFrame, meta: DataFrame, step: float = 0.1) -> DataFrame:
    """(model_a, model_b, beta, d_a, d_b, psi): along the exponential family between the two models.

    Q_beta has weights beta * la + (1 - beta) * lb; d_a and d_b are its divergences from either model,
    and psi is minus the log of the mixed normaliser, all in bits.
    """
    n = round(1 / step)
    grid = F.explode(F.sequence(F.lit(0), F.lit(n)))  # a dozen values
    p = pairs(features, meta).withColumn("k", grid).withColumn("beta", F.col("k") / n)
    lam = F.col("beta") * F.col("la") + (1 - F.col("beta")) * F.col("lb")
    g = p.groupBy("model_a", "model_b", "z_a", "z_b", "k", "beta").agg(
        F.log1p(F.sum(F.expm1(lam) * F.exp(F.col("dref")))).alias("z"),
        F.sum((lam - F.col("la")) * F.exp(lam + F.col("dref"))).alias("xa"),
        F.sum((lam - F.col("lb")) * F.exp(lam + F.col("dref"))).alias("xb"),
    )
    return g.select(
        "model_a", "model_b", "beta",
        ((F.col("z_a") - F.col("z") + F.col("xa") * F.exp(-F.col("z"))) / LN2).alias("d_a"),
        ((F.col("z_b") - F.col("z") + F.col("xb") * F.exp(-F.col("z"))) / LN2).alias("d_b"),
        ((F.col("beta") * F.col("z_a") + (1 - F.col("beta")) * F.col("z_b") - F.col("z")) / LN2).alias("psi"),
    )


def chernoff(swept: DataFrame) -> DataFrame:
    """(model_a, model_b, beta, information): the first step at which Q is no farther from a than from b."""
    w = W.partitionBy("model_a", "model_b").orderBy("beta")
    s = swept.withColumn("before", F.lag("beta").over(w)).withColumn("d_before", F.lag((F.col("d_a") + F.col("d_b")) / 2).over(w))
    crossed = s.where("d_a <= d_b")
    x = F.struct("beta", "before", "d_before", ((F.col("d_a") + F.col("d_b")) / 2).alias("d"))
    first = crossed.groupBy("model_a", "model_b").agg(F.min(x).alias("x"))
    mid = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).otherwise((F.col(a) + F.col(b)) / 2)
    return first.select("model_a", "model_b", mid("x.before", "x.beta").alias("beta"), mid("x.d_before", "x.d").alias("information"))
