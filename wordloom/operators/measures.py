"""Reference measures over byte digrams; weights are truncated to multiples of 1/32.

uniform, mle, iid and toklen are DataFrame expressions. dirichlet and maxent iterate over the digram
matrix, which has at most 65,536 cells whatever the corpus, on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

ALPHABET = 253
UNIFORM = -177 / 32  # log(1 / 253), truncated


def uniform_ref(gram: Column, ord_: Column) -> Column:
    """Weight of a gram under the uniform measure: one step from each byte or border to the next."""
    chars = F.octet_length(gram) - (ord_ - 1)
    return (chars + ord_) * F.lit(UNIFORM)


def uniform(digrams: DataFrame) -> DataFrame:
    return digrams.select("i", "j", F.lit(UNIFORM).alias("w"))


def mle(digrams: DataFrame) -> DataFrame:
    """Weights of the seen cells: row frequencies mixed with the share of empty cells."""
    row = W.partitionBy("i")
    empty = F.lit(ALPHABET) - F.count("*").over(row)
    f = F.col("n") / F.sum("n").over(row)
    p = F.when(empty > 0, f * (1 - 1 / empty) + 1 / empty).otherwise(f)
    return digrams.select("i", "j", tx.truncated(F.log(p)).alias("w"))


def iid(digrams: DataFrame) -> DataFrame:
    """Weights by the byte that is stepped to, the same in all rows."""
    m = digrams.groupBy("j").agg(F.sum("n").alias("n"))
    every = W.partitionBy(F.lit(1))  # 256 rows at most
    empty = F.lit(ALPHABET) - F.count("*").over(every)
    f = F.col("n") / F.sum("n").over(every)
    p = F.when(empty > 0, f * (1 - 1 / empty) + 1 / empty).otherwise(f)
    return m.select("j", tx.truncated(F.log(p)).alias("w"))


def toklen(features: DataFrame) -> DataFrame:
    """Weights by token length 1 .. 30: log frequency less the length's uniform choices."""
    spark = features.sparkSession
    seen = features.where("ord = 1").groupBy(F.octet_length("gram").alias("len")).agg(F.sum("cnt").alias("n"))
    all_ = spark.range(1, tx.MAX_TOKEN + 1).select(F.col("id").cast("int").alias("len")).join(F.broadcast(seen), "len", "left").select("len", F.coalesce("n", F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return all_.select("len", tx.truncated(F.log(F.col("n") / total) - F.col("len") * F.log(F.lit(float(ALPHABET)))).alias("w"))


def matrix(digrams: DataFrame) -> np.ndarray:
    n = np.zeros((256, 256))
    for r in digrams.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        n[r.i, r.j] = r.n
    return n


def _trunc(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        size = np.minimum(np.floor(np.abs(x) * 32), 65535) / 32
    return np.where(x < 0, -size, size)


SUMMED = 1 << 16


def _power_sums(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of 1 / k and of 1 / k**2 over k = 3 .. m: from a table up to SUMMED, beyond it by the Euler-Maclaurin formula."""
    k = np.arange(1.0, SUMMED + 1)
    tables = [np.concatenate([[0.0], np.cumsum(np.where(k >= 3, 1 / k**p, 0.0))]) for p in (1, 2)]
    tails = (lambda x: np.log(x) + 1 / (2 * x) - 1 / (12 * x**2), lambda x: -1 / x + 1 / (2 * x**2) - 1 / (6 * x**3))
    top, x = np.minimum(m, SUMMED), np.maximum(m, SUMMED).astype(float)
    return tuple(t[top] + f(x) - f(float(SUMMED)) for t, f in zip(tables, tails, strict=True))


def dirichlet(n: np.ndarray, rounds: int = 300, tol: float = 1e-4) -> np.ndarray:
    """Log transition weights under a hierarchical Dirichlet prior fitted by fixed-point iteration."""
    n = n[1:, 1:]
    totals = n.sum(1)
    seen = n[n > 0].astype(np.int64)  # 65,536 cells at most, whatever the counts
    g, h = np.zeros(n.shape), np.zeros(n.shape)
    g[n > 0], h[n > 0] = _power_sums(seen - 1)
    g, h = g.sum(0), h.sum(0)
    v = (n > 0).sum(0).astype(float)
    alpha = float(ALPHABET)
    u = np.full(n.shape[1], alpha / n.shape[1])
    for _ in range(rounds):
        k = (np.log((totals + alpha) / alpha) + 0.5 * totals / (alpha * (totals + alpha))).sum()
        t = k - g
        with np.errstate(divide="ignore", invalid="ignore"):
            new = np.where(v > 0, 2 * v / (t + np.sqrt(t * t + 4 * h * v)), 0.0)
        change = np.abs(new - u).max()
        u, alpha = new, max(new.sum(), 1e-12)
        if change < tol:
            break
    with np.errstate(divide="ignore"):
        w = np.log((n + u) / (totals[:, None] + alpha))
    out = np.zeros((256, 256))
    out[1:, 1:] = _trunc(w)
    return out


def maxent(n: np.ndarray, rounds: int = 500, tol: float = 1e-3) -> np.ndarray:
    """Log transition weights: row by row, exponential weights that are never negative."""
    out = np.full((256, 256), UNIFORM)
    for i in np.flatnonzero(n.sum(1)):
        c = n[i, 1:]
        f = c / c.sum()
        lam = np.zeros(len(c))
        for _ in range(rounds):
            logz = np.log(np.exp(lam).sum())
            with np.errstate(divide="ignore"):
                new = np.maximum(0.0, np.where(f > 0, np.log(np.where(f > 0, f, 1)) + logz, 0.0))
            change = np.abs(new - lam).max()
            lam = new
            if change < tol:
                break
        out[i, 1:] = _trunc(lam - np.log(np.exp(lam).sum()))
    return out


def cells(spark, w: np.ndarray, seen: np.ndarray | None = None) -> DataFrame:
    keep = np.argwhere(seen > 0) if seen is not None else np.argwhere(np.isfinite(w))
    return spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in keep], "i int, j int, w double")


def apply_matrix(features: DataFrame, weights: DataFrame) -> DataFrame:
    """features with dref under (i, j, w) weights. The weights have 65,536 rows at most: broadcast."""
    h = F.concat(F.lit("01"), F.hex(F.translate("gram", " ", "\x01")), F.lit("01"))
    steps = F.transform(F.sequence(F.lit(0), F.octet_length("gram")), lambda k: F.substring(h, k * 2 + 1, F.lit(4)))
    rows = features.select("ord", "gram", F.explode(steps).alias("t"))
    code = lambda a: F.conv(F.substring("t", a, 2), 16, 10).cast("int")
    summed = rows.select("ord", "gram", code(1).alias("i"), code(3).alias("j")).join(F.broadcast(weights), ["i", "j"], "left").groupBy("ord", "gram").agg(F.sum(F.coalesce("w", F.lit(UNIFORM))).alias("dref"))
    return features.join(summed.withColumn("dref", tx.truncated(F.col("dref"))), ["ord", "gram"])
