"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a vector of statistics (lengths, shares of letter kinds, repetition, word shape),
transformed to be closer to normal. Class means and covariances come from sums over all labelled
rows; each covariance is shrunk towards the pooled one and then towards its diagonal, and factored
once. The score is the logistic of half of: the difference of log densities, from Mahalanobis distances
through the cached Cholesky factors, plus the log ratio of the classes' shares. (Halving brings the scores of
statistics that depend on one another nearer to shares; it moves no score across one half.)

Defined cases: a null text counts as empty; the statistics of an empty text are defined and it gets a
score like any other; rows with null labels or labels other than 0 and 1 aren't learned from; with
no rows of one class the score is 1 or 0 (0.5 without any rows); repeated rows each count; columns
other than the text are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHRINK_POOLED = 0.3
SHRINK_DIAGONAL = 0.1

_NAMES = [
    "log_words", "log_word_length", "word_length_spread", "upper_share", "digit_share", "space_share", "mark_share",
    "odd_mark_share", "stop_mark_share", "distinct_share", "top_share", "second_share", "line_repeat_share", "log_line_length",
    "words_with_marks", "entropy", "caps_words", "adjacent_repeats",
]
D = len(_NAMES)

_KIND = np.full(256, 7, np.uint8)  # other ASCII marks
_KIND[0x80:] = 0  # letters, and whatever else isn't ASCII
_KIND[0x61:0x7B] = 0
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x20, 9, 10, 11, 12, 13]] = 3
_KIND[[0x2E, 0x2C]] = 4
_KIND[:9] = 5
_KIND[[0x21, 0x23, 0x24, 0x25, 0x26, 0x2A, 0x7C, 0x5E, 0x7E]] = 6
_ALNUM = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_MARKS_AWAY = bytes(sorted(set(range(256)) - set(_ALNUM) - {0x20, 9, 10, 11, 12, 13}))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    m = len(words)
    counts = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8)
    letters = max(1, counts[0] + counts[1])
    lengths = np.fromiter(map(len, words), np.int64, m) if m else np.zeros(1, np.int64)
    tally: dict[bytes, int] = {}
    get = tally.get
    for w in words:
        tally[w] = get(w, 0) + 1
    often = sorted(tally.values(), reverse=True)[:2]
    p = np.fromiter(tally.values(), np.float64, len(tally)) / max(1, m)
    lines = [x for x in raw.split(b"\n") if x]
    bare = raw.translate(None, _MARKS_AWAY).split()
    marked = n - len(raw.translate(None, _MARKS_AWAY))
    caps = sum(1 for w in words[:] if len(w) > 1 and w.isupper())
    same = sum(1 for a, b in zip(words, words[1:]) if a == b)
    root = lambda x: float(np.sqrt(max(0.0, x)))
    return [
        float(np.log1p(m)),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        root(counts[1] / letters),
        root(counts[2] / max(1, n)),
        root(counts[3] / max(1, n)),
        root((counts[4] + counts[5] + counts[6] + counts[7]) / max(1, n)),
        root(counts[6] / max(1, n)),
        root(counts[4] / max(1, n)),
        len(tally) / max(1.0, m**0.8),
        root(often[0] / m) if m else 0.0,
        root(often[1] / m) if len(often) > 1 else 0.0,
        root(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        float(np.log1p(n / max(1, len(lines)))),
        root(marked / max(1, m)),
        float(-(p * np.log(p)).sum() / np.log(m)) if m > 1 else 0.0,
        root(caps / max(1, m)),
        root(same / max(1, m)) - (0.0 if len(bare) else 1.0),
    ]


def with_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    def work(batch):
        return [pa.array([statistics(t) for t in batch.column(text).to_pylist()], pa.list_(pa.float64()))]

    return common.append_arrow(docs, work, [T.StructField(name, T.ArrayType(T.DoubleType()))], text)


class Discriminant:
    """Class densities from counts, sums and sums of products of each class (0 and 1)."""

    def __init__(self, n, sums, products, shrink_pooled=SHRINK_POOLED, shrink_diagonal=SHRINK_DIAGONAL):
        self.n = np.asarray(n, float)
        self.parts = None
        if self.n.min() <= 0:
            return
        mean = [np.asarray(s) / k for s, k in zip(sums, self.n, strict=True)]
        scatter = [np.asarray(q) - k * np.outer(m, m) for q, k, m in zip(products, self.n, mean, strict=True)]
        pooled = sum(scatter) / self.n.sum()
        self.parts = []
        for m, s, k in zip(mean, scatter, self.n, strict=True):
            c = (1 - shrink_pooled) * s / k + shrink_pooled * pooled
            c = (1 - shrink_diagonal) * c + shrink_diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(len(m))
            factor = np.linalg.cholesky(c)
            self.parts.append((m, np.linalg.inv(factor), -np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), 0.5 if not self.n.sum() else float(self.n[1] > 0))
        logs = [d - 0.5 * (((x - m) @ inv.T) ** 2).sum(1) for m, inv, d in self.parts]
        z = logs[1] - logs[0] + np.log(self.n[1] / self.n[0])
        return 1 / (1 + np.exp(-np.clip(z / 2, -30, 30)))


def fit(labelled: DataFrame, stats: str = "stats", label: str = "quality") -> Discriminant:
    """Learn from all rows with label 0 or 1. A task sends one row of sums a class: bounded by D."""

    def sums(batches):
        n, s, q = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D) if batch.num_rows else np.zeros((0, D))
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(0)
                q[k] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(n), pa.array(s.tolist(), pa.list_(pa.float64())), pa.array(q.reshape(2, -1).tolist(), pa.list_(pa.float64()))], names=["k", "n", "s", "q"])

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("long"), F.col(stats).alias("stats"))
    part = rows.mapInArrow(sums, "k long, n double, s array<double>, q array<double>")
    flat = part.select("k", "n", F.posexplode(F.concat(F.array("n"), "s", "q")).alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    got = np.zeros((2, 1 + D + D * D))
    for r in flat.collect():  # 2 x (1 + D + D * D) rows
        got[r.k, r.i] = r.v
    got = np.round(got, 6)  # sums don't depend on the order of tasks
    return Discriminant(got[:, 0], got[:, 1 : 1 + D], got[:, 1 + D :].reshape(2, D, D))


def with_scores(docs: DataFrame, model: Discriminant, stats: str = "stats", name: str = "score") -> DataFrame:
    def work(batch):
        x = np.array(batch.column(stats).to_pylist(), float).reshape(-1, D)
        return [pa.array(model.score(x), pa.float64())]

    return common.append_arrow(docs, work, [T.StructField(name, T.DoubleType())])


def fold_of(doc_id):
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string")) % 3


def learn_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows of the folds that may be learned from."""
    return stats.join(labels.select("doc_id", "quality").where(fold_of(F.col("doc_id")) != 1), "doc_id").select("stats", "quality")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs with stats and score; learns from those of its rows that have labels outside the held-out fold.

    Nothing is written: labelled rows have their statistics computed for the fit, and all rows for their scores.
    """
    known = learn_rows(docs.select("doc_id", F.col(text).alias("stats")), labels).withColumnRenamed("stats", "text")
    return with_scores(with_statistics(docs, text), fit(with_statistics(known)))


def op7_quality(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    known = common.materialize(with_statistics(docs).drop("text"), "stats")
    model = fit(learn_rows(known, common.table(spark, sf_dir, "labels")))
    found = with_scores(known, model)
    held = F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
