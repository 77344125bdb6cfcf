"""Streams: lines classified as they come, and models learned as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators import features as ft
from ..operators import measures
from ..operators import score as sc
from ..sources import models


def scored_lines(lines: DataFrame, features: DataFrame, meta: DataFrame, tokenizer: str = "alpha") -> DataFrame:
    """A stream or table of (line_id, line) with one column score_<model> each and `best`; order 1, uniform reference.

    Stateless: each line looks its tokens' weights up in a map that goes out with the plan, so the model must be
    bounded; the map's size is checked.
    """
    rows = meta.orderBy("model").collect()  # a row a model
    w = sc.weights(features.where("ord = 1"), [r.model for r in rows])
    n = w.count()
    if n > MAP_LIMIT:
        raise ValueError(f"{n} features; lines can be scored against {MAP_LIMIT} at most, or in batches by score()")
    packed = w.agg(F.map_from_entries(F.collect_list(F.struct("gram", "lams"))).alias("m"))  # MAP_LIMIT entries at most
    toks = tx.tokens(F.col("line"), tokenizer)
    both = lines.withColumn("toks", toks).crossJoin(F.broadcast(packed))  # one row
    out = [_line_score(k, r.log_z).alias(f"score_{r.model}") for k, r in enumerate(rows)]
    names = F.array(*[F.struct((-F.col(f"score_{r.model}")).alias("s"), F.lit(r.model).alias("model")) for r in rows])
    return both.select("line_id", "line", *out).withColumn("best", F.array_min(names)["model"])


MAP_LIMIT = 2_000_000


def _line_score(k: int, log_z: float):
    step = lambda t: F.coalesce(F.try_element_at("m", t)[k], F.lit(0.0)) + (F.octet_length(t) + 1) * F.lit(measures.UNIFORM) - F.lit(log_z)
    return F.aggregate(F.transform("toks", step), F.lit(0.0), lambda a, x: a + x)


def filter_lines(spark: SparkSession, source: DataFrame, model_path: str, keep: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Lines whose best model is one of keep go to the sink; the model is read anew for each batch."""

    def batch(df: DataFrame, number: int) -> None:
        f, m = models.load(df.sparkSession, model_path)
        sink(scored_lines(df, f, m).where(F.col("best").isin(*keep)), number)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def learn_stream(source: DataFrame, counts_path: str, checkpoint: str, tokenizer: str = "alpha") -> StreamingQuery:
    """A stream of (model, text): each batch's counts are written under its number, so a batch that runs again replaces its own."""

    def batch(df: DataFrame, number: int) -> None:
        c = ft.counts(ft.token_rows(df.select("model", "text"), tokenizer), "model")
        c.write.mode("overwrite").parquet(f"{counts_path}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def learned(spark: SparkSession, counts_path: str) -> DataFrame:
    return spark.read.parquet(counts_path).groupBy("model", "ord", "gram").agg(F.sum("cnt").alias("cnt"))


def train_on_error(spark: SparkSession, batches, fit: Callable[[DataFrame], tuple[DataFrame, DataFrame]], counts_path: str, tokenizer: str = "alpha", always: bool = False):
    """Documents (doc_id, truth, text) come in batches; each is classified by what was learned before, and learned if that was wrong (or always).

    Yields one DataFrame (doc_id, truth, best) a batch. A batch counts as one step: within it the model stays.
    """
    first = True
    for number, docs in enumerate(batches):
        if first:
            predicted, wrong = docs.select("doc_id", "truth", F.lit(None).cast("string").alias("best")), docs
            first = False
        else:
            f, m = fit(learned(spark, counts_path))
            c = ft.counts(ft.token_rows(docs.select("doc_id", "text"), tokenizer), "doc_id")
            b = sc.best(sc.score(c, f, m)).select("doc_id", "best")
            predicted = docs.join(b, "doc_id", "left").select("doc_id", "truth", "best")
            wrong = docs if always else docs.join(predicted.where(~F.col("truth").eqNullSafe(F.col("best"))).select("doc_id"), "doc_id", "left_semi")
        found = wrong.select(F.col("truth").alias("model"), "text")
        ft.counts(ft.token_rows(found, tokenizer), "model").write.mode("overwrite").parquet(f"{counts_path}/batch={number}")
        yield predicted
