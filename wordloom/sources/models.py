"""Models on disk: a folder with Parquet tables `features` and `meta`, and learners' counts.

A folder that isn't a model is never overwritten; a model of another version is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _move(spark: SparkSession, src: str, dst: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(b):
        fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"can't rename {src}")


def save(features: DataFrame, meta: DataFrame, path: str, options: dict[str, str] | None = None) -> None:
    """Written beside the place and renamed, so that readers see one model or the other whole."""
    spark = features.sparkSession
    if _exists(spark, path) and not _exists(spark, f"{path}/meta"):
        raise FileExistsError(f"{path} is no model")
    features.repartition("model").write.mode("overwrite").partitionBy("model").parquet(f"{path}.new/features")
    opts = F.create_map(*[F.lit(x) for kv in (options or {"": ""}).items() for x in kv])
    meta.withColumn("version", F.lit(VERSION)).withColumn("options", opts).coalesce(1).write.mode("overwrite").parquet(f"{path}.new/meta")
    _move(spark, f"{path}.new", path)


def load(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, meta). options, if given, must be those the model was learned with."""
    meta = spark.read.parquet(f"{path}/meta")
    for r in meta.select("version", "options").collect():  # a row a model at most
        if r.version != VERSION:
            raise ValueError(f"model version {r.version}")
        if options is not None and dict(r.options) != (options or {"": ""}):
            raise ValueError(f"the model was learned with {r.options}")
    return spark.read.parquet(f"{path}/features"), meta.drop("version", "options")


def dump(features: DataFrame) -> DataFrame:
    """Printed features: weight, reference, count, and the gram with its tokens marked."""
    token = F.concat(F.lit("[]"), F.array_join(F.split("gram", " ", -1), "[]"), F.lit("[]"))
    return features.select("model", F.format_string("%9.3f %9.3f %9d %s", "lam", "dref", "cnt", token).alias("printed"))


def read_dump(printed: DataFrame, column: str = "printed") -> DataFrame:
    """(ord, gram, cnt, dref, lam) of printed features; other lines are passed over."""
    line = r"^\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s+([0-9]+)\s\[\]([\s\S]*)\[\]$"
    part = lambda k: F.regexp_extract(column, line, k)
    tokens = F.split(part(4), r"\[\]", -1)
    rows = printed.where(F.col(column).rlike(line))
    return rows.select(*[c for c in printed.columns if c != column], F.size(tokens).alias("ord"), F.array_join(tokens, " ").alias("gram"), part(3).cast("long").alias("cnt"), part(2).cast("double").alias("dref"), part(1).cast("double").alias("lam"))


def add_counts(spark: SparkSession, path: str, counts: DataFrame) -> None:
    """Online learning: counts are appended; counts of the same gram add up when read."""
    counts.write.mode("append").parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    c = spark.read.parquet(path)
    return c.groupBy(*[x for x in c.columns if x != "cnt"]).agg(F.sum("cnt").alias("cnt"))
