"""Documents from files and tables, as rows (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mail


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def directory(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """Every regular file of one folder, not of those in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return files.select(F.col("path").alias("doc_id"), F.decode("content", charset).alias("text"))


def mailboxes(spark: SparkSession, path: str) -> DataFrame:
    """One row a message of mailbox files: (path, number, raw)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(mail.split_mbox(F.col("value"))).alias("number", "raw"))


def maildir(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of the cur and new folders: (doc_id, raw)."""
    return text_files(spark, f"{path}/{{cur,new}}/*").withColumnRenamed("text", "raw")


def score_lines(spark: SparkSession, path: str) -> DataFrame:
    """Printed score lines "name score * complexity ..." as rows (line_no, model, score, complexity)."""
    raw = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    item = F.explode(F.regexp_extract_all("value", F.lit(r"(\S+\s+-?[0-9.]+\s*\*\s*[0-9.]+)"), F.lit(1))).alias("x")
    part = lambda k: F.regexp_extract("x", r"^(\S+)\s+(-?[0-9.]+)\s*\*\s*([0-9.]+)$", k)
    rows = raw.select("line_no", item)
    per = rows.select("line_no", part(1).alias("model"), part(2).cast("double").alias("mean"), part(3).cast("double").alias("complexity"))
    return per.select("line_no", "model", (-F.col("mean") * F.col("complexity")).alias("score"), "complexity")
