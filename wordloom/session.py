"""A session with settings that suit these queries, and cutting of lineage in the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A cluster's own settings win."""
    b = SparkSession.builder.appName("wordloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster, an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="wordloom-")
        atexit.register(shutil.rmtree, local, True)
        sc.setCheckpointDir(f"file://{local}")
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again.

    Executors may be lost: what follows starts from these files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wordloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """At the driver's end; a session that is stopped already leaves its files to the cluster's cleaning."""
    jsc = spark.sparkContext._jsc
    if jsc is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
