"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster, an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        sc.setCheckpointDir(found)
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends, if not before."""
    path = f"{shared_dir(spark)}/wordloom-{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is not None:  # else the session is gone already; the folder is the cluster's to clean
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again."""
    return Scratch(df.sparkSession).write(df, tag)


class Scratch:
    """Tables of one computation, by tag, that go as soon as what was made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_path(self.spark, tag)
        df.write.parquet(path)
        self.paths.setdefault(tag, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Delete those tables, and let Spark delete the shuffle files of finished jobs.

        Spark removes a shuffle's files once the driver's JVM has collected the plan that made them,
        which it may put off for half an hour; this asks for it.
        """
        for tag in tags:
            for path in self.paths.pop(tag, []):
                remove(self.spark, path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, *texts: str, most: int = SLICE_BYTES):
    """The batch in runs of rows whose texts have about `most` bytes together, one row at least."""
    size = np.zeros(batch.num_rows, np.int64)
    for t in texts:
        size += pc.fill_null(pc.binary_length(batch.column(t)), 0).to_numpy(zero_copy_only=False)
    share = np.cumsum(size) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(share)) + 1, [batch.num_rows]]) if batch.num_rows else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def append_arrow(df: DataFrame, work, fields: list[T.StructField], by: str | None = None) -> DataFrame:
    """df with the columns that work(RecordBatch) returns as a list of Arrow arrays.

    Input columns named like a new one are replaced by it. by: a text column; work gets slices of
    bounded bytes of it.
    """
    df = df.drop(*[f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches):
        for batch in (x for b in batches for x in (slices(b, by) if by else (b,))):
            new = work(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, schema)

