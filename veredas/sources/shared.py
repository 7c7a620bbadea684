"""The folder that driver and executors share, and atomic replacement of what lies in a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder, on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veredas-"))
        where = spark.sparkContext.getCheckpointDir()
    return f"{where.rstrip('/')}/veredas-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _hadoop(spark, path)
    return fs.exists(where)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """The staged folder takes the place of the other, which goes only after that."""
    new, fs = _hadoop(spark, staged)
    old, _ = _hadoop(spark, path)
    aside, _ = _hadoop(spark, f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, old):
        raise OSError(f"{staged} can't take the place of {path}")
    fs.delete(aside, True)


def remove(table: DataFrame) -> None:
    """Deletes the folder of a ``written`` table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        where, fs = _hadoop(table.sparkSession, path)
        fs.delete(where, True)


def discard(spark: SparkSession, path: str) -> None:
    where, fs = _hadoop(spark, path)
    fs.delete(where, True)
