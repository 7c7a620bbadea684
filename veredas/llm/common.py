"""What several operators share: column selection, scratch tables, joins of hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The columns of these exact names (the first of each), whatever else the table has.

    Other columns may repeat a name in another case or be called like an operator's own columns.
    ``renamed`` maps a new name to a column's name.
    """
    at: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    wanted = {n: n for n in names} | renamed
    return flat.select(*[F.col(f"_{at[old]}").alias(new) for new, old in wanted.items()])


def number_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns ``_0, _1, ...`` and, for each name, the numbered column of its first use."""
    at: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, f"_{i}")
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), at


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary one if all tasks run in this process (a local master), else an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veredas-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veredas-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _hadoop(spark, path)
    return fs.exists(where)


def remove(table: DataFrame) -> None:
    """Deletes the folder of a ``written`` table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        where, fs = _hadoop(table.sparkSession, path)
        fs.delete(where, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, other characters unchanged. ``lower`` does the same on plain ASCII and is much faster there."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, small))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
