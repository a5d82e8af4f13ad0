"""Publish the result of a batch merge as a new version of a table.

Parquet has no in-place merge. Each job writes a complete new directory and then moves one small
pointer file, so readers see the old or the new table, never a mix. A job that dies before the
pointer moves leaves the table as it was; running it again writes a fresh directory.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def current_path(spark: SparkSession, table: str) -> str | None:
    """Directory of the published version, or None before the first one."""
    fs, jvm = _fs(spark, table)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{table}/{POINTER}")
    if not fs.exists(pointer):
        return None
    return spark.read.text(f"{table}/{POINTER}").first()[0]


def read_current(spark: SparkSession, table: str) -> DataFrame:
    path = current_path(spark, table)
    if path is None:
        raise FileNotFoundError(table)
    return spark.read.parquet(path)


def publish(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> str:
    """Write `df` as the new version of `table` and point readers at it."""
    spark = df.sparkSession
    path = f"{table}/v-{uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    point(spark, table, path)
    return path


def point(spark: SparkSession, table: str, value: str) -> None:
    """Replace the pointer of `table` in one step: a reader finds the old one or the new one, never none."""
    fs, jvm = _fs(spark, table)
    Path = jvm.org.apache.hadoop.fs.Path
    fresh = Path(f"{table}/{POINTER}.{uuid4().hex}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(value.encode()))
    stream.close()
    kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, Path(f"{table}/{POINTER}"), how)
