"""Folders and small helpers that the operators have in common."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import shared_dir


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, and keeps Arrow batches of long texts small."""
    storage.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder, in a folder for each value of ``by``, and reads it back: lineage ends here and later jobs reread files.

    The shuffles of the write are deleted with it, since nothing reads them again.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = shared_path(spark, name), spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, folder: str = "") -> None:
    """Deletes the files of ``df`` in ``folder`` of a table that ``materialize`` wrote by a column, or all of a table; nothing may read them again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles() if not folder or f"/{folder}/" in x}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def named(column: str) -> Column:
    """The column of that very name: a dot in it is no path."""
    return F.col(f"`{column.replace('`', '``')}`")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
