"""Shared storage for intermediate tables, and size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadloom.sources.scratch import new_path

#: A side of a join is broadcast only if a count shows at most so many (thin) rows; beyond that it is shuffled.
BROADCAST_ROWS = 1_000_000


#: Has Spark delete a query's shuffle files once it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage and survives lost executors.

    Nothing reads the shuffle files of the job that wrote it again, so they go at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, each: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (or the sum of ``each`` does), else as it is.

    ``df`` should be a stored table, as it is read for the check.
    """
    size = df.count() if each is None else df.agg(F.sum(each)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
