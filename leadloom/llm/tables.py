"""Tables that the operators read and the sizes they plan by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts_for(df: DataFrame, column: str, bytes_each: int) -> int:
    """Parts of about ``bytes_each`` of a text column, so that a task's memory stays bounded.

    At least as many as the session shuffles into.
    """
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // bytes_each))


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> SparkSession:
    """Let Arrow batches hold ``size`` bytes of rows at most (one row at least)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark
