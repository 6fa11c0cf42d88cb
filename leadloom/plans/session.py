"""Session settings the plans of this package run best with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Re-plan joins with measured sizes, split skewed and merge small partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles a method beyond 8,000 bytes.  Ten normalised
    # columns in one stage are longer; code is then generated in pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    # A mapping reply may repeat a key; the last one counts, as JSON readers have it.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Streams with timers need it; the state then lies on disk, not in the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """``spark`` with ``SETTINGS``; shuffle partitions stay as the cluster has them."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it has fewer.

    A table in one small file is scanned by one task, and all costly work on
    its rows would stay there.  Call this on the narrow scan, before anything
    wide is joined to it.  Tables of many files are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
