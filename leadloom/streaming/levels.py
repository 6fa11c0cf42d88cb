"""Changes of a stream, kept so that a reader opens few folders.

Every micro-batch writes one folder.  Whenever ``fan`` folders of a level are
there, they are merged into one of the next level, so after n batches at most
``(fan - 1) * log(n)`` folders hold everything.  Which ones these are follows from
n alone.  The number of finished batches is the manifest: it lies in two slots
that are written in turn, so one of them is whole at any time.  A batch that runs
again after a failure writes the same folders once more.

Folders that were merged stay until ``merged_folders`` are removed, since readers
that began earlier may still open them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folders of a level that are merged into one of the next.
FAN = 8


def latest_by(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps the row of the newest batch for every key."""

    def merge(changes: DataFrame) -> DataFrame:
        value = [c for c in changes.columns if c not in keys]
        newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*value), "batch_id").alias("value"))
        return newest.select(*keys, "value.*")

    return merge


def sum_of(change: str, *keys: str) -> Callable[[DataFrame], DataFrame]:
    """Merge that adds up ``change`` for every key; what has come to nothing goes."""

    def merge(changes: DataFrame) -> DataFrame:
        summed = changes.groupBy(*keys).agg(F.sum(change).alias(change), F.max("batch_id").alias("batch_id"))
        return summed.where(F.col(change) != 0)

    return merge


def live_folders(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """``(level, run)`` of the folders that hold ``batches`` micro-batches: their number to base ``fan``."""
    found, level = [], 0
    while batches // fan**level:
        runs = batches // fan**level
        found += [(level, run) for run in range(runs // fan * fan, runs)]
        level += 1
    return found


class Levels:
    """Changes below ``path``, merged by ``merge``."""

    def __init__(self, path: str, merge: Callable[[DataFrame], DataFrame], fan: int = FAN):
        self.path, self.merge, self.fan = path, merge, fan

    def _folder(self, level: int, run: int) -> str:
        return f"{self.path}/level={level}/run={run}"

    def _land(self, changes: DataFrame, level: int, run: int) -> None:
        changes.write.mode("overwrite").option("compression", "zstd").parquet(self._folder(level, run))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: lands the changes of a batch, then merges what is due."""
        spark = batch.sparkSession
        self._land(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), 0, batch_id)
        done, level = batch_id + 1, 0
        while done % self.fan ** (level + 1) == 0:
            last = done // self.fan**level
            parts = spark.read.parquet(*(self._folder(level, r) for r in range(last - self.fan, last)))
            self._land(self.merge(parts), level + 1, last // self.fan - 1)
            level += 1
        spark.range(done, done + 1, 1, 1).write.mode("overwrite").parquet(f"{self.path}/finished/slot={batch_id % 2}")

    def finished(self, spark: SparkSession) -> int:
        """Micro-batches that are whole."""
        known = [0]
        for slot in (0, 1):
            try:
                known += [r[0] for r in spark.read.schema("id bigint").parquet(f"{self.path}/finished/slot={slot}").collect()]
            except AnalysisException:  # not there yet, or being written
                continue
        return max(known)

    def folders(self, spark: SparkSession, batches: int | None = None) -> list[str]:
        """Folders that hold all finished micro-batches, or the first ``batches``."""
        done = self.finished(spark) if batches is None else batches
        return [self._folder(*f) for f in live_folders(done, self.fan)]

    def merged_folders(self, spark: SparkSession) -> list[str]:
        """Folders whose rows are in a higher level by now."""
        done, out, level = self.finished(spark), [], 0
        while done // self.fan ** (level + 1):
            out += [self._folder(level, run) for run in range(done // self.fan ** (level + 1) * self.fan)]
            level += 1
        return out

    def read(self, spark: SparkSession, batches: int | None = None) -> DataFrame:
        """All changes, merged, or those of the first ``batches``."""
        folders = self.folders(spark, batches)
        if not folders:
            raise ValueError(f"no finished batch in {self.path}")
        return self.merge(spark.read.parquet(*folders))


def folders_read(df: DataFrame) -> Sequence[str]:
    """Folders that a table's files lie in."""
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
