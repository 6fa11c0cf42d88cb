"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import functools
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session uses a temporary folder of this process; a cluster
    has to name one, since its executors share no local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="leadloom-")


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody used before, below the shared folder."""
    return f"{shared_folder(spark)}/leadloom/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared table and read back.

    Later steps then start from files: they survive lost executors, see the
    same row numbers however often a task runs, and are planned with the real
    size of the table.
    """
    return landed_at(df, new_path(df.sparkSession, name), "error")


def landed_at(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """``df`` written to ``path`` and read back."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_with(df: DataFrame, chosen: DataFrame, ids: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ids are in ``chosen`` (not in it: ``left_anti``); null is an id like any other.

    A semi join, which Catalyst takes down to the tables the ids come from.
    """
    named = chosen.select(*(F.col(c).alias(f"chosen_{c}") for c in ids))
    same = [F.col(c).eqNullSafe(F.col(f"chosen_{c}")) for c in ids]
    return df.join(named, reduce(lambda a, b: a & b, same), how)


#: Bits of a row's hash that name its bitmap, and that name a bit in it; bitmaps of Spark have 32,768 bits.
_BITMAPS, _BIT_NUMBER, _TESTS = 11, 15, 3


def likely_with(df: DataFrame, chosen: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of ``df`` whose ids are in ``chosen``, and few others, without a shuffle of ``df``.

    A Bloom filter: every id sets three bits of one of 2,048 bitmaps.  They take 8 MB however many
    ids there are, so they are broadcast.  With 5 million ids about one in a hundred of the other
    rows passes, with 50 million most do; ``rows_with`` tells exactly.
    """
    hashed = F.xxhash64(*(F.col(c) for c in ids))

    def part(shift: int, bits: int) -> Column:
        return F.shiftrightunsigned("chosen_hash", shift).bitwiseAND((1 << bits) - 1)

    number = part(0, _BITMAPS).alias("chosen_bitmap")
    places = [part(_BITMAPS + i * _BIT_NUMBER, _BIT_NUMBER) for i in range(_TESTS)]
    bitmaps = (
        chosen.select(hashed.alias("chosen_hash"))
        .select(number, F.explode(F.array(*places)).alias("place"))
        .groupBy("chosen_bitmap")
        .agg(F.bitmap_construct_agg("place").alias("chosen_bits"))
    )

    def is_set(place: Column) -> Column:
        byte = F.substring("chosen_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), place.bitwiseAND(7).cast("int")) == 1

    return (
        df.withColumn("chosen_hash", hashed)
        .withColumn("chosen_bitmap", number)
        .join(F.broadcast(bitmaps), "chosen_bitmap")
        .where(reduce(lambda a, b: a & b, map(is_set, places)))
        .drop("chosen_hash", "chosen_bitmap", "chosen_bits")
    )
