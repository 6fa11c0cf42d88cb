"""Shards of near equal bytes by Karmarkar-Karp differencing.

Rows that belong together (equal texts here) stay in one shard.  A partial
partition is a vector of shard sums; differencing takes the two with the
largest spread and adds them in opposite order, until one is left.

One task never holds all groups.  Groups are dealt into blocks, every block is
differenced in its own task, and what is left of a block is again a partial
partition: blocks are combined by the same rule, ``FAN_IN`` at a time, until
one partition is left.  Only shard sums move up, only permutations move down.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from leadloom.sources.scratch import materialize

#: Groups that one task differences, and partial partitions that are combined at a time.
BLOCK_GROUPS = 20_000
FAN_IN = 1_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (one per row, a column per shard).

    Returns the sums of the whole and ``place``: column ``c`` of row ``r`` goes
    to shard ``place[r, c]``.  Ties go by row number, so results repeat.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    # A node is its descending sums, and how its two parts' columns were matched.
    vector = [sums[i][order[i]] for i in range(n)]
    parts: list[tuple[int, int] | None] = [None] * n
    column: list[np.ndarray] = list(order)
    heap = [(-int(v[0] - v[-1]), i) for i, v in enumerate(vector)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        added = vector[a] + vector[b][::-1]
        by = np.argsort(-added, kind="stable")
        vector[a] = vector[b] = None
        vector.append(added[by])
        parts.append((a, b))
        column.append(by)
        heapq.heappush(heap, (-int(vector[-1][0] - vector[-1][-1]), len(vector) - 1))
    place = np.zeros((n, k), np.int64)
    # Down from the whole: where[j] is the shard of the node's j-th largest sum.
    todo = [(len(vector) - 1, np.arange(k))] if n else []
    while todo:
        node, where = todo.pop()
        if parts[node] is None:
            place[node, column[node]] = where
            continue
        before = np.empty(k, np.int64)
        before[column[node]] = where
        a, b = parts[node]
        todo += [(a, before), (b, before[::-1])]
    return (vector[-1] if n else np.zeros(k, np.int64)), place


def _difference_blocks(sums: DataFrame, block: str, node: str, shards: int) -> DataFrame:
    """``sums`` of nodes, differenced within each block: place of every node, sums of the block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        matrix = np.zeros((len(pdf), shards), np.int64)
        for i, values in enumerate(pdf["sums"]):
            matrix[i, : len(values)] = values
        total, place = difference(matrix)
        own = [p[: len(values)] for p, values in zip(place, pdf["sums"])]
        return pd.DataFrame(
            {
                "block": pdf["block"].to_numpy(),
                "node": pdf["node"].to_numpy(),
                "place": own,
                "sums": [total] + [None] * (len(pdf) - 1),
            }
        )

    return (
        sums.select(F.col(block).alias("block"), F.col(node).alias("node"), "sums")
        .groupBy("block")
        .applyInPandas(run, "block bigint, node binary, place array<bigint>, sums array<bigint>")
    )


def balance(groups: DataFrame, shards: int, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """``(group_key binary, bytes)`` with the ``shard`` of every group."""
    spark = groups.sparkSession
    groups = materialize(groups, "shard_groups")
    n = groups.count()
    blocks = max(1, -(-n // block_groups))
    leaves = groups.select(
        F.pmod(F.xxhash64("group_key"), F.lit(blocks)).alias("block"),
        F.col("group_key").alias("node"),
        F.array(F.col("bytes")).alias("sums"),
    )
    levels = [materialize(_difference_blocks(leaves, "block", "node", shards), "shard_level")]
    while blocks > 1:
        blocks = -(-blocks // FAN_IN)
        above = levels[-1].where("sums is not null").select(
            F.floor(F.col("block") / FAN_IN).cast("bigint").alias("parent"),
            F.to_binary(F.lpad(F.hex("block"), 16, "0"), F.lit("hex")).alias("child"),
            "sums",
        )
        levels.append(
            materialize(_difference_blocks(above, "parent", "child", shards), "shard_level")
        )
    # Down again: the columns of a block in its parent, then of the parent in its own.
    where = None
    for level in reversed(levels[1:]):
        here = level.select(
            F.conv(F.hex("node"), 16, 10).cast("bigint").alias("block"),
            F.col("block").alias("parent"),
            "place",
        )
        if where is not None:
            above = where.select(F.col("block").alias("parent"), F.col("place").alias("up"))
            here = here.join(above, "parent").withColumn(
                "place", F.transform("place", lambda c: F.get("up", c.cast("int")))
            )
        where = here.select("block", "place")
    # A leaf has its bytes in its first column.
    leaf = levels[0].select(
        F.col("node").alias("group_key"), "block", F.col("place")[0].alias("column")
    )
    if where is None:
        return leaf.select("group_key", F.col("column").cast("int").alias("shard"))
    return leaf.join(where, "block").select(
        "group_key", F.get("place", F.col("column").cast("int")).cast("int").alias("shard")
    )


def shard_documents(
    docs: DataFrame,
    shards: int,
    id_column: str = "doc_id",
    text: str = "text",
    overhead: int = 16,
    block_groups: int = BLOCK_GROUPS,
) -> DataFrame:
    """Every row's ``id_column, size, text_crc32, shard, slot``; equal texts share a shard.

    ``size`` is the text's UTF-8 bytes plus ``overhead``.  A null text counts as
    an empty one.  Null ids and repeated rows are rows like others; slots
    are gapless from 0 in each shard, whatever repeats.  An empty table gives
    an empty one; columns other than the two named are not read.  A group
    larger than a fair shard fills one alone.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(body) + F.lit(overhead)).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("group_key"),
    )
    rows = materialize(rows, "shard_rows")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"))
    # The slots' pieces hash the row, not the group, so no copy group fills a task.
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        rows.join(balance(groups, shards, block_groups), "group_key").select(
            "id", "size", "text_crc32", "shard", "group_key",
            F.pmod(F.xxhash64("id", "text_crc32"), F.lit(spread)).alias("piece"),
        ),
        "shard_placed",
    )
    # A row per shard and piece: a few thousand at most, so one task may add them up.
    before = (
        placed.groupBy("shard", "piece")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "shard", "piece",
            (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("before"),
        )
    )
    inside = Window.partitionBy("shard", "piece").orderBy("id", "group_key")
    return (
        placed.withColumn("inside", F.row_number().over(inside) - 1)
        .join(before, ["shard", "piece"])
        .select(
            F.col("id").alias(id_column), "size", "text_crc32", "shard",
            (F.col("before") + F.col("inside")).alias("slot"),
        )
    )
