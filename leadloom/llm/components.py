"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.sources.scratch import materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node point to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below point to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    below = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``links(a, b)``: the least node it is connected with.

    Links stay in tables; the driver sees only a count and a checksum per round.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == now:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return ends.union(roots)


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` of ``components`` with more ``links(a, b)``.

    Only the components that the links join are computed anew, each as one node.
    """
    roots = label.select(F.col("node").alias("r"), F.col("label").alias("root"))
    for end in ("a", "b"):
        links = (
            links.join(roots, F.col(end) == F.col("r"), "left")
            .withColumn(end, F.coalesce("root", end)).select("a", "b")
        )
    joined = components(links)
    moved = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = label.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = joined.join(label.select("node"), "node", "left_anti").select("node", "label")
    return materialize(old.union(new), "labels")
