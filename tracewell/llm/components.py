"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, forget


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the smallest node that it is connected with.

    Links are turned into stars in two steps that alternate: every node links its larger
    neighbours with the least node around it, and then every node links its smaller neighbours,
    and itself, with the least of these. A chain halves each round, in whatever order its nodes
    stand (4,096 nodes take at most 14 rounds); links never become more. Rounds end when the
    links stay as they are, and then each node but a root has one link, with its root.

    All of it stays distributed. A node with very many links costs one row a link: minima are taken
    before rows are shuffled, and they are joined back to the links, whose hot nodes Spark splits.
    Each round's links are written to the shared checkpoint folder, and those of the round before
    are deleted. Null nodes have no links.
    """
    held = links.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = cut(held.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = cut(small.union(lowest.select("hi", F.col("m").alias("lo"))).distinct())
        forget(edges)
        before, mark, edges = mark, _mark(new), new
        if mark == before:
            roots = edges.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """What two equal sets of links have in common, and others don't."""
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h, "lo"))).first())
