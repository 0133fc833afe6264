"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnwork.llm import common


#: Links in one file of a round's table.
PER_FILE = 1_000_000


def _digest(edges: DataFrame):
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: bigint); root is the smallest node it reaches.

    A round hangs every neighbour above a node on the node's smallest neighbour, then every node and
    its smaller neighbours on the smallest of them. Links never grow in number, rounds are about the
    logarithm of the longest path, and no node's neighbours are gathered in one place: minima are
    taken with partial aggregates and joined back. Each round is a written table in the shared
    folder; the one before the last is deleted.
    """
    spark = links.sparkSession
    big, small = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = links.where("u <> v").select(big, small).distinct()
    path = common.new_path(spark, "stars")
    edges, before = common.kept(edges, path, "snappy"), None
    while (state := _digest(edges)) != before:
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        stars = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        moved = stars.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, path = path, common.new_path(spark, "stars")
        # A round never has more links than the one before, so few links don't become many small files.
        edges = moved.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(before[0] // PER_FILE + 1)
        edges = common.kept(edges, path, "snappy")
        common.delete(spark, old)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
