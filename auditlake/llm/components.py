"""Connected components of an edge table: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``edges`` (a, b longs).

    Each step hangs neighbours on the smallest one, by a grouped minimum and a join, so a hub is never gathered in
    one task. Steps are written to the shared folder, so lineage stays short and a lost executor costs one step."""
    pairs = edges.select("a", "b").where("a <> b").distinct()
    seen = None
    while True:
        stars = materialise(_small_star(_large_star(pairs)), "llm-stars")
        count, total = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (count, total) == seen:
            break
        seen, pairs = (count, total), stars
    hung = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.union(hung.select(F.col("root").alias("node"), "root").distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest of its neighbourhood. Rows (a, b) with a > b."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    inner = pairs.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(least.select("a", F.col("m").alias("b"))).distinct()
