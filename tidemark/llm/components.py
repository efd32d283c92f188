"""Connected components of a link table, as alternating joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    around = both.select(F.col("high").alias("node"), F.col("low").alias("other"))
    least = around.groupBy("node").agg(F.min("other").alias("least"))
    pairs = around.filter(F.col("other") > F.col("node")).join(least, "node")
    return pairs.select(F.col("other").alias("high"), F.least("node", "least").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node is linked to the smallest one, and so is the node."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    pairs = links.join(least, "high").filter(F.col("low") != F.col("least"))
    moved = pairs.select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def component_roots(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every linked node but the roots; ``root`` is the smallest node reachable.

    Both ends are bigint; loops and repeats are allowed, null ends are ignored. Each round
    shortens paths by two alternating star steps and is written to the shared folder, so a lost executor
    costs a part of one round. It ends when a round changes nothing, which takes a number of rounds
    that grows with the logarithm of the largest component. No links: an empty table.
    """
    ends = links.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a <> b")
    stars = stage(ends.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
    seen = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return stars.select(F.col("high").alias("node"), F.col("low").alias("root"))
        seen = state
        stars = stage(_small_star(_large_star(stars)), "links")
