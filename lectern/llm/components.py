"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.scratch import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least id around that node."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    above = both.where("b > a").join(least, "a")
    return above.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (least id reachable) of every id that occurs in the pairs of ``links``.

    Both columns of ``links`` are ids; their order and repeated pairs do not matter, pairs with a
    null or of an id with itself are ignored. Each round is written, and nothing but two sums per
    round comes to the driver. Rounds grow with the logarithm of the longest chain.
    """
    a, b = links.columns
    edges = settle(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        edges = settle(_small_star(_large_star(edges)), "stars")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
