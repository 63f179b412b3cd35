"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, root)``, one row per node that
    occurs in a link, ``root`` the smallest node reachable.

    Every round points each node at the smallest node of its neighbourhood
    (first for larger, then for smaller neighbours) until the links form stars.
    Rounds grow with the logarithm of the longest chain. Minima are combined
    before the shuffle and links are made distinct, so a hub costs one row per
    neighbour; the joins are plain equi-joins that adaptive execution splits on
    skew. Each round's links are written to the shared folder, and only a row
    count and a checksum reach the driver. Self links and nulls are ignored; an
    empty table gives an empty result.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _mark(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b"), F.col("b")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point at the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b"), F.col("a")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point at the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct())
