"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b of one orderable type. Returns node, root: the smallest node of each component.

    Every step is a grouped minimum with map-side combine and an equi-join; nothing is gathered
    by key, so a hub of any degree costs a row per link.
    """
    edges = keep(_oriented(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    seen = _print(edges)
    while seen[0]:
        edges = keep(_small(_large(edges)), "edges")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _oriented(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour, or to itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(moved)


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
