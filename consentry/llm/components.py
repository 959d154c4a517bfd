"""Connected components of links that no one task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consentry.sources.staging import stage


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hang every node's larger (or smaller, and the node itself) neighbours on its least one.

    ``edges`` have ``a`` > ``b``, each once.
    """
    if small:
        both = edges
    else:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    hung = both.join(least, "a")
    if small:
        moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = hung.filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``a`` and ``b`` of links to ``node`` and ``root``, the smallest node it is connected to.

    Alternates large and small stars until nothing changes, which takes a number of rounds
    logarithmic in the longest chain. Nodes that are roots themselves are not listed.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = stage(links.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    while True:
        edges = stage(_stars(_stars(edges, small=False), small=True))
        mark = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
