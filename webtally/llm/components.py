"""Connected components of a table of edges, by stars that are made larger and smaller in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webtally.llm.workspace import stored


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` that is not the smallest of its component.

    Each round links all neighbours of a node to the smallest one, first the larger
    neighbours, then the smaller ones, until nothing changes: every component is then a
    star around its smallest node. Takes a number of rounds that grows with the logarithm
    of the size of the components. Rounds are written, so that none repeats those before it.
    """
    known = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    stars = edges.where(known).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    stars = stored(stars, "edges")
    before = _fingerprint(stars)
    while before[0]:
        both = stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(stars.select("root", "node"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.join(least, "a").where("b > a").select(F.col("b").alias("node"), F.col("m").alias("root")).distinct()
        lowest = larger.groupBy("node").agg(F.min("root").alias("m"))
        smaller = larger.join(lowest, "node").where("root != m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        stars = stored(smaller.union(lowest).distinct(), "edges")
        after = _fingerprint(stars)
        if after == before:
            break
        before = after
    return stars
