"""Rows in order without a window over all of them: sorted by ranges, and numbered within each range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from webtally.llm.workspace import stored

# monotonically_increasing_id has the partition above this bit, and the row in it below.
PART_BIT = 33


def in_order(df: DataFrame, ranges: Sequence[Column], order: Sequence[Column], keep: Sequence[Column], name: str) -> DataFrame:
    """``part, row`` and the columns to keep: rows by ``order``, written once, ``row`` counting from 0 in every part.

    Parts hold ascending ranges of ``ranges``, which ``order`` must agree with; a sample of
    their values comes to the driver, so they should be short.
    """
    ranged = df.repartitionByRange(*ranges).sortWithinPartitions(*order)
    placed = ranged.select(*keep, F.monotonically_increasing_id().alias("_place"))
    row = F.col("_place").bitwiseAND((1 << PART_BIT) - 1)
    return stored(placed.select(F.shiftright("_place", PART_BIT).alias("part"), row.alias("row"), "*").drop("_place"), name)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """The rows with their ``place`` in the order, from 0. One row per part, of its size, comes to the driver."""
    rows = in_order(df, order, order, [F.col(f"`{c}`") for c in df.columns], name)
    before, starts = 0, []
    for part, size in sorted(tuple(x) for x in rows.groupBy("part").agg(F.count("*")).collect()):
        starts.append((part, before))
        before += size
    table = df.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    return rows.join(F.broadcast(table), "part").withColumn("place", F.col("start") + F.col("row")).drop("part", "row", "start")


def places_within(rows: DataFrame, key: str) -> DataFrame:
    """Rows of :func:`in_order`, with their ``place`` among those of the same key, from 1.

    A key whose rows fill many parts is handled part by part: its own window sees one row per part.
    """
    marks = rows.groupBy(key, "part").agg(F.min("row").alias("_first"), F.count("*").alias("_size"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    place = F.col("_before") + F.col("row") - F.col("_first") + 1
    return rows.join(marks, [key, "part"]).withColumn("place", place).drop("part", "row", "_first", "_size", "_before")
