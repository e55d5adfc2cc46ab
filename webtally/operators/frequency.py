"""Frequency tables and what is read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def value_counts(df: DataFrame, column: str, counts: str = "counts") -> DataFrame:
    """Rows per value, nulls left out. Partial counts are made before the shuffle."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(counts))


def by_frequency(freq: DataFrame, column: str, counts: str = "counts") -> DataFrame:
    """Most frequent first; equal counts in order of the value."""
    return freq.orderBy(F.desc(counts), F.asc(column))


def top(freq: DataFrame, column: str, n: int, counts: str = "counts") -> DataFrame:
    """The ``n`` most frequent values, as a top-k without a full sort."""
    return by_frequency(freq, column, counts).limit(n)


def at_least(freq: DataFrame, minimum: int, counts: str = "counts") -> DataFrame:
    """Values that occur at least ``minimum`` times."""
    return freq.where(F.col(counts) >= minimum)


def distinct_values(freq: DataFrame, name: str = "n_distinct") -> DataFrame:
    """Number of values in a frequency table."""
    return freq.agg(F.count("*").alias(name))


def approx_distinct(df: DataFrame, column: str, name: str = "n_distinct", rsd: float = 0.02) -> DataFrame:
    """Estimated number of values, with relative error ``rsd``; shuffles one sketch per task."""
    return df.agg(F.approx_count_distinct(column, rsd).alias(name))


# Registers of a sketch, as a power of two: its standard error is 1.04 / 2^(bits / 2), 0.8 % for 14.
SKETCH_BITS = 14


def distinct_sketches(df: DataFrame, column: str, by: Sequence[str], bits: int = SKETCH_BITS) -> DataFrame:
    """``by, sketch``: a sketch of the values of each group, NULL left out, to be stored and merged later.

    Each is of bounded size whatever the group, and one per task and group is shuffled.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(bits)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups, or of several runs; values that occur in many of them count once."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_distinct(sketches: DataFrame, name: str = "n_distinct") -> DataFrame:
    """Estimated numbers of values, in place of the sketches."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


def reconcile(freq: DataFrame, column: str, expected: Column, counts: str = "counts") -> DataFrame:
    """Compare the total of a frequency table that kept its null group with ``expected``.

    ``ok`` says whether the counts of the real values alone reach the total.
    """
    known = F.col(column).isNotNull()
    totals = freq.agg(
        F.coalesce(F.sum(F.when(known, F.col(counts))), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum(F.when(~known, F.col(counts))), F.lit(0)).cast("bigint").alias("null_rows"),
    )
    return totals.select(
        "total", expected.cast("bigint").alias("expected"), "null_rows"
    ).withColumn("ok", F.col("total") == F.col("expected"))


def treemap_nodes(freq: DataFrame, path: Sequence[str], value: str = "counts", separator: str = "/") -> DataFrame:
    """Node table of a treemap: one node per prefix of ``path``, with its total and share.

    Columns ``id, label, parent, value, share``; the nodes of the first level have
    the parent ``''``. The grand total comes from a scalar subquery: a window over
    the whole table would put every node into one task.
    """
    total = freq.agg(F.sum(value)).scalar()
    levels = list(path)
    if len(levels) == 1:
        nodes = freq.groupBy(*levels).agg(F.sum(value).alias("value"), F.lit(1).alias("level"))
    else:
        nodes = freq.rollup(*levels).agg(
            F.sum(value).alias("value"),
            # grouping_id sets one bit for every column rolled up, from the right
            (F.lit(len(levels)) - F.bit_count(F.grouping_id())).alias("level"),
        ).where(F.col("level") > 0)
    names = F.array(*[F.col(c).cast("string") for c in levels])
    return nodes.select(
        F.array_join(F.slice(names, 1, F.col("level")), separator).alias("id"),
        F.get(names, F.col("level") - 1).alias("label"),
        F.array_join(F.slice(names, 1, F.col("level") - 1), separator).alias("parent"),
        F.col("value"),
        (F.col("value") / total).alias("share"),
    )
