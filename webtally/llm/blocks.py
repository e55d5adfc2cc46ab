"""Pairs within buckets of any size, as work on blocks of bounded size.

Similarity joins find their candidates among rows that share a bucket. A bucket may
hold a third of all rows, so it is cut into blocks by a hash of the row's id, and every
two blocks (and every block with itself) are one group of work. What a group finds is
summed up per row before it leaves the task; pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def shared_buckets(members: DataFrame, bucket: Sequence[str], row: str, weight: str, most: int) -> DataFrame:
    """Members of buckets with two rows or more, once per group of work they take part in.

    Adds ``lo`` and ``hi``, the two blocks of the group, and ``side``: 0 for rows of the
    first block. In a group of a block with itself all rows have side 0. A block has
    about ``most`` of ``weight`` in all.
    """
    sizes = members.groupBy(*bucket).agg(F.count("*").alias("_n"), F.sum(weight).alias("_weight")).where("_n > 1")
    sizes = sizes.select(*bucket, F.ceil(F.col("_weight") / most).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64(row, F.lit(7)), F.col("_blocks")).cast("int")
    placed = members.join(sizes, list(bucket)).withColumn("_own", own)
    one = F.col("_blocks") <= 1
    other = F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    groups = placed.withColumn("_other", F.explode(other))
    return groups.select(
        *members.columns,
        F.least("_own", "_other").alias("lo"),
        F.greatest("_own", "_other").alias("hi"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"),
    )


def gathered(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """The rows of a group together in one task, one group after the other."""
    return df.repartition(*group).sortWithinPartitions(*group)


def groups_of(batches: Iterator[pa.RecordBatch], group: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the columns of ``group``, whole across batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in group]
        change = np.zeros(batch.num_rows, bool)
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(starts[:-1], starts[1:]):
            key = tuple(values[begin] for values in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def sides(side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a group on the left and on the right of its pairs; the same array for the ``same`` block with itself."""
    if not same:
        return np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    rows = np.arange(len(side))
    return rows, rows


def pairs_in(side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group: all of them within the ``same`` block, or each row of one side with each of the other."""
    if not same:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        return np.repeat(left, len(right)), np.tile(right, len(left))
    return np.triu_indices(len(side), 1)


def within_block(group: pa.Table) -> bool:
    """Whether a group is a block with itself. One of two blocks, of which one is empty, is not: it has no pairs."""
    return group["lo"][0] == group["hi"][0]


def linked(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` rows linked by pairs: the weight of each row's partners, and the smallest row it is connected with."""
    total = np.zeros(n, np.int64)
    np.add.at(total, left, weight[right])
    np.add.at(total, right, weight[left])
    root = np.arange(n)
    while True:
        lower = root.copy()
        np.minimum.at(lower, left, root[right])
        np.minimum.at(lower, right, root[left])
        lower = lower[lower]
        if (lower == root).all():
            return total, root
        root = lower
