"""Near-duplicate vectors through an index of pivot permutations.

Every vector is described by its nearest pivots in order, and listed under them: the
inverted lists of (label, pivot). Vectors that share enough of their nearest pivots are
candidates; the share is counted inside the lists, and candidates are verified by their
cosine in double precision. Nothing below the threshold is linked.

Sets of 12 pivots that share 4 or more also share one of their 9 lowest pivots, so a
vector is listed under those 9 only, and a pair is looked at in the list of its lowest
common pivot alone. Lists of any length are worked on in blocks (see
:mod:`webtally.llm.blocks`); all rows are indexed.

The pivots are a sample of at most ``MAX_PIVOTS`` vectors, twice the square root of
their number below that, no two of them at a cosine of ``APART`` or more: a group of near
copies, however large, has one pivot, and its members agree on the others. Where fewer
than ``NEAREST`` are that far apart, all vectors are compared. On vectors at a cosine of
0.93, right at the default threshold, between 0.994 and 1 of the pairs share enough
pivots, for 64 to 1,024 pivots.

Defined results: vectors that are NULL, zero, empty or hold NULL or non-finite components,
and vectors without a label, link with nothing; so do vectors of different lengths. Rows
that repeat a vec_id are one vector (of several, the largest counts) and give one row.
Rows without a vec_id take no part: each gives a row of its own with a NULL component,
kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webtally.llm.blocks import gathered, groups_of, linked, pairs_in, shared_buckets, within_block
from webtally.llm.components import components
from webtally.llm.workspace import ship_package, slices, stored

THRESHOLD = 0.93
# Pivots that describe a vector, and how many of them a candidate must share.
NEAREST, SHARED = 12, 4
MAX_PIVOTS = 1024
# No two pivots are at this cosine or closer; TRIED times their number of vectors are looked at for them.
APART, TRIED = 0.8, 4
BLOCK_MEMBERS = 1024
# List of the vectors for whose length there are too few pivots: all of them are compared.
NO_PIVOT = -1


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision, scaled to length 1; scaled down first, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _usable(vectors: DataFrame) -> DataFrame:
    """One row per vector that can link with anything: ``vec_id, label, size, vector``."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0)
    )
    single = usable.groupBy("vec_id").agg(F.max(F.struct("label", "vector")).alias("own"))
    return single.select("vec_id", "own.label", F.size("own.vector").alias("size"), "own.vector")


def choose_pivots(vectors: DataFrame, most: int = MAX_PIVOTS, apart: float = APART) -> dict[int, np.ndarray]:
    """By length of vector, the pivots: at most ``most`` in all of a sample by hash, those closer to an earlier one left out."""
    n = vectors.count()
    number = max(1, min(most, max(4 * NEAREST, 2 * int(n**0.5))))
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(TRIED * number).select("size", "vector").toArrow()
    sizes = sample["size"].to_numpy()
    by_size = {}
    places = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        values = sample["vector"].take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        unit = _unit(values.astype(np.float64).reshape(-1, size))
        free, kept = np.ones(len(unit), bool), []
        for i in range(len(unit)):
            if free[i]:
                kept.append(i)
                free &= unit @ unit[i] < apart
        by_size[size] = (unit[kept], at[kept])
        places.append(at[kept])
    places = np.sort(np.concatenate([np.empty(0, np.int64), *places]))[:number]
    chosen = {size: unit[np.isin(at, places)] for size, (unit, at) in by_size.items()}
    return {size: unit for size, unit in chosen.items() if len(unit) >= NEAREST}


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The index rows: ``vec_id, label, size, nearest`` (pivots in order) and the unit ``vector``."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # MAX_PIVOTS vectors at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes = part["size"].to_numpy()
            nearest, units = [None] * len(sizes), [None] * len(sizes)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                values = part["vector"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                unit = _unit(values.astype(np.float64).reshape(-1, size))
                own = shared.value.get(size)
                order = np.argsort(-(unit @ own.T), axis=1, kind="stable")[:, :NEAREST] if own is not None else None
                for i, row in enumerate(at):
                    units[row] = unit[i].tobytes()
                    nearest[row] = order[i].astype(np.int32) if order is not None else np.array([NO_PIVOT], np.int32)
            yield pa.record_batch(
                [*(part[c] for c in ("vec_id", "label", "size")), pa.array(nearest, pa.list_(pa.int32())), pa.array(units, pa.binary())],
                names=["vec_id", "label", "size", "nearest", "vector"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, size int, nearest array<int>, vector binary"
    return vectors.select("vec_id", "label", "size", "vector").mapInArrow(rows, schema)


def _near(unit: np.ndarray, nearest: list[list[int]], side: np.ndarray, same: bool, pivot: int, threshold: float):
    """Pairs of a list's block that share enough pivots, this one as the lowest, and reach the threshold."""
    left, right = pairs_in(side, same)
    if pivot != NO_PIVOT:
        described = np.array(nearest)
        member = np.zeros((len(unit), int(described.max()) + 1), np.float32)
        member[np.arange(len(unit))[:, None], described] = 1
        lower = member[:, :pivot]
        candidate = ((member @ member.T) >= SHARED) & ((lower @ lower.T) == 0)
        keep = candidate[left, right]
        left, right = left[keep], right[keep]
    cosine = unit @ unit.T if len(left) > len(unit) else None
    reach = cosine[left, right] if cosine is not None else np.einsum("ij,ij->i", unit[left], unit[right])
    return left[reach >= threshold], right[reach >= threshold]


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Only vectors of equal label are compared. ``n_links`` is the number of other vectors
    linked directly, ``component_id`` the smallest vec_id reachable, ``kept`` whether that
    is the vector itself.
    """
    ship_package(vectors.sparkSession)
    own = vectors.select(
        vectors[f"`{key}`"].alias("vec_id"), vectors[f"`{label}`"].alias("label"), vectors[f"`{vector}`"].alias("vector")
    )
    usable = stored(_usable(own), "vectors")
    index = stored(describe(usable, choose_pivots(usable, max_pivots, min(APART, threshold))), "pivot-index")

    listed = F.slice(F.sort_array("nearest"), 1, NEAREST - SHARED + 1)
    lists = index.select("vec_id", "label", "size", F.explode(listed).alias("pivot"), F.lit(1).alias("one"))
    group = ["label", "size", "pivot", "lo", "hi"]
    members = shared_buckets(lists, group[:3], "vec_id", "one", BLOCK_MEMBERS).drop("one")
    members = members.join(index.select("vec_id", "nearest", "vector"), "vec_id")
    kind = own.schema["vec_id"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, group):
            unit = np.frombuffer(b"".join(t["vector"].to_pylist()), np.float64).reshape(t.num_rows, -1)
            side, nearest = t["side"].to_numpy(), t["nearest"].to_pylist()
            left, right = _near(unit, nearest, side, within_block(t), t["pivot"][0].as_py(), threshold)
            if len(left):
                total, root = linked(len(unit), left, right, np.ones(len(unit), np.int64))
                some = np.flatnonzero(total)
                ids = t["vec_id"].combine_chunks()
                yield pa.record_batch(
                    [ids.take(pa.array(some)), ids.take(pa.array(root[some])), pa.array(total[some])],
                    names=["vec_id", "other", "links"],
                )

    found = gathered(members, group).mapInArrow(verify, f"vec_id {kind}, other {kind}, links bigint")
    found = stored(found, "vector-links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    every = own.where("vec_id IS NOT NULL").select("vec_id").distinct()
    rows = (
        every.join(links, "vec_id", "left")
        .join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    )
    without_id = own.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("bigint"), "vec_id")
    return rows.union(without_id).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
