"""Near-duplicate documents: a join on the Jaccard similarity of their word n-grams.

Every text becomes the set of its runs of five words (all its words where it has fewer).
Texts with equal sets are one class, compared once. Classes whose MinHash signatures agree
in a band are candidates. A candidate's MinHash values are then compared a few at a time,
and the pair is dropped as soon as the probability that its similarity reaches the
threshold, given the matches so far and a uniform prior, is below a tolerance. What is
left is verified on the whole sets.

With the default 32 bands of 4 values a pair at the threshold of 0.8 is missed as a
candidate with a probability of 5e-8, and the pruning tolerance is 1e-7; both fall
quickly above the threshold. Nothing below the threshold is linked.

Buckets of any size are worked on in blocks (see :mod:`webtally.llm.blocks`), and a pair
only in the first band it shares.

Defined results: NULL and empty texts, and texts of blanks, have no n-grams and link with
nothing. Rows that repeat a doc_id are one document (of several texts, the one with the
largest digest counts) and give one row. Rows without a doc_id take no part: each gives a
row with a NULL class, no links, and is kept. Ties cannot arise: the smallest doc_id of a
component stands for it. Texts of any length are used whole. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webtally.llm.blocks import gathered, groups_of, linked, shared_buckets, sides, within_block
from webtally.llm.components import components
from webtally.llm.wording import gram_hashes, per_row, words_of
from webtally.llm.workspace import keyed_texts, ship_package, slices, stored

NGRAM = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
TOLERANCE = 1e-7
# MinHash values compared between two looks at the posterior.
STEP = 16
# Members of a block; one with many n-grams counts once for each so many.
BLOCK_MEMBERS = 1024
GRAMS_OF_A_MEMBER = 512
# Columns of the incidence matrix multiplied at once.
COLUMNS = 1024
# Pairs whose MinHash values are compared at once.
PAIRS = 1 << 16

_random = np.random.default_rng(11)
_FACTOR = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes, 16 bits of each."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


@lru_cache(maxsize=8)
def fewest_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """Per look: the fewest matches that keep the posterior of reaching the threshold at the tolerance.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1); its
    tail above t is the chance of at most m successes in n + 1 trials of probability t.
    """
    fewest = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        fewest.append(m)
    return tuple(fewest)


def surviving(
    values: np.ndarray, side: np.ndarray, band: int, threshold: float, tolerance: float, same: bool | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group that share no band before this one and outlast the pruning.

    ``same`` tells whether the group is a block with itself; without it, a group of one side is.
    """
    rows, columns = sides(side, not side.any() if same is None else same)
    # The 16-bit values of a band as one number of 64 bits.
    bands = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint64)[:, : band + 1].T)
    looks = np.ascontiguousarray(values.reshape(len(values), -1, STEP).transpose(1, 0, 2))
    fewest = fewest_matches(threshold, tolerance)
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    height = max(1, PAIRS // max(1, len(columns)))
    for at in range(0, len(rows), height):
        some = rows[at : at + height]
        new = bands[band, some, None] == bands[band, columns]
        if band:
            new &= bands[0, some, None] != bands[0, columns]
        if columns is rows:
            new &= some[:, None] < columns
        left, right = np.nonzero(new)
        parts.append(_outlasting(bands[1:band], looks, some[left], columns[right], fewest))
    left, right = (np.concatenate(x) for x in zip(*parts))
    return left, right


def _outlasting(
    earlier: np.ndarray, looks: np.ndarray, left: np.ndarray, right: np.ndarray, fewest: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray]:
    for band in earlier:
        if not len(left):
            break
        keep = band[left] != band[right]
        left, right = left[keep], right[keep]
    matches = np.zeros(len(left), np.int64)
    for look, least in zip(looks, fewest):
        same = look.take(left, axis=0) == look.take(right, axis=0)
        matches += np.bitwise_count(same.view(np.uint64)).sum(axis=1, dtype=np.int64)
        keep = matches >= least
        if not keep.all():
            left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def reaching(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sorted sets have a Jaccard similarity of at least the threshold, exactly."""
    sizes = np.array([len(x) for x in sets])
    if len(left) < 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)])
    else:
        # A product of incidence matrices, over the grams that two sets or more have. Two
        # blocks give the sets of one as rows and those of the other as columns.
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        rows, columns = np.unique(left), np.unique(right)
        if np.intersect1d(rows, columns, assume_unique=True).size:
            rows = columns = slice(None)
            row, at_column = left, right
        else:
            row, at_column = np.searchsorted(rows, left), np.searchsorted(columns, right)
        products = np.float32(0)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            products = products + part[rows] @ part[columns].T
        common = products[row, at_column].astype(np.int64) if len(column) else np.zeros(len(left), np.int64)
    union = sizes[left] + sizes[right] - common
    return common >= threshold * union - 1e-9 * union


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct n-grams of every text, sorted."""
    for _, rows, hashes, row, _ in words_of(texts):
        bounds = per_row(row, rows)
        for begin, end in zip(bounds[:-1], bounds[1:]):
            yield np.unique(gram_hashes(hashes[begin:end], n))


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _classes(texts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, digest`` of every document, and one row per digest of a set with its signature."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = list(gram_sets(part.column(1), n))
            yield pa.record_batch(
                {
                    "doc_id": part.column(0),
                    "digest": pa.array([digest(x) if len(x) else None for x in sets], pa.binary()),
                    "n_grams": pa.array([len(x) for x in sets], pa.int64()),
                    "signature": _binary([signature(x) for x in sets]),
                }
            )

    schema = f"doc_id {_kind(texts)}, digest binary, n_grams bigint, signature binary"
    signed = texts.where("doc_id IS NOT NULL").mapInArrow(rows, schema)
    single = signed.groupBy("doc_id").agg(F.max(F.struct("digest", "n_grams", "signature")).alias("own"))
    single = stored(single.select("doc_id", "own.*"), "signatures")
    classes = (
        single.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("class"),
            F.count("*").alias("copies"),
            F.first("n_grams").alias("n_grams"),
            F.first("signature").alias("signature"),
        )
    )
    return single.select("doc_id", "digest"), stored(classes, "classes")


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _kind(texts: DataFrame) -> str:
    return texts.schema["doc_id"].dataType.simpleString()


def _band_members(classes: DataFrame) -> DataFrame:
    """``class, band, value, weight``: the value of a band stands for its MinHash values."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bands = classes.select("class", F.hex("signature").alias("h"), "n_grams", band)
    digits = 4 * ROWS
    value = F.substring(F.col("h"), F.col("band") * digits + 1, F.lit(digits))
    weight = F.ceil(F.col("n_grams") / GRAMS_OF_A_MEMBER)
    return bands.select("class", "band", F.xxhash64(value, "band").alias("value"), weight.alias("weight"))


def join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    n: int = NGRAM,
    key: str = "doc_id",
    text: str = "text",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, kept``.

    ``class_id`` is the smallest doc_id reachable by links, ``n_links`` the number of other
    documents linked directly, copies included, ``kept`` whether the document stands for
    its class.
    """
    ship_package(docs.sparkSession)
    texts = keyed_texts(docs, key, text)
    kind = _kind(texts)
    digests, classes = _classes(texts, n)

    # Candidates, signatures only: which members of which groups have a pair to verify.
    group = ["band", "value", "lo", "hi"]
    members = shared_buckets(_band_members(classes), ["band", "value"], "class", "weight", BLOCK_MEMBERS)
    members = members.drop("weight").join(classes.select("class", "signature"), "class")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, group):
            values = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint16).reshape(-1, HASHES)
            side = t["side"].to_numpy()
            left, right = surviving(values, side, t["band"][0].as_py(), threshold, tolerance, within_block(t))
            if len(left):
                needed = pa.array(np.unique(np.concatenate([left, right])))
                yield from t.select(["class", *group, "side"]).take(needed).combine_chunks().to_batches()

    schema = f"class {kind}, band int, value bigint, lo int, hi int, side int"
    needed = stored(gathered(members, group).mapInArrow(prune, schema), "candidates")

    # The sets of the candidates, made anew from their texts.
    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = list(gram_sets(part.column(1), n))
            digests = pa.array([digest(x) for x in sets], pa.binary())
            yield pa.record_batch([part.column(0), digests, _binary(sets)], names=["class", "digest", "grams"])

    candidates = needed.select(F.col("class").alias("doc_id")).distinct()
    sets = texts.join(candidates, "doc_id", "left_semi").mapInArrow(
        make_sets, f"class {kind}, digest binary, grams binary"
    )
    sets = sets.join(classes.select("class", "digest", "copies", "signature"), ["class", "digest"]).dropDuplicates(["class"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, group):
            sets = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
            values = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint16).reshape(-1, HASHES)
            side = t["side"].to_numpy()
            left, right = surviving(values, side, t["band"][0].as_py(), threshold, tolerance, within_block(t))
            near = reaching(sets, left, right, threshold)
            left, right = left[near], right[near]
            if len(left):
                total, root = linked(len(sets), left, right, t["copies"].to_numpy())
                some = np.flatnonzero(total)
                ids = t["class"].combine_chunks()
                yield pa.record_batch(
                    [ids.take(pa.array(some)), ids.take(pa.array(root[some])), pa.array(total[some])],
                    names=["class", "other", "links"],
                )

    whole = needed.join(sets.select("class", "copies", "signature", "grams"), "class")
    found = gathered(whole, group).mapInArrow(
        verify, f"class {kind}, other {kind}, links bigint"
    )
    found = stored(found, "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("other").alias("b")))

    labelled = (
        classes.select("digest", "class", "copies")
        .join(links, "class", "left")
        .join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select(
            "digest",
            F.coalesce("root", "class").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    with_class = digests.join(labelled, "digest", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    without_id = texts.where("doc_id IS NULL").select("doc_id", "doc_id", F.lit(0).cast("bigint"))
    rows = with_class.union(without_id)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
