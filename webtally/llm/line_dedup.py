"""Lines that repeat across documents, dropped with the help of levelled sorted runs.

A line's key is the line without white space at its ends and with A-Z in lower case.
Keys are kept as 128-bit hashes in *runs*: tables bucketed and sorted by hash, each row
with the number of documents that hold the key and, in the run that met it first, the
document that keeps it. A new batch of documents is grouped, anti-joined with the runs
by merging sorted buckets, and added as a run of level 0. ``fanout`` runs of a level are
merged into one of the next level, so that a hash is rewritten once per level only.

:func:`dedup_lines` takes documents in batches from the largest id down: a key that the
runs do not know yet is kept by the largest id that will ever hold it.

Defined results: NULL and empty texts are one empty line, which is too short to drop.
Rows that repeat a doc_id are one document. Rows without a doc_id are left as they are
and hold no line for others. Lines of any length are hashed whole. An empty table gives
no rows. Other columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from webtally.llm.workspace import keyed_texts, new_folder, ship_package, slices, stored

# Fixed value: what is stripped at the ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"

FANOUT = 3
BATCHES = 4


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """Hash of every line's key, None for keys of fewer code points than ``min_chars``."""
    keys: list[bytes | None] = []
    for line in text.encode().split(b"\n"):
        key = line.strip(BLANKS).lower()
        long_enough = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        keys.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return keys


def document_lines(docs: DataFrame, min_chars: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line``: the distinct keys of every document."""
    ship_package(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [{k for k in line_keys(t or "", min_chars) if k} for t in part.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            lines = pa.array([k for x in found for k in x], pa.binary())
            yield pa.record_batch([part.column(0).take(pa.array(rows)), lines], names=["doc_id", "line"])

    texts = keyed_texts(docs, key, text).where("doc_id IS NOT NULL")
    return texts.mapInArrow(rows, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, line binary")


class LineRuns:
    """Levelled sorted runs in the shared folder: ``line, n_docs, holder``."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"webtally_run_{uuid.uuid4().hex}"
        placed = run.repartition(self.buckets, "line")
        writer = placed.write.bucketBy(self.buckets, "line").sortBy("line")
        writer.option("path", new_folder(self.spark, "line-run")).saveAsTable(name, format="parquet")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """One row per key of several runs, by merging their sorted buckets pair by pair."""

        def merge(left: DataFrame, right: DataFrame) -> DataFrame:
            a, b = left.alias("a"), right.alias("b")
            return a.join(b, F.col("a.line") == F.col("b.line"), "full_outer").select(
                F.coalesce("a.line", "b.line").alias("line"),
                (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"),
                F.greatest("a.holder", "b.holder").alias("holder"),
            )

        return reduce(merge, [self.spark.table(name) for name in names])

    def contents(self) -> DataFrame:
        """All keys with their number of documents and their holder."""
        return self._merged(self.names())

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``doc_id, line``. Its documents must be in none of the runs yet.

        Keys that no run knows are held by the batch's largest document from now on; of
        the others the batch only adds its number of documents.
        """
        batch = lines.groupBy("line").agg(
            F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("holder")
        )
        if self.names():
            fresh = batch
            for name in self.names():
                fresh = fresh.join(self.spark.table(name).select("line"), "line", "left_anti")
            batch = batch.drop("holder").join(fresh.select("line", "holder"), "line", "left")
        self._write(batch, 0)
        self._compact()

    def _compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                self._write(self._merged(names), level + 1)
                self.levels[level] = []
                for name in names:
                    self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        """Take the runs out of the catalog; their folders go with the workspace."""
        for name in self.names():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def batch_number(lines: DataFrame, batches: int) -> Column:
    """Number of the batch of a document, from the largest ids down. Equal ids share a batch."""
    if batches < 2 or not isinstance(lines.schema["doc_id"].dataType, T.NumericType):
        return F.lit(0)
    cuts = lines.agg(
        F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("cuts")
    ).first()["cuts"]
    return sum((F.when(F.col("doc_id") <= cut, 1).otherwise(0) for cut in cuts or []), F.lit(0))


def repeated_lines(
    docs: DataFrame,
    min_docs: int = 5,
    min_chars: int = 40,
    key: str = "doc_id",
    text: str = "text",
    batches: int = BATCHES,
) -> DataFrame:
    """``doc_id, dropped``: the keys whose lines a document loses, for documents that lose any."""
    spark = docs.sparkSession
    lines = stored(document_lines(docs, min_chars, key, text), "lines")
    runs = LineRuns(spark)
    number = batch_number(lines, batches)
    for i in range(batches):
        runs.add(lines.where(number == i))
    frequent = stored(runs.contents().where(F.col("n_docs") >= min_docs).select("line", "holder"), "frequent-lines")
    runs.close()
    lost = lines.join(frequent, "line").where(F.col("doc_id") != F.col("holder"))
    return lost.groupBy("doc_id").agg(F.collect_set("line").alias("dropped"))


def _without(min_chars: int):
    """Column function: a text without the lines whose keys are listed, and the numbers of lines."""

    @F.arrow_udf("struct<text:string, n_lines:bigint, n_dropped:bigint>")
    def without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        kept, n_lines, n_dropped = [], [], []
        for text, keys in zip(texts.to_pylist(), dropped.to_pylist()):
            text = text or ""
            total, lost = text.count("\n") + 1, 0
            if keys:
                gone = set(keys)
                lines = [x for x, k in zip(text.split("\n"), line_keys(text, min_chars)) if k not in gone]
                text, lost = "\n".join(lines), total - len(lines)
            kept.append(text)
            n_lines.append(total)
            n_dropped.append(lost)
        fields = [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        return pa.StructArray.from_arrays(fields, ["text", "n_lines", "n_dropped"])

    return without


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 5,
    min_chars: int = 40,
    key: str = "doc_id",
    text: str = "text",
    batches: int = BATCHES,
) -> DataFrame:
    """All columns of the documents, then ``deduped`` (the new text, line counts) as a struct.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents
    lose all their lines except in the largest ``key`` that holds them.
    """
    lost = repeated_lines(docs, min_docs, min_chars, key, text, batches)
    # positions instead of names: the documents may have columns of any name
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_column, text_column = (own.columns[docs.columns.index(x)] for x in (key, text))
    joined = own.join(lost, own[id_column] == lost["doc_id"], "left")
    return joined.select(
        *[own[c].alias(name) for c, name in zip(own.columns, docs.columns)],
        _without(min_chars)(own[text_column], lost["dropped"]).alias("deduped"),
    )
