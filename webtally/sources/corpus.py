"""Reading a corpus and writing corpora and report tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The fields the operators read. Declaring them means that no pass over the
# files infers a schema, and that a field missing from a record is NULL.
CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField(
            "meta",
            T.StructType(
                [
                    T.StructField(
                        "warc_headers",
                        T.StructType([T.StructField("warc-target-uri", T.StringType())]),
                    )
                ]
            ),
        ),
    ]
)


def read_corpus(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    lang: str | None = None,
    split: str | None = None,
) -> DataFrame:
    """Read a corpus and keep one language configuration and split.

    Parquet and ORC carry their schema. For JSON lines ``CORPUS_SCHEMA`` is the
    default, and a type that does not fit the file's fails the read. On a layout written by :func:`write_corpus` the ``lang`` and
    ``split`` choices prune directories instead of reading and filtering rows.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "json":
        partitions = [T.StructField(c, T.StringType()) for c, v in (("lang", lang), ("split", split)) if v is not None]
        # a malformed record fails: an id of another type must not be read as NULL
        reader = reader.schema(T.StructType(CORPUS_SCHEMA.fields + partitions)).option("mode", "FAILFAST")
    paths = [path] if isinstance(path, str) else list(path)
    return select_corpus(reader.load(paths), lang=lang, split=split)


def with_input_order(df: DataFrame, name: str = "input_order") -> DataFrame:
    """Add a unique, orderable key from the place of each row in the files that ``df`` reads.

    For tables without a key of their own. In Parquet that is the file's path and the row in it.
    Other formats do not number their rows: there it is the path, the byte at which the row's split of the
    file starts, and the row's place among those that its task has read. A task reads a split from front to
    back, so these ascend within it. The same files and split sizes give the same keys in every
    run, and no sort or numbering job is needed. Add it to the table as read, before any filter or shuffle.
    """
    file = F.col("_metadata.file_path").alias("file")
    if "row_index" in df.select("_metadata").schema["_metadata"].dataType.names:
        place = F.struct(file, F.col("_metadata.row_index").alias("row"))
    else:
        # the number of the partition is above these bits
        row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        place = F.struct(file, F.col("_metadata.file_block_start").alias("split"), row.alias("row"))
    return df.select(place.alias(name), *[F.col(f"`{c}`") for c in df.columns])


def select_corpus(df: DataFrame, lang: str | None = None, split: str | None = None) -> DataFrame:
    """Keep the rows of one language and split; ``None`` keeps all."""
    for column, value in (("lang", lang), ("split", split)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def write_corpus(df: DataFrame, path: str, partition_by: Sequence[str] = ("lang",), fmt: str = "parquet") -> None:
    """Write a corpus so that later reads of one language touch only its folder.

    The rebalance collects the rows of a folder into files of the advisory partition
    size: a common language is split over many tasks, and the tasks do not each
    leave a small file for every rare one.
    """
    df.hint("rebalance", *partition_by).write.mode("overwrite").format(fmt).partitionBy(*partition_by).save(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Save a corpus as a table bucketed by its key, one file per bucket.

    The duplicate operators match rows by key. On such a table they read each bucket
    where it lies and shuffle digests and keys only, never the texts. Choose
    ``buckets`` so that one bucket suits one task.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table, format="parquet")


MANIFESTS = "manifests"


def write_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write each report table (chart data, weights, metrics) to its own folder under ``path``, over what is there.

    :func:`publish_tables` is for reports that are read while they are written again.
    """
    for name, table in tables.items():
        table.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")


def publish_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> str:
    """Write report tables so that they appear together, and return their folder.

    Each run has a folder of its own under ``path``, with one folder per table. A manifest with the names
    of the tables is written last, as one file. :func:`read_tables` follows the newest manifest, so a run
    that fails leaves what was there before, and a reader never sees tables of two runs.
    """
    if not tables:
        raise ValueError("no tables to write")
    root = path.rstrip("/")
    started = time.time_ns()
    run = f"run-{started:020d}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.format(fmt).save(f"{root}/{run}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.range(1).select(F.lit(run).alias("run"), F.lit(fmt).alias("format"), F.array(*map(F.lit, tables)).alias("tables"))
    manifest.coalesce(1).write.mode("append").json(f"{root}/{MANIFESTS}")
    return f"{root}/{run}"


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest finished run that :func:`publish_tables` has written to ``path``."""
    root = path.rstrip("/")
    schema = "run string, format string, tables array<string>"
    newest = spark.read.schema(schema).json(f"{root}/{MANIFESTS}").orderBy(F.desc("run")).first()
    return {name: spark.read.format(newest["format"]).load(f"{root}/{newest['run']}/{name}") for name in newest["tables"]}
