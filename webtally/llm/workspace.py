"""Shared storage for what an operator keeps between jobs, and the package on the workers' path."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from webtally.session import CHECKPOINT_DIR

PACKAGE = Path(__file__).resolve().parents[1]

_made: dict[int, list[str]] = {}
_shipped: set[int] = set()


# Rows that go to a Python worker at a time. Texts are long: the default of 10,000 rows would
# be held several times over, in the executor and in the worker.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run, and send them batches of bounded size."""
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    context = spark.sparkContext
    if id(context) in _shipped:
        return
    handle, path = tempfile.mkstemp(prefix="webtally-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))
    _shipped.add(id(context))


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where it names none."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root is None:
        root = tempfile.mkdtemp(prefix="webtally-checkpoints-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends or by :func:`clear`."""
    path = f"{shared_root(spark)}/webtally-{name}-{uuid.uuid4().hex}"
    made = _made.setdefault(id(spark.sparkContext), [])
    if not made:
        atexit.register(_clear_quietly, spark)
    made.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Remove the folders made in this application. DataFrames that read them end with it."""
    for path in _made.pop(id(spark.sparkContext), []):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _clear_quietly(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: what several jobs read is made once and outlives lost executors.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, so that no other column of the documents can clash or is read."""
    return docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))


# Bytes of a batch that an operator works on at once, unless a single row has more.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in parts of a few megabytes, so that what is made from a part stays small too."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
