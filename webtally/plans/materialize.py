"""Keeping a result that several jobs read."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from webtally.session import CHECKPOINT_DIR
from webtally.sources import write_bucketed

# What to call to drop the results kept so far, by the scopes they belong to.
_scopes: list[list[Callable[[], object]]] = [[]]


def shared_folder(df: DataFrame) -> str | None:
    """The folder the cluster names for checkpoints, which every executor can reach."""
    return df.sparkSession.conf.get(CHECKPOINT_DIR, None)


@contextmanager
def scratch() -> Iterator[None]:
    """Drop at the end what :func:`materialize` keeps in between: folders, tables and persisted rows.

    Results that are kept outside of any such scope go when the driver ends.
    """
    made: list[Callable[[], object]] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for drop in reversed(made):
            drop()


def _delete(session: SparkSession, path: str) -> None:
    place = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _drop_the_rest() -> None:
    for drop in _scopes[0]:
        try:
            drop()
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


def materialize(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so that later jobs neither repeat nor depend on its plan.

    A Parquet table in the shared folder survives lost executors, is compressed and
    keeps column pruning. Without such a folder the rows are persisted on the
    executors' disks, where Spark recomputes what gets lost. Only paths made here are ever deleted.

    ``bucket_by`` buckets the table by a key, which costs one shuffle and spares one in
    every later match by that key. It needs a catalog to hold the table's name, and a
    number of ``buckets`` such that one of them suits one task.
    """
    folder, session = shared_folder(df), df.sparkSession
    if bucket_by is not None and (folder is None or buckets is None):
        raise ValueError(f"a bucketed table needs a number of buckets and a shared folder; set {CHECKPOINT_DIR}")
    if folder is None:
        kept = df.persist(StorageLevel.DISK_ONLY)
        _scopes[-1].append(kept.unpersist)
        return kept
    label = f"webtally-{name}-{uuid.uuid4().hex}"
    path = f"{folder.rstrip('/')}/{label}"
    _scopes[-1].append(lambda: _delete(session, path))
    if bucket_by is None:
        df.write.parquet(path)
        return session.read.schema(df.schema).parquet(path)
    table = label.replace("-", "_")
    _scopes[-1].append(lambda: session.sql(f"DROP TABLE IF EXISTS {table}"))
    write_bucketed(df, table, bucket_by, buckets, path)
    return session.table(table)
