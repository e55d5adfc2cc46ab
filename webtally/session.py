"""Session settings for local runs and tests; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", memory: str = "8g", checkpoint_dir: str | None = None) -> SparkSession:
    """A local session. Shuffle partitions follow the cores, which suits one machine only.

    ``checkpoint_dir`` is for machines whose Spark settings name none.
    """
    partitions = 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("webtally")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        # Joins of partitions whose smaller side is below this hash it instead of sorting both sides.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir is not None:
        builder = builder.config(CHECKPOINT_DIR, checkpoint_dir)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
