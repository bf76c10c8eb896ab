"""Table reading and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of keys a side may have to be broadcast.
MAX_BROADCAST_ROWS = 1_000_000
# Bytes of an Arrow batch of rows on their way to a Python worker. Without a bound on
# bytes a batch is a whole input split, held by both sides at once.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Even out an input with fewer splits than there are cores, ahead of
    heavy per-row work. Large inputs have more splits than cores and pass
    through without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it has a lower bound already.
    A longer row is a batch of its own. Results don't depend on it."""
    size = re.fullmatch(r"(\d+)([kmgtp]?)b?", str(spark.conf.get(_BATCH_SETTING)).lower())
    if size is None or int(size[1]) << 10 * " kmgtp".find(size[2] or " ") > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names in
    ``spark.checkpoint.dir``. Only where that is unset (a local session, tests)
    a temporary folder of this machine is used, and the setting is filled in."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="stackleaf-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark the key table for broadcast if a count finds it small; a larger one
    is left to the shuffle joins. Meant for cheap inputs (it runs them twice)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
