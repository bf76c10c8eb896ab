"""Intermediate tables in the shared folder of the cluster.

Lineage is cut by tables written there, so a lost executor costs no more than
its running tasks. The folder is the one that ``spark.checkpoint.dir`` names;
only where that is unset (a local session, tests) one of this machine is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackleaf.sources.tables import small_batches, work_folder

# A side is broadcast only if its counted rows times the bytes of a row stay below this.
BROADCAST_BYTES = 16 << 20


def quoted(name: str) -> str:
    """A column name that may hold dots and the like."""
    return "`" + name.replace("`", "``") + "`"


def struct_ddl(df: DataFrame, column: str) -> str:
    """A struct column with its type, for the schema of a map over rows."""
    fields = ", ".join(f"{quoted(f.name)}: {f.dataType.simpleString()}" for f in df.schema[column].dataType.fields)
    return f"{column} struct<{fields}>"


class Scratch:
    """The intermediate tables of one operator call, and small Arrow batches for it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        small_batches(spark)
        self.spark = spark
        self.folder = work_folder(spark, name)
        self.made = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write a table and read it back."""
        self.made += 1
        path = f"{self.folder}/{self.made:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def small(saved: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """A saved table, marked for broadcast if counting it finds it small enough;
    otherwise it is left to the shuffle joins."""
    most = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(saved) if saved.count() * row_bytes <= most else saved
