"""A table kept as versions.

Data files are written once, into a folder of their own for each write, and never
changed. A version is a list of files (a Parquet table, the manifest) and a small
version file that names it. The version file is made by exactly one writer
(``folders.claim``), as the last step; so readers see a version whole or not at
all, keep the version they opened while others write, and of two writers that
started from one version the second finds its number taken and decides again.

What moves through the driver are names of files, as for any table Spark reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stackleaf.operators import ledger as lg
from stackleaf.sources import folders

MANIFEST_SCHEMA = "path string, rows bigint, bytes bigint"
# Attempts of a writer that keeps losing its number to others.
MAX_TRIES = 50


class Versioned:
    """The table in ``folder``, with the columns of ``schema``; files are laid out by ``parts``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, parts: Sequence[str] = ()) -> None:
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), list(parts)
        self.schema = StructType.fromDDL(schema)

    # -- readers ---------------------------------------------------------------

    def latest(self) -> int:
        """The newest version; 0 if there is none."""
        found = folders.names(self.spark, f"{self.folder}/versions", ".json")
        return int(found[-1].removesuffix(".json")) if found else 0

    def notes(self, version: int) -> dict:
        """What the writer of a version noted."""
        return self._entry(version)["notes"] if version else {}

    def _entry(self, version: int) -> dict:
        return json.loads(folders.text_of(self.spark, self._version_file(version)))

    def _version_file(self, version: int) -> str:
        return f"{self.folder}/versions/{version:012d}.json"

    def manifest(self, version: int) -> DataFrame:
        """``path, rows, bytes`` of the files of a version; paths are relative to ``data``."""
        if not version:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.folder}/manifests/{self._entry(version)['manifest']}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest, with their ``file``."""
        return self._rows(self.manifest(self.latest() if version is None else version))

    def _rows(self, manifest: DataFrame) -> DataFrame:
        paths = [f"{self.folder}/data/{row.path}" for row in manifest.select("path").collect()]
        if not paths:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn("file", F.lit("").cast("string"))
        found = self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/data").parquet(*paths)
        return found.select(*self.schema.names, F.col("_metadata.file_path").alias("file"))

    def stale_files(self, keep: int) -> DataFrame:
        """``path`` of files that none of the newest ``keep`` versions holds: of older
        versions, and of writers that lost or died. To be deleted once no job reads
        them and no writer is at work."""
        newest = self.latest()
        used = [self.manifest(v).select("path") for v in range(max(1, newest - keep + 1), newest + 1)]
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        there = there.load(f"{self.folder}/data").select(self._relative(F.col("path")).alias("path"))
        for rows in used:
            there = there.join(rows, "path", "left_anti")
        return there

    def _relative(self, path):
        return F.element_at(F.split(path, "/data/(?=write=)"), -1)

    # -- writers ---------------------------------------------------------------

    def write(self, rows: DataFrame) -> DataFrame:
        """Write rows to files that belong to no version yet; their manifest rows."""
        own = f"{self.folder}/data/write={uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.partitionBy(*self.parts).parquet(own)
        made = self.spark.read.schema(self.schema).parquet(own)
        path = self._relative(F.col("_metadata.file_path")).alias("path")
        return made.groupBy(path).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))

    def commit(self, base: int, manifest: DataFrame, notes: dict | None = None) -> bool:
        """Make these files version ``base + 1``; False if another writer has made it."""
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(f"{self.folder}/manifests/{name}")
        entry = json.dumps({"manifest": name, "notes": notes or {}})
        return folders.claim(self.spark, self._version_file(base + 1), entry)

    def append(self, decide: Callable[[DataFrame], DataFrame], base: int | None = None) -> int:
        """Append the rows that ``decide`` makes of the current ones, deciding again
        whenever another writer came first; the version made.

        ``base`` is the version the caller last saw, by default the newest."""
        base = self.latest() if base is None else base
        for _ in range(MAX_TRIES):
            known = self.manifest(base)
            added = self.write(decide(self._rows(known).drop("file")))
            if self.commit(base, known.unionByName(added), self.notes(base)):
                return base + 1
            base = self.latest()
        raise RuntimeError(f"{self.folder}: {MAX_TRIES} versions were made by others meanwhile")


class SharedLedger:
    """Live entries that several writers add to: insert-if-absent holds between them too."""

    def __init__(self, spark: SparkSession, folder: str, columns: str) -> None:
        self.table = Versioned(spark, folder, columns)

    def entries(self, version: int | None = None) -> DataFrame:
        return self.table.read(version).drop("file")

    def put(self, entries: DataFrame, seen: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Insert the entries whose key is not there: (inserted, conflicting).

        The decision is taken against the version right below the one it makes, so
        writers at the same time end with the ledger of some serial order. ``seen``
        is the version this writer knows; an older one costs a second decision."""
        made = self.table.append(lambda live: lg.insert_new(live, entries)[0], seen)
        return lg.insert_new(self.entries(made - 1), entries)
