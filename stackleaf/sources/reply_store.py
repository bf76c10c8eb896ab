"""Replies of a model, kept by key, so that nothing is asked twice.

A key is the SHA-256 of all that decides a reply. Each write adds a run below
``runs/``, partitioned by the first hex digits of its keys, the more digits the
more rows. ``manifest/`` lists the live runs; a run counts once a version of it
names the run, so a reader never meets half of one. When ``FAN`` runs of a level
have come together, they become one run of the next level. So a batch looks into
the partitions of its own keys, in a number of runs that grows with the logarithm
of the batches ever written.

One writer at a time, as for the corpus. Merged runs stay on disk for readers
that began before the merge.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackleaf.sources.tables import small_side, work_folder

FAN = 8
# A run of more rows than this is split by one hex digit of the key, then by two.
PART_ROWS = 100_000
# Calls in one write job: what a lost job can cost at most.
WAVE_ROWS = 200_000
# Versions of the manifest that are kept.
SLOTS = 8

MANIFEST = "version long, run string, level int, rows long, slot int"


class ReplyStore:
    """Table ``key string, reply, error string`` in a folder; ``kind`` is the type
    of a reply. Among several rows of a key one with a reply counts."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "string", fan: int = FAN) -> None:
        self.spark, self.folder, self.kind, self.fan = spark, folder.rstrip("/"), kind, fan
        self.schema = f"key string, reply {kind}, error string"

    def _manifest(self) -> DataFrame:
        empty = self.spark.createDataFrame([], MANIFEST)
        empty.write.mode("ignore").partitionBy("slot").parquet(f"{self.folder}/manifest")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def runs(self) -> tuple[int, list[tuple[str, int, int]]]:
        """Number of the current version, and the name, level and rows of each live run."""
        rows = self._manifest().collect()  # some dozens
        version = max((r.version for r in rows), default=0)
        return version, sorted((r.run, r.level, r.rows) for r in rows if r.version == version)

    def _switch(self, version: int, runs: list[tuple[str, int, int]]) -> None:
        """The new version takes the place of the oldest one, in a single file."""
        rows = [(version, *run, version % SLOTS) for run in runs]
        made = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(
            f"{self.folder}/manifest"
        )

    def _write(self, rows: DataFrame, digits: int) -> str:
        run = uuid.uuid4().hex
        split = rows.withColumn("part", F.concat(F.lit("k"), F.substring("key", 1, digits)))
        split.write.partitionBy("part").parquet(f"{self.folder}/runs/{run}")
        return run

    def _read(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], f"{self.schema}, part string")
        read = self.spark.read.schema(f"{self.schema}, part string")
        found = read.parquet(f"{self.folder}/runs/{runs[0]}")
        for run in runs[1:]:  # each run has partitions of its own, so none is a common base
            found = found.unionByName(read.parquet(f"{self.folder}/runs/{run}"))
        return found

    @staticmethod
    def _digits(rows: int) -> int:
        return 0 if rows <= PART_ROWS else 1 if rows <= 16 * PART_ROWS else 2

    @staticmethod
    def _settled(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("key").agg(F.max("reply").alias("reply"), F.max("error").alias("error"))
        return found.withColumn("error", F.when(F.col("reply").isNull(), F.col("error")))

    def known(self, keys: DataFrame) -> DataFrame:
        """``key, reply, error`` of those of ``keys(key)`` that are there. Only the
        partitions of these keys are listed and read."""
        heads = [r.head for r in keys.select(F.substring("key", 1, 2).alias("head")).distinct().collect()]  # 256 at most
        wanted = sorted({"k"} | {f"k{h[:n]}" for h in heads for n in (1, 2)})
        _, runs = self.runs()
        rows = self._read([run for run, _, _ in runs]).where(F.col("part").isin(wanted)).drop("part")
        return self._settled(rows.join(small_side(keys.select("key").distinct()), "key", "left_semi"))

    def add(self, found: DataFrame, rows: int) -> None:
        """Save about so many rows ``key, reply, error``, and merge runs where enough have come."""
        run = self._write(found.select("key", "reply", "error"), self._digits(rows))
        version, runs = self.runs()
        runs = [*runs, (run, 0, rows)]
        self._switch(version := version + 1, runs)
        level = 0
        while len(same := [r for r in runs if r[1] == level]) >= self.fan:
            total, names = sum(n for _, _, n in same), [r for r, _, _ in same]
            digits = self._digits(total)
            # a task holds rows of one part, so it writes one file, and parts are split further where rows are many
            tasks = max(16**digits, total >> 20)
            salt = F.pmod(F.xxhash64("key"), F.lit(tasks >> 4 * digits))
            merged = self._settled(self._read(names).drop("part")).repartition(tasks, F.substring("key", 1, digits), salt)
            run = self._write(merged, digits)
            level += 1
            runs = [r for r in runs if r not in same] + [(run, level, total)]
            self._switch(version := version + 1, runs)

    def complete(self, inputs: DataFrame, udf, rows_per_task: int, wave_rows: int = WAVE_ROWS) -> DataFrame:
        """``key, reply, error`` for each distinct key of ``inputs(key, text)``, which is
        read several times. Keys without a reply are sent to ``udf`` (``text -> (reply,
        error)``), in waves, each saved before the next, and the result is read back."""
        keys = inputs.select("key").distinct()
        folder = work_folder(self.spark, "unanswered")
        had = self.known(keys).where("reply IS NOT NULL").select("key")
        inputs.dropDuplicates(["key"]).join(had, "key", "left_anti").write.parquet(folder)
        missing = self.spark.read.schema(inputs.schema).parquet(folder)
        total = missing.count()
        waves = -(-total // wave_rows)
        for wave in range(waves):
            own = missing.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave)
            tasks = max(1, -(-total // (waves * rows_per_task)))
            asked = own.repartition(tasks, "key").withColumn("_r", udf(F.col("text")))
            self.add(asked.select("key", "_r.reply", "_r.error"), -(-total // waves))
        return self.known(keys)
