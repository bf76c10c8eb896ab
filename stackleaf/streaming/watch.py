"""Follow a folder: every new file goes through the ingest job once.

``start`` uses Spark's file source, which remembers the paths it has seen, so a file
edited in place is not read again. ``follow`` sees edits too: the listing of the folder
(path, time, length) is its state, and each trigger ingests what differs from
it. It catches up first, then watches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackleaf.plans.ingest import Ingest
from stackleaf.sources.files import SUPPORTED_GLOB, scan_folder, scan_paths
from stackleaf.sources.store import Corpus
from stackleaf.sources.tables import small_side, work_folder

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, folder: str, max_files: int = 10_000) -> DataFrame:
    """Stream of supported files directly in ``folder``."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", SUPPORTED_GLOB)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )


def start(
    files: DataFrame,
    corpus: Corpus,
    ingest: Ingest,
    checkpoint: str,
    first_batch: int = 1,
    continuous: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Ingest a stream of files. By default it works through what is there and
    stops; with ``continuous`` it keeps watching. ``first_batch`` must be above
    the batch numbers already in the ledger."""

    def one(batch: DataFrame, batch_id: int) -> None:
        ingest.run(corpus, batch, first_batch + batch_id)

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    if continuous:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


LISTING = "path string, modificationTime timestamp, length bigint"
# Up to so many files are opened by a list of their paths, which passes through the driver.
LISTED_FILES = 10_000


def _files_of(taken: DataFrame, folder: str) -> DataFrame:
    """The files of a listing: few by their paths, many by a scan of the folder that
    opens those within their span of time and keeps the listed ones."""
    spark = taken.sparkSession
    paths = [row.path for row in taken.select("path").limit(LISTED_FILES + 1).collect()]
    if len(paths) <= LISTED_FILES:
        return scan_paths(spark, paths)
    low, high = taken.agg(F.min("modificationTime"), F.max("modificationTime")).first()
    files = scan_folder(spark, folder).where(F.col("modificationTime").between(low, high))
    return files.join(small_side(taken.select("path")), "path", "left_semi")


class Follower:
    """A folder and what of it has been ingested, kept in the folder ``state``.

    ``listed`` gives the files there now and ``opened`` the files of a listing, a table
    with ``path`` and ``modificationTime``; by default the supported files of ``folder``.
    With ``max_files`` a batch takes no more than that; by default all changes go
    in one, since an ingest batch may be of any size.
    """

    def __init__(
        self,
        corpus: Corpus,
        ingest: Ingest,
        state: str,
        folder: str | None = None,
        listed: Callable[[], DataFrame] | None = None,
        opened: Callable[[DataFrame], DataFrame] | None = None,
        first_batch: int = 1,
        max_files: int | None = None,
    ) -> None:
        spark = corpus.spark
        self.corpus, self.ingest, self.state = corpus, ingest, state.rstrip("/")
        self.listed = listed or (lambda: scan_folder(spark, folder))
        self.opened = opened or (lambda taken: _files_of(taken, folder))
        self.first_batch, self.max_files = first_batch, max_files
        empty = spark.createDataFrame([], LISTING + ", batch_id bigint")
        empty.write.mode("ignore").partitionBy("batch_id").parquet(self.state)

    def seen(self) -> DataFrame:
        """The listing rows ingested so far, by batch."""
        return self.corpus.spark.read.schema(LISTING + ", batch_id bigint").parquet(self.state)

    def changed(self) -> DataFrame:
        """Files that are new or differ in time or length from when they were ingested.
        File contents are not read."""
        names = ["path", "modificationTime", "length"]
        return self.listed().select(*names).join(self.seen().select(*names), names, "left_anti")

    def catch_up(self) -> int:
        """Ingest all that has changed; the number of batches it took.

        Changes are taken in the order of their time, at most ``max_files`` a
        batch where that is set, until none is left. The listing of a batch stays a
        table. The state is written after the ledger, so a batch that was lost is
        made again under its number, which overwrites what it had written."""
        spark = self.corpus.spark
        done = 0
        while True:
            last = self.seen().agg(F.max("batch_id")).first()[0]
            batch_id = self.first_batch if last is None else last + 1
            changed = self.changed()
            if self.max_files is not None:
                changed = changed.orderBy("modificationTime", "path").limit(self.max_files)
            # a listing is taken once, so that what comes meanwhile is left for the next
            folder = work_folder(spark, "listing")
            changed.write.parquet(folder)
            taken = spark.read.schema(LISTING).parquet(folder)
            if taken.isEmpty():
                return done
            self.ingest.run(self.corpus, self.opened(taken), batch_id)
            listing = taken.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            writer = listing.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("batch_id").parquet(self.state)
            done += 1

    def follow(self, interval: str = "1 minute") -> StreamingQuery:
        """Catch up, then keep watching until the query is stopped. Its checkpoint is
        not needed to go on: the state is the listing."""
        self.catch_up()
        ticks = self.corpus.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = ticks.writeStream.foreachBatch(lambda *_: self.catch_up() and None)
        return writer.trigger(processingTime=interval).start()
