"""The corpus on disk: plain Parquet folders, written and read by Spark.

``arrivals/``, ``wanted/``, ``parsed/``, ``refused/``, ``chunks/`` and ``ledger/`` are partitioned by batch
(chunks by config hash first). A batch that runs again overwrites its own partitions only,
so a replay leaves the same rows. Chunks are written before the ledger; readers
keep the chunks whose document version is live, so one append to the ledger
switches all documents of the batch from the old version to the new.

One writer at a time: plain Parquet has no concurrent commit (``snapshots`` has one).

``compact`` moves the chunks of finished batches into ``packed/``, a table kept as
versions, without dead rows and in files of a proper size. One version file
switches readers over; those at work keep the version they opened. Views that were
opened at different times belong in different jobs: within one, Spark takes scans
of one folder for the same scan.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackleaf.functions import keys
from stackleaf.operators import ledger as lg
from stackleaf.sources.files import BLOCKS
from stackleaf.sources.folders import claim, names, text_of
from stackleaf.sources.snapshots import Versioned
from stackleaf.sources.tables import MAX_BROADCAST_ROWS, small_side
from stackleaf.sources.vector_index import VectorIndex

ARRIVAL_SCHEMA = (
    "source_path string, filename string, content_hash string, pipeline_config_hash string, "
    "seq bigint, routed boolean, batch_id bigint"
)
WANTED_SCHEMA = "source_path string, content_hash string, batch_id bigint"
PARSED_SCHEMA = (
    "source_path string, filename string, content_hash string, content_type string, "
    f"parser string, markdown string, blocks {BLOCKS}, doc_key string, reason string, "
    "batch_id bigint"
)
REFUSED_SCHEMA = "source_path string, content_hash string, reason string, batch_id bigint"
CHUNK_SCHEMA = (
    "content_hash string, chunk_id string, chunk_index int, total_chunks int, filename string, "
    "text string, enriched_text string, headings string, parent_headings string, "
    "summary string, page_numbers string, binary_hash bigint, embedding array<float>, "
    "pipeline_config_hash string, batch_id bigint"
)

# Types of the ledger's fields.
ENTRY_TYPES = {
    name: kind for name, kind in (field.strip().split(" ") for field in lg.EVENT_SCHEMA.split(",")) if name in lg.ENTRY_COLUMNS
}
# Row groups of saved parses. Spark cuts files into splits between row groups only, and
# chunking takes far more time a byte than a scan, so its splits must be even.
PARSED_GROUP_BYTES = 8 << 20
# Size of the files that compaction makes; files below half of it are packed again.
PACKED_BYTES = 256 << 20


class Corpus:
    """Paths of one corpus, with readers and writers for its tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def replies(self, model: str, use: str = "replies") -> str:
        """Folder of saved replies of one model (``use``: ``replies`` or ``vectors``)."""
        plain = re.sub(r"[^A-Za-z0-9._-]", "_", model)
        if plain != model:
            plain += "-" + hashlib.sha256(model.encode()).hexdigest()[:8]
        return self._path(f"{use}/{plain}")

    def index(self, config: str) -> VectorIndex:
        """The stored vector index of one generation; ``exists`` tells if there is one."""
        return VectorIndex(self.spark, self._path(f"index/{config}")).create()

    def create(self) -> "Corpus":
        """Lay down empty tables, so that the first batch can read them."""
        for table, schema, parts in (
            ("ledger", lg.EVENT_SCHEMA + ", batch_id bigint", ["batch_id"]),
            ("arrivals", ARRIVAL_SCHEMA, ["batch_id"]),
            ("wanted", WANTED_SCHEMA, ["batch_id"]),
            ("parsed", PARSED_SCHEMA, ["batch_id"]),
            ("refused", REFUSED_SCHEMA, ["batch_id"]),
            ("chunks", CHUNK_SCHEMA, ["pipeline_config_hash", "batch_id"]),
        ):
            empty = self.spark.createDataFrame([], schema)
            empty.write.mode("ignore").partitionBy(*parts).parquet(self._path(table))
        return self

    # -- writers ---------------------------------------------------------------

    def _replace_parts(self, df: DataFrame, table: str, parts: Sequence[str], **options) -> None:
        (
            df.write.mode("overwrite")
            .options(partitionOverwriteMode="dynamic", **options)
            .partitionBy(*parts)
            .parquet(self._path(table))
        )

    def write_arrivals(self, arrivals: DataFrame, batch_id: int) -> None:
        self._replace_parts(
            arrivals.withColumn("batch_id", F.lit(batch_id)), "arrivals", ["batch_id"]
        )

    def write_wanted(self, wanted: DataFrame, batch_id: int) -> None:
        self._replace_parts(wanted.withColumn("batch_id", F.lit(batch_id)), "wanted", ["batch_id"])

    def write_parsed(self, parsed: DataFrame, batch_id: int) -> None:
        rows = parsed.withColumn("batch_id", F.lit(batch_id))
        self._replace_parts(rows, "parsed", ["batch_id"], **{"parquet.block.size": PARSED_GROUP_BYTES})

    def write_refused(self, refused: DataFrame, batch_id: int) -> None:
        self._replace_parts(refused.withColumn("batch_id", F.lit(batch_id)), "refused", ["batch_id"])

    def write_chunks(self, chunks: DataFrame, batch_id: int) -> None:
        self._replace_parts(
            chunks.withColumn("batch_id", F.lit(batch_id)),
            "chunks",
            ["pipeline_config_hash", "batch_id"],
        )

    def append_events(self, events: DataFrame, batch_id: int) -> None:
        self._replace_parts(events.withColumn("batch_id", F.lit(batch_id)), "ledger", ["batch_id"])

    # -- readers ---------------------------------------------------------------

    def events(self, before_batch: int | None = None) -> DataFrame:
        """Ledger events; ``before_batch`` leaves out the batch itself, so that
        a replay sees the ledger as the first run did."""
        df = self._ledger()
        if before_batch is not None:
            df = df.where(F.col("batch_id") < before_batch)
        return df.drop("batch_id")

    def live_near(self, arrivals: DataFrame, config: str, before_batch: int) -> DataFrame:
        """Live entries that share a filename or a hash with an arrival; those
        are all a batch can touch. For a small batch the ledger is filtered by
        broadcast ahead of its shuffle, so a stream of small batches does not
        sort the whole ledger each time."""
        events = self.events(before_batch).where(F.col("pipeline_config_hash") == config)
        if arrivals.count() <= MAX_BROADCAST_ROWS:
            named = F.broadcast(arrivals.select("filename").distinct())
            hashed = arrivals.select("content_hash")
            others = events.join(named, "filename", "left_semi").select("content_hash")
            keys_ = hashed.unionByName(others).distinct()
            events = events.join(small_side(keys_), "content_hash", "left_semi")
        return lg.current(events)

    def batch_events(self, batch_id: int) -> DataFrame:
        """Ledger events of one batch."""
        return self._ledger().where(F.col("batch_id") == batch_id).drop("batch_id")

    def _ledger(self) -> DataFrame:
        return self.spark.read.schema(lg.EVENT_SCHEMA + ", batch_id bigint").parquet(
            self._path("ledger")
        )

    def arrivals(self, batch_id: int) -> DataFrame:
        """Keys of the files of one batch."""
        df = self.spark.read.schema(ARRIVAL_SCHEMA).parquet(self._path("arrivals"))
        return df.where(F.col("batch_id") == batch_id).drop("batch_id")

    def wanted(self, batch_id: int) -> DataFrame:
        """Keys of the files of one batch that are to be parsed."""
        df = self.spark.read.schema(WANTED_SCHEMA).parquet(self._path("wanted"))
        return df.where(F.col("batch_id") == batch_id).drop("batch_id")

    def parsed(self) -> DataFrame:
        return self.spark.read.schema(PARSED_SCHEMA).parquet(self._path("parsed"))

    def rejects(self) -> DataFrame:
        """Files that could not be parsed, and files that were but did not get
        into the ledger, with the reason."""
        refused = self.spark.read.schema(REFUSED_SCHEMA).parquet(self._path("refused"))
        return self.parsed().where(F.col("reason").isNotNull()).select(
            "source_path", "content_hash", F.lit("parse").alias("stage"), "reason"
        ).unionByName(
            refused.select("source_path", "content_hash", F.lit("version").alias("stage"), "reason")
        )

    def all_chunks(self) -> DataFrame:
        """Every stored chunk, live or not, of all generations; ``file`` names
        the file it is in (known without reading, so it can skip files). Packed
        chunks, and of the batches those that are not packed yet."""
        packed = self._packed()
        version = packed.latest()
        stored = self._stored_chunks()
        if not version:
            return stored
        return packed.read(version).unionByName(stored.where(self._unpacked(packed.notes(version))))

    def batch_chunks(self, config: str, batch_id: int) -> DataFrame:
        """The chunks that one batch wrote, packed since or not."""
        mine = (F.col("batch_id") == batch_id) & (F.col("pipeline_config_hash") == config)
        return self._stored_chunks().where(mine)

    def _stored_chunks(self) -> DataFrame:
        stored = self.spark.read.schema(CHUNK_SCHEMA).parquet(self._path("chunks"))
        return stored.select("*", F.col("_metadata.file_path").alias("file"))

    def _packed(self) -> Versioned:
        return Versioned(self.spark, self._path("packed"), CHUNK_SCHEMA, ["pipeline_config_hash"])

    @staticmethod
    def _unpacked(notes: dict) -> Column:
        return (F.col("batch_id") > notes["upto"]) | F.col("batch_id").isin(notes["open"])

    def compact(self, file_bytes: int = PACKED_BYTES) -> int:
        """Pack the chunks of all finished batches in place; the version made, or the
        current one if there is nothing to do.

        Written anew are chunks of batches that were not packed yet, files that hold
        a chunk of a dead document version, and files of less than half of
        ``file_bytes``; all other files go over into the new version as they are.
        Which files hold dead chunks is found by one scan of the keys, and no chunk
        is shuffled. Batches without an entry in the ledger are not finished and stay
        where they are, and a packed batch may run again. Of two compactions at once
        one gives way.
        """
        packed = self._packed()
        base = packed.latest()
        notes = packed.notes(base) or {"upto": -1, "open": []}
        ledger = self._ledger()
        numbers = {r.batch_id for r in ledger.select("batch_id").distinct().collect()}
        if not numbers:
            return base
        upto = max(numbers)
        new = self._stored_chunks().where(self._unpacked(notes) & (F.col("batch_id") <= upto))
        there = {r.batch_id for r in new.select("batch_id").distinct().collect()}
        events = self.events(upto + 1)
        key = [*lg.KEY, "batch_id"]
        dead = small_side(self._dead(events).select(*key))
        known = packed.manifest(base)
        holding = packed.read(base).join(dead, key, "left_semi").select(packed._relative(F.col("file")).alias("path"))
        small = known.where(F.col("bytes") < file_bytes // 2).select("path")
        # names of files, of which the manifest is a list
        again = {r.path for r in holding.distinct().collect()}
        little = {r.path for r in small.collect()}
        finished = there & numbers
        if len(little) > 1 or finished:
            again |= little
        if not again and not finished:
            return base
        chosen = self.spark.createDataFrame([(p,) for p in sorted(again)], "path string")
        old = packed._rows(known.join(chosen, "path", "left_semi"))
        rows = old.unionByName(new.where(F.col("batch_id").isin(*finished) if finished else F.lit(False)))
        alive = rows.join(dead, key, "left_anti").drop("file")
        size = known.join(chosen, "path", "left_semi").agg(F.sum("bytes")).first()[0] or 0
        size += self._stored_bytes(finished)
        added = packed.write(alive.coalesce(max(1, -(-size // file_bytes))))
        files = known.join(chosen, "path", "left_anti").unionByName(added)
        after = {"upto": upto, "open": sorted(there - finished)}
        if packed.commit(base, files, after):
            return base + 1
        return packed.latest()

    def _stored_bytes(self, batches: set[int]) -> int:
        """Bytes of the files of some batches; file contents are not read."""
        if not batches:
            return 0
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        files = files.load(self._path("chunks")).where(F.col("batch_id").isin(*batches))
        return files.agg(F.sum("length")).first()[0] or 0

    def _dead(self, events: DataFrame) -> DataFrame:
        """Document versions, by the batch that made them, that are no longer live."""
        key = [*lg.KEY, "batch_id"]
        made = events.where(F.col("op") == "register").select(*lg.KEY, F.floor(F.col("seq") / 2).alias("batch_id"))
        live = lg.current(events).select(*lg.KEY, F.floor(F.col("seq") / 2).alias("batch_id"))
        return made.join(live, key, "left_anti").distinct()

    def _visible(self, chunks: DataFrame, events: DataFrame) -> DataFrame:
        """Chunks of finished batches, less the document versions that are no
        longer live. The table of dead versions only holds what changed since
        the last compaction, so it stays far smaller than the table of live
        ones, and the chunks are scanned without a shuffle."""
        key = [*lg.KEY, "batch_id"]
        dead = self._dead(events)
        done = events.where(F.col("op") == "register").select(F.floor(F.col("seq") / 2).alias("batch_id")).distinct()
        return chunks.join(small_side(done), "batch_id", "left_semi").join(
            small_side(dead), key, "left_anti"
        )

    def chunks(self, config: str) -> DataFrame:
        """Searchable chunks of one generation: its partitions only, and only
        document versions that are live."""
        mine = F.col("pipeline_config_hash") == config
        return self._visible(self.all_chunks().where(mine), self.events().where(mine))

    def visible(self, config: str) -> Callable[[DataFrame], DataFrame]:
        """A filter that leaves the rows of live document versions in any table of this
        generation with the key columns and ``batch_id``."""
        events = self.events().where(F.col("pipeline_config_hash") == config)
        return lambda rows: self._visible(rows, events)

    def delete_documents(self, wanted: DataFrame, batch_id: int, config: str | None = None) -> DataFrame:
        """Delete documents by ``filename``, by ``content_hash`` or, with both columns,
        by the pair; of one generation or of all. Returns the entries deleted.

        Only delete events are written, with a batch number of their own: chunks and
        index rows stop being visible with them and leave the disk at the next
        ``compact_to``. Names that are not live are ignored; a repeated call with
        the same number deletes the same entries."""
        by = [c for c in ("filename", "content_hash") if c in wanted.columns]
        if not by:
            raise ValueError("name the documents by filename or content_hash")
        live = lg.current(self.events(batch_id))
        if config is not None:
            live = live.where(F.col("pipeline_config_hash") == config)
        gone = live.join(small_side(wanted.select(*by).distinct()), by, "left_semi")
        events = gone.select(
            F.lit(2 * batch_id).cast("bigint").alias("seq"), F.lit("delete").alias("op"), *lg.ENTRY_COLUMNS
        )
        self.append_events(events, batch_id)
        return self.batch_events(batch_id).select(*lg.ENTRY_COLUMNS)

    # -- generations -----------------------------------------------------------

    def activate(self, config: str, number: int) -> None:
        """Make ``config`` the generation that ``active`` names, as step ``number``. A
        number that is taken stays as it is."""
        claim(self.spark, self._path(f"generations/{number:012d}.json"), json.dumps({"config": config}))

    def active(self) -> str | None:
        """The generation readers should open: that of the highest step; None before the first."""
        found = names(self.spark, self._path("generations"), ".json")
        return json.loads(text_of(self.spark, self._path(f"generations/{found[-1]}")))["config"] if found else None

    def batches_done(self, first: int, end: int) -> DataFrame:
        """``batch_id`` of the batches from ``first`` up to before ``end`` with ledger entries."""
        return self._ledger().where((F.col("batch_id") >= first) & (F.col("batch_id") < end)).select("batch_id").distinct()

    def write_rechunk_plan(self, entries: DataFrame, number: int, batches: int) -> tuple[DataFrame, int]:
        """Write down which entries are to be chunked again in which batch."""
        path = self._path(f"rechunk/{number}-{uuid.uuid4().hex[:12]}")
        entries.write.partitionBy("batch_id").parquet(path)
        claim(self.spark, self._path(f"rechunk/{number:012d}.json"), json.dumps({"path": path, "batches": batches}))
        return self.rechunk_plan(number)

    def rechunk_plan(self, number: int) -> tuple[DataFrame, int] | None:
        """(entries with their batch, number of batches) of a job that was begun."""
        if f"{number:012d}.json" not in names(self.spark, self._path("rechunk"), ".json"):
            return None
        plan = json.loads(text_of(self.spark, self._path(f"rechunk/{number:012d}.json")))
        schema = ", ".join(f"{c} {t}" for c, t in ENTRY_TYPES.items()) + ", batch_id bigint"
        return self.spark.read.schema(schema).parquet(plan["path"]), plan["batches"]

    def compact_to(self, target: str, configs: Sequence[str] | None = None) -> "Corpus":
        """Rewrite the live part of the corpus to another folder (a table must
        not be overwritten while it is read). With ``configs``, generations
        outside it are pruned; as partitions, they are not even read."""
        out = Corpus(self.spark, target).create()
        wanted = F.lit(True)
        if configs is not None:
            wanted = F.col("pipeline_config_hash").isin(*configs)
        events = self.events().where(wanted)
        keep = lg.current(events)
        parsed = self.parsed()
        gone = (
            parsed.select("content_hash")
            .distinct()
            .join(keep.select("content_hash"), "content_hash", "left_anti")
        )
        documents = parsed.join(small_side(gone), "content_hash", "left_anti")
        out._replace_parts(
            self._visible(self.all_chunks().where(wanted), events).drop("file"),
            "chunks",
            ["pipeline_config_hash", "batch_id"],
        )
        out._replace_parts(documents, "parsed", ["batch_id"], **{"parquet.block.size": PARSED_GROUP_BYTES})
        out._replace_parts(
            keep.withColumn("batch_id", F.floor(F.col("seq") / 2)), "ledger", ["batch_id"]
        )
        return out


def chunk_records(chunks: DataFrame, config: str) -> DataFrame:
    """Chunk rows in the stored form: keys, numbering and page list in their
    stored shape. ``enriched_text`` is what gets embedded, ``text`` is kept for
    display."""
    return chunks.select(
        "content_hash",
        keys.chunk_id(F.col("enriched_text")).alias("chunk_id"),
        "chunk_index",
        "total_chunks",
        "filename",
        "text",
        "enriched_text",
        "headings",
        "parent_headings",
        "summary",
        keys.encode_pages(F.col("page_numbers")).alias("page_numbers"),
        keys.binary_hash(F.col("content_hash")).alias("binary_hash"),
        F.lit(config).alias("pipeline_config_hash"),
    )


def sidecar(chunks: DataFrame) -> DataFrame:
    """Per-chunk object key and its eleven metadata attributes."""
    return chunks.select(
        keys.object_key(
            F.col("pipeline_config_hash"), F.col("content_hash"), F.col("chunk_id")
        ).alias("object_key"),
        F.struct(
            F.col("text").alias("raw_text"),
            "headings",
            "parent_headings",
            "summary",
            "filename",
            "content_hash",
            "chunk_id",
            "pipeline_config_hash",
            "chunk_index",
            "total_chunks",
            "page_numbers",
        ).alias("metadata"),
    )


def write_chunks_json(chunks: DataFrame, path: str, by: str = "pipeline_config_hash") -> None:
    """One JSON object per chunk. Folders are per ``by``: a folder per document
    would mean one tiny file per document and task."""
    chunks.write.mode("overwrite").partitionBy(by).json(path)


def ingest_report(chunks: DataFrame) -> DataFrame:
    """Chunk count per document (before identical chunks collapse)."""
    return chunks.groupBy("content_hash", "filename").agg(F.count("*").alias("chunk_count"))
