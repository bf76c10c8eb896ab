"""The document ledger: which version of which document is live.

The ledger is an append-only table of events. ``seq`` grows with every batch
(``2 * batch`` for deletes, ``2 * batch + 1`` for registers, so a hash that is
evicted and registered again in one batch ends up registered). All operators
here move keys only, never text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackleaf.sources.tables import small_side

KEY = ["content_hash", "pipeline_config_hash"]

EVENT_SCHEMA = (
    "seq bigint, op string, filename string, source_path string, content_hash string, "
    "pipeline_config_hash string, parser string, ingested_at timestamp, chunk_count int"
)
ENTRY_COLUMNS = [
    "filename",
    "source_path",
    "content_hash",
    "parser",
    "pipeline_config_hash",
    "ingested_at",
    "chunk_count",
]


def _first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row per key. Ranking with ``= 1`` is cut to one row per key in every
    map task before the shuffle, so a key with very many rows is no hot spot."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def current(events: DataFrame) -> DataFrame:
    """Live entries: the last event of each key, where it is a register.
    Upserts and deletes are both just later events."""
    return _first(events, KEY, F.desc("seq")).where(F.col("op") == "register")


def entries(events: DataFrame) -> DataFrame:
    """Live entries as the seven ledger fields."""
    return current(events).select(*ENTRY_COLUMNS)


def skip_known(files: DataFrame, live: DataFrame) -> DataFrame:
    """Files whose (hash, config) is not live yet."""
    return files.join(live.select(*KEY), KEY, "left_anti")


def lookup(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """Point lookups; keys without an entry keep NULL fields."""
    return wanted.select(*KEY).join(live, KEY, "left")


def insert_new(live: DataFrame, entries_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert-if-absent: (entries to append, conflicting entries). Of several
    entries with one key the first by filename is inserted, if any, ties going by
    the other columns. What is not inserted is found by whole rows, so
    a key with very many entries is spread over tasks here too."""
    unknown = entries_.join(live.select(*KEY).distinct(), KEY, "left_anti").select(entries_.columns)
    others = [c for c in entries_.columns if c not in (*KEY, "filename")]
    new = _first(unknown, KEY, F.asc("filename"), *map(F.asc, others))
    return new, entries_.exceptAll(new)


def find_superseded(live: DataFrame, incoming: DataFrame) -> DataFrame:
    """Live entries with the filename and config of an incoming file but other
    content: the older versions of the same document."""
    new = incoming.select(
        "filename", "pipeline_config_hash", F.col("content_hash").alias("_new_hash")
    ).distinct()
    return (
        live.join(new, ["filename", "pipeline_config_hash"])
        .where(F.col("content_hash") != F.col("_new_hash"))
        .select(live.columns)
        .distinct()
    )


class Swap(NamedTuple):
    """Outcome of one batch against the ledger."""

    evicted: DataFrame
    registered: DataFrame
    live: DataFrame


def latest_files(incoming: DataFrame) -> DataFrame:
    """The last arrival of every filename (``seq`` decides, then the path where
    there is one, then the hash)."""
    path = [F.desc("source_path")] if "source_path" in incoming.columns else []
    order = [F.desc("seq"), *path, F.col("content_hash")]
    return _first(incoming, ["filename", "pipeline_config_hash"], *order)


def replaced_files(incoming: DataFrame) -> DataFrame:
    """Arrivals whose filename arrives later in the same batch with other content."""
    name = ["filename", "pipeline_config_hash"]
    last = latest_files(incoming).select(*name, F.col("content_hash").alias("_last"))
    return (
        incoming.join(last, name)
        .where(F.col("content_hash") != F.col("_last"))
        .select(incoming.columns)
        .distinct()
    )


def swap(live: DataFrame, incoming: DataFrame) -> Swap:
    """Set-based version change, whatever the order of the files.

    * evicted: live entries whose filename arrives with other content;
    * registered: arrivals whose hash is not live once those are gone, one per
      hash (the smallest filename);
    * live: entries that stay, plus the registered ones.

    Handling files one by one would make the outcome depend on their order
    when one document moves away from a content that another one moves to.
    """
    cols = ["filename", "content_hash", "pipeline_config_hash"]
    arrivals = latest_files(incoming)
    evicted = find_superseded(live, arrivals)
    staying = live.join(evicted.select(*KEY), KEY, "left_anti")
    registered = _first(
        arrivals.join(staying.select(*KEY), KEY, "left_anti"), KEY, F.asc("filename")
    )
    return Swap(evicted, registered, staying.select(*cols).unionByName(registered.select(*cols)))


def compact(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """Chunks that belong to a live document version.

    The few versions that are *not* live are looked up from the keys alone and
    taken out by a broadcast, so that chunk texts need not be shuffled to meet
    the long list of live ones.
    """
    dead = chunks.select(*KEY).distinct().join(live.select(*KEY), KEY, "left_anti")
    return without_documents(chunks, dead)


def without_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks left after deleting the given document versions."""
    return chunks.join(small_side(gone.select(*KEY).distinct()), KEY, "left_anti")


def prune(df: DataFrame, config: str) -> DataFrame:
    """Rows of the current generation. On a table partitioned by config hash
    this is partition pruning: other generations are not read."""
    return df.where(F.col("pipeline_config_hash") == config)


def prune_events(live: DataFrame, config: str, seq: int) -> DataFrame:
    """Delete events for every live entry of another generation."""
    return live.where(F.col("pipeline_config_hash") != config).select(
        F.lit(seq).cast("bigint").alias("seq"), F.lit("delete").alias("op"), *ENTRY_COLUMNS
    )
