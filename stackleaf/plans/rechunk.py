"""A second processing generation from saved parses.

Chunk size, tokenizer, embedder or summary model change, the documents don't: the
texts saved by the ingest job are chunked again under the new settings, without
opening a source file. Documents go in batches by a hash of their content. A batch
is done with its ledger entry, so a job that stops goes on where it was; readers
change over to the new generation as a whole, once all batches are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackleaf.operators import ledger as lg
from stackleaf.plans.ingest import Ingest
from stackleaf.sources.store import Corpus
from stackleaf.sources.tables import small_side

# Documents in a batch, on average.
BATCH_DOCUMENTS = 1_000_000


def saved_parses(corpus: Corpus, live: DataFrame) -> DataFrame:
    """The parse of each live document version, one row each. Of several parses of
    one version that of the entry's own path counts, and of those the last."""
    good = corpus.parsed().where("reason IS NULL")
    wanted = live.select("content_hash", "source_path", "filename")
    # keys only; texts are read by the scan that follows
    last = good.select("content_hash", "source_path", "batch_id").join(
        small_side(wanted), ["content_hash", "source_path"], "left_semi"
    )
    last = last.groupBy("content_hash", "source_path").agg(F.max("batch_id").alias("batch_id"))
    return good.join(small_side(last), ["content_hash", "source_path", "batch_id"], "left_semi")


def rechunk(
    corpus: Corpus, old: str, ingest: Ingest, first_batch: int, batch_documents: int = BATCH_DOCUMENTS
) -> DataFrame:
    """Make the generation of ``ingest.settings`` from the live documents of the
    generation ``old``, then switch to it (``Corpus.active``). Returns the report
    of the ingest job over the whole generation.

    Batches take the numbers from ``first_batch`` on, which must be above those in
    the ledger, and a call that repeats a stopped one names the same number. How the documents
    are dealt to batches is written down first, so what arrives or goes between two calls is left
    to a later run of the job. Documents whose content the new generation already
    has are left out. No source file is opened.
    """
    config = ingest.settings.fingerprint()
    if config == old:
        raise ValueError("the settings are those of the old generation")
    plan = corpus.rechunk_plan(first_batch)
    if plan is None:
        live = lg.current(corpus.events(first_batch))
        mine = live.where(F.col("pipeline_config_hash") == old)
        there = live.where(F.col("pipeline_config_hash") == config).select("content_hash")
        todo = mine.join(there, "content_hash", "left_anti")
        batches = max(1, -(-todo.count() // batch_documents))
        number = F.pmod(F.xxhash64("content_hash"), F.lit(batches)) + first_batch
        plan = corpus.write_rechunk_plan(todo.withColumn("batch_id", number), first_batch, batches)
    todo, batches = plan
    done = {r.batch_id for r in corpus.batches_done(first_batch, first_batch + batches).collect()}
    filled = {r.batch_id for r in todo.select("batch_id").distinct().collect()}
    for batch_id in sorted(filled - done):
        entries = todo.where(F.col("batch_id") == batch_id)
        parsed = saved_parses(corpus, entries)
        made = ingest.chunks(
            parsed, config, corpus.replies(ingest.settings.summary_model), corpus.replies(ingest.settings.embed_model, "vectors")
        )
        corpus.write_chunks(made, batch_id)
        written = corpus.batch_chunks(config, batch_id)
        if ingest.index is not None:
            ingest._indexed(corpus, config, written)
        counts = written.groupBy("content_hash").agg(F.max("total_chunks").alias("made"))
        events = entries.join(counts, "content_hash", "left").select(
            F.lit(2 * batch_id + 1).cast("bigint").alias("seq"), F.lit("register").alias("op"), "filename", "source_path",
            "content_hash", F.lit(config).alias("pipeline_config_hash"), "parser", F.current_timestamp().alias("ingested_at"),
            F.coalesce("made", F.lit(0)).cast("int").alias("chunk_count"),
        )
        corpus.append_events(events, batch_id)
    corpus.activate(config, first_batch)
    live = lg.current(corpus.events().where(F.col("pipeline_config_hash") == config))
    return live.select("filename", "content_hash", "chunk_count")
