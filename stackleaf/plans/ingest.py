"""The ingest job: files in, searchable chunks and ledger events out.

All files of a batch go through together:

1. hash the files and compare keys with the ledger (no text moves),
2. parse only the files that are new, and save the result,
3. decide the version change from what parsed well,
4. chunk, summarise, embed and save,
5. append all ledger events in one write, which makes the change visible.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackleaf.functions import keys
from stackleaf.functions import text as tx
from stackleaf.operators import chunking, enrich, structure
from stackleaf.operators import ledger as lg
from stackleaf.plans.settings import Settings
from stackleaf.sources import files as fl
from stackleaf.sources.store import Corpus, chunk_records
from stackleaf.sources.tables import small_side
from stackleaf.sources.vector_index import IndexSettings


@dataclass
class Ingest:
    """How to process files. The callables are the user's plug-ins."""

    settings: Settings = Settings()
    document_parser: Callable | None = None
    min_chars: int = fl.MIN_CHARS
    separator: str = r"\n\n+"
    counter: tx.Counter | None = None
    make_client: Callable | None = None
    summary_tokens: int = enrich.SUMMARY_TOKENS
    make_embedder: Callable | None = None
    dims: int = 256
    index: IndexSettings | None = None

    def run(self, corpus: Corpus, files: DataFrame, batch_id: int) -> DataFrame:
        """Process ``files`` (``path, content`` and, optionally, ``seq`` for
        the order of arrival). Safe to run again with the same ``batch_id``.
        Returns the report: ``filename, content_hash, chunk_count`` of the
        documents this batch registered.

        Without ``seq`` files arrive in the order of ``modificationTime``, where
        there is one, then of their paths. Of files with one name the last that
        can be parsed counts; the others are rejects, as are files whose
        content changes between hashing and parsing."""
        config = self.settings.fingerprint()
        if "seq" not in files.columns:
            timed = "modificationTime" in files.columns
            order = F.unix_micros("modificationTime") if timed else F.lit(0).cast("bigint")
            files = files.withColumn("seq", order)
        corpus.write_arrivals(
            files.select(
                F.col("path").alias("source_path"),
                keys.filename(F.col("path")).alias("filename"),
                keys.content_hash(F.col("content")).alias("content_hash"),
                F.lit(config).alias("pipeline_config_hash"),
                "seq",
                fl.route(F.col("path")).isNotNull().alias("routed"),
            ),
            batch_id,
        )
        everything = corpus.arrivals(batch_id)
        arrivals = everything.where("routed").drop("routed")
        live = corpus.live_near(arrivals, config, batch_id)
        pick = ["source_path", "content_hash"]
        replaced = lg.replaced_files(arrivals).select(*pick)
        wanted = lg.swap(live, arrivals).registered.select(*pick).unionByName(replaced)
        corpus.write_wanted(
            wanted.unionByName(everything.where("NOT routed").select(*pick)), batch_id
        )
        corpus.write_parsed(
            fl.parse_files(
                self._picked(files, corpus.wanted(batch_id), everything.count()),
                document_parser=self.document_parser,
                parser_name=self.settings.parser,
                min_chars=self.min_chars,
            ),
            batch_id,
        )

        # from here on everything is read back from the saved parse
        parsed = corpus.parsed().where(F.col("batch_id") == batch_id)
        good = parsed.where(F.col("reason").isNull())
        failed = parsed.where("reason IS NOT NULL AND parser IS NOT NULL").select(*pick)
        # wanted under a hash that the second reading did not find
        changed = corpus.wanted(batch_id).join(parsed.select(*pick), pick, "left_anti")
        bad = failed.unionByName(changed)
        if bad.unionByName(replaced).isEmpty():
            change = lg.swap(live, arrivals)
        else:
            # a version that cannot be read replaces nothing, so its old
            # version stays, and with it any copy of that in this batch is
            # known after all; such copies are few
            readable = arrivals.join(bad, pick, "left_anti")
            change = lg.swap(live, readable)
            why = F.lit("replaced in the same batch")
            refused = lg.replaced_files(readable).select(*pick, why.alias("reason"))
            corpus.write_refused(
                refused.unionByName(
                    changed.select(*pick, F.lit("changed while it was read").alias("reason"))
                ),
                batch_id,
            )
            surplus = good.select(*pick).join(
                change.registered.select(*pick), pick, "left_anti"
            )
            good = good.join(small_side(surplus), pick, "left_anti")
        corpus.write_chunks(
            self.chunks(
                good,
                config,
                corpus.replies(self.settings.summary_model),
                corpus.replies(self.settings.embed_model, "vectors"),
            ),
            batch_id,
        )

        written = corpus.batch_chunks(config, batch_id)
        if self.index is not None:
            self._indexed(corpus, config, written)
        counts = written.groupBy("content_hash").agg(
            F.max("total_chunks").alias("chunk_count")
        )
        registered = good.select("filename", "source_path", "content_hash", "parser").join(
            counts, "content_hash", "left"
        )
        events = registered.select(
            F.lit(2 * batch_id + 1).cast("bigint").alias("seq"),
            F.lit("register").alias("op"),
            "filename",
            "source_path",
            "content_hash",
            F.lit(config).alias("pipeline_config_hash"),
            "parser",
            F.current_timestamp().alias("ingested_at"),
            F.coalesce("chunk_count", F.lit(0)).cast("int").alias("chunk_count"),
        ).unionByName(
            change.evicted.select(
                F.lit(2 * batch_id).cast("bigint").alias("seq"),
                F.lit("delete").alias("op"),
                *lg.ENTRY_COLUMNS,
            )
        )
        corpus.append_events(events, batch_id)
        return corpus.batch_events(batch_id).where("op = 'register'").select(
            "filename", "content_hash", "chunk_count"
        )

    def _indexed(self, corpus: Corpus, config: str, written: DataFrame) -> None:
        """Bring the vectors of the batch into the stored index; the first batch with
        vectors, with all that were there before it, trains it."""
        index = corpus.index(config)
        if index.exists():
            index.add(written)
        else:
            index.build(corpus.all_chunks().where(F.col("pipeline_config_hash") == config), self.index)

    def _picked(self, files: DataFrame, wanted: DataFrame, total: int) -> DataFrame:
        """The files to parse, without moving file contents where possible: a
        batch of new files passes as it is, a small selection is broadcast, and
        only a large selection from a larger batch is joined by shuffle."""
        if wanted.count() == total:
            return files
        hashed = files.withColumn("content_hash", keys.content_hash(F.col("content")))
        chosen = wanted.withColumnRenamed("source_path", "path")
        return hashed.join(small_side(chosen), ["path", "content_hash"], "left_semi")

    def chunks(
        self, parsed: DataFrame, config: str, replies: str | None = None, vectors: str | None = None
    ) -> DataFrame:
        """Chunk, summarise and embed parsed documents; stored form. Replies of
        a summary client are kept in the folder ``replies``, vectors of an
        embedder in the folder ``vectors``."""
        keep = ["content_hash", "filename"]
        if self.settings.chunker == "docling":
            structured = parsed.withColumn(
                "blocks", structure.saved_blocks(F.col("blocks"), F.col("markdown"))
            )
            made = structure.chunk_blocks(
                structured,
                keep=keep,
                cap=self.settings.chunk_max_tokens,
                merge_peers=self.settings.chunk_merge_peers,
                merge_list_items=self.settings.chunk_merge_list_items,
                counter=self.counter,
                distinct=True,
            )
        else:
            made = chunking.plain_chunks(
                chunking.pack_documents(
                    parsed,
                    keep=keep,
                    cap=self.settings.chunk_max_tokens,
                    separator=self.separator,
                    counter=self.counter,
                    distinct=True,
                )
            )
        summed = enrich.summarize(made, self.make_client, replies, self.summary_tokens)
        records = chunk_records(summed, config)
        if self.make_embedder is not None:
            return enrich.embed(records, self.make_embedder, saved=vectors)
        return enrich.hashing_embed(records, self.dims)
