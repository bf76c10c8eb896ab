"""The ask job: a table of questions in, a table of answers out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackleaf.operators import enrich, prompts
from stackleaf.operators import retrieve as rt
from stackleaf.sources.store import Corpus
from stackleaf.sources.tables import work_folder


def retrieve(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = rt.DEFAULT_K,
    metric: str = "cosine",
    where: str = rt.DEFAULT_FILTER,
) -> DataFrame:
    """Hit fields for each question. ``questions``: ``query_id, embedding``.
    ``chunks``: stored chunks of one generation. A chunk id tells texts apart,
    not documents, so a chunk is named by its document and its id here."""
    stored = chunks.withColumn(
        "chunk_id", F.concat_ws("_", "content_hash", "chunk_id")
    ).withColumnsRenamed({"text": "raw_text", "enriched_text": "page_content"})
    hits = rt.top_k_prefiltered(stored, questions, k, metric, where)
    wide = ["headings", "parent_headings", "summary", "raw_text", "page_content"]
    fetch = rt.attach_stored if "file" in stored.columns else rt.attach
    return rt.project_hits(fetch(hits, stored, wide, questions.count() * k))


WIDE = ["headings", "parent_headings", "summary", "raw_text", "page_content"]
CITED = ["filename", "content_hash", "chunk_index", "total_chunks", "page_numbers"]


def embedded(questions: DataFrame, make_embedder: Callable | None = None, dims: int = 256) -> DataFrame:
    """``questions(query_id, question)`` with the ``embedding`` of their text, saved, so
    that the model is called once. Without an embedder the default one is used."""
    asked = questions.select("query_id", "question")
    if make_embedder is not None:
        made = enrich.embed(asked, make_embedder, text="question")
    else:
        made = enrich.hashing_embed(asked, dims, text="question")
    folder = work_folder(questions.sparkSession, "questions")
    made.write.parquet(folder)
    return questions.sparkSession.read.schema(made.schema).parquet(folder)


@dataclass
class Answering:
    """Questions in words against a stored corpus. The callables are the user's
    plug-ins; the embedder is that of the corpus."""

    corpus: Corpus
    config: str
    make_embedder: Callable | None = None
    dims: int = 256
    k: int = rt.DEFAULT_K
    metric: str = "cosine"
    where: str = rt.DEFAULT_FILTER
    nprobe: int | None = None
    digits: int | None = None

    def hits(self, questions: DataFrame) -> DataFrame:
        """``query_id, chunk_id, score, rank``, saved. ``questions`` are embedded. The
        stored index is used where the corpus has one (with its own metric), else
        all vectors are searched."""
        index = self.corpus.index(self.config)
        where = f"headings IS NULL OR {self.where}" if self.where == rt.DEFAULT_FILTER else self.where
        if index.exists():
            found = index.search(
                questions, self.k, self.nprobe, where, self.corpus.visible(self.config), self.digits
            )
        else:
            found = rt.top_k(self._stored(), questions, self.k, self.metric, where, self.digits)
        folder = work_folder(questions.sparkSession, "hits")
        found.write.parquet(folder)
        return questions.sparkSession.read.schema(found.schema).parquet(folder)

    def _stored(self) -> DataFrame:
        return self.corpus.chunks(self.config).withColumn(
            "chunk_id", F.concat_ws("_", "content_hash", "chunk_id")
        ).withColumnsRenamed({"text": "raw_text", "enriched_text": "page_content"})

    def results(self, hits: DataFrame, questions: DataFrame) -> DataFrame:
        """Hits with what a reader sees."""
        return rt.project_hits(rt.attach_stored(hits, self._stored(), WIDE, questions.count() * self.k))

    def citations(self, hits: DataFrame, questions: DataFrame) -> DataFrame:
        """Hits with where they come from."""
        return rt.cite_hits(rt.attach_stored(hits, self._stored(), CITED, questions.count() * self.k))

    def ask(self, questions: DataFrame, make_client: Callable, system: str = prompts.SYSTEM, **options) -> DataFrame:
        """``query_id, answer, error`` for ``questions(query_id, question)``. With
        ``saved=corpus.replies(model)`` a prompt asked before is answered from there."""
        asked = embedded(questions, self.make_embedder, self.dims)
        results = prompts.format_hits(self.results(self.hits(asked), asked))
        built = prompts.build_prompts(asked.select("query_id", "question"), results)
        return enrich.answer(built, make_client, system, **options)


def ask(
    chunks: DataFrame,
    questions: DataFrame,
    make_client: Callable,
    system: str = prompts.SYSTEM,
    k: int = rt.DEFAULT_K,
    **options,
) -> DataFrame:
    """``query_id, answer, error``. ``questions``: ``query_id, question,
    embedding`` (embedded with the model of the chunks)."""
    results = prompts.format_hits(retrieve(chunks, questions, k))
    asked = prompts.build_prompts(questions.select("query_id", F.col("question")), results)
    return enrich.answer(asked, make_client, system, **options)
