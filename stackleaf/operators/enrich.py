"""Model calls over tables: summaries, embeddings, answers.

A model call is slow, costs money and has no transaction. So each distinct
input is sent once (equal texts are one row), known results are taken from a
saved table, and new results are saved before anything uses them: a lost
executor repeats at most the calls of its own unfinished task. Keep speculative
execution off for these stages.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackleaf.functions import replies
from stackleaf.functions.text import word_list
from stackleaf.sources.reply_store import ReplyStore
from stackleaf.sources.tables import small_batches, work_folder

# Calls in flight per task, reply limits, waits between tries.
IN_FLIGHT = 5
SUMMARY_TOKENS = 1000
ANSWER_TOKENS = 8192
WAITS = (60, 120, 240, 480)
# Texts that an embedder gets at a time.
EMBEDDED_ROWS = 1000

SUMMARY_SYSTEM = (
    "State the main point of the text in one or two sentences. "
    "Reply with those sentences alone: no title, label or markup."
)
SUMMARY_FORM = {
    "type": "object",
    "properties": {"summary": {"type": "string"}},
    "required": ["summary"],
}


class Client(Protocol):
    """A user's model client. ``complete_structured(system, user, form,
    max_tokens) -> dict`` may be offered too and is then preferred."""

    def complete(self, system: str, user: str, max_tokens: int) -> str: ...


class Throttled(Exception):
    """Raised by a client when the call may be tried again later."""


def _call(client: Any, system: str, user: str, max_tokens: int, form, waits, sleep) -> str:
    for wait in (*waits, None):
        try:
            if form is not None and hasattr(client, "complete_structured"):
                out = client.complete_structured(system, user, form, max_tokens)
                return str(out.get("summary") or "")
            return client.complete(system, user, max_tokens)
        except Throttled:
            if wait is None:
                raise
            sleep(wait)
    raise AssertionError("unreachable")


def reply_udf(
    make_client: Callable[[], Client],
    system: str,
    max_tokens: int,
    form: dict | None = None,
    in_flight: int = IN_FLIGHT,
    waits: Sequence[float] = WAITS,
    sleep: Callable[[float], None] = time.sleep,
):
    """UDF ``text -> (reply, error)``. One client per task, at most
    ``in_flight`` calls at once in it, order kept, waits between tries. A call
    that fails for good gives an error value in its row."""

    def ask(batches):
        client = make_client()

        def one(text):
            if text is None:
                return None, "no text"
            try:
                return _call(client, system, text, max_tokens, form, waits, sleep), None
            except Exception as problem:  # noqa: BLE001 - one row must not stop the rest
                return None, f"{type(problem).__name__}: {problem}"

        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            for texts in batches:
                yield pd.DataFrame(list(pool.map(one, texts)), columns=["reply", "error"])

    ask.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(ask, "reply string, error string")


def call_once(
    inputs: DataFrame,
    key: str,
    text: str,
    udf,
    saved: str | None = None,
    rows_per_task: int = 1000,
    kind: str = "string",
) -> DataFrame:
    """``key, reply, error`` for each distinct key. With ``saved`` (a folder of
    the corpus), keys already answered there are not sent again, new replies
    are added to it first, and the result is read from it; ``inputs`` should be
    cheap to read again. The calls are dealt out in tasks of about
    ``rows_per_task``, which is what one lost task can cost."""
    small_batches(inputs.sparkSession)
    if saved is None:
        todo = inputs.select(key, text).dropDuplicates([key])
        return todo.withColumn("_r", udf(F.col(text))).select(key, "_r.reply", "_r.error")
    wanted = inputs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = ReplyStore(inputs.sparkSession, saved, kind).complete(wanted, udf, rows_per_task)
    return found.withColumnRenamed("key", key)


def _text_id(*parts: Column | str) -> Column:
    """Key of a call: the digest of all that decides its reply. A null stands apart."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """The table written to the working folder and read back, so that it is made once."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def summarize(
    chunks: DataFrame,
    make_client: Callable[[], Client] | None = None,
    saved: str | None = None,
    max_tokens: int = SUMMARY_TOKENS,
    **options,
) -> DataFrame:
    """Add ``summary`` (and ``summary_error``). Without a client the summary
    is the first two sentences; a failed call falls back to the start of the
    text. ``chunks`` needs ``chunk_id`` and ``text``."""
    if make_client is None:
        return chunks.withColumn("summary", replies.lead_sentences(F.col("text"))).withColumn(
            "summary_error", F.lit(None).cast("string")
        )
    udf = reply_udf(make_client, SUMMARY_SYSTEM, max_tokens, form=SUMMARY_FORM, **options)
    asked = [F.lit(SUMMARY_SYSTEM).alias("system"), F.lit(max_tokens).alias("most"), "text"]
    keyed = chunks.withColumn("_text_id", _text_id(*asked))
    if saved is not None:
        keyed = _kept(keyed, "summarise")
    known = call_once(keyed, "_text_id", "text", udf, saved)
    return (
        keyed.join(known, "_text_id", "left")
        .withColumn("summary", replies.summary_or_fallback(F.col("reply"), F.col("text")))
        .withColumnRenamed("error", "summary_error")
        .drop("_text_id", "reply")
    )


def answer(
    prompts: DataFrame,
    make_client: Callable[[], Client],
    system: str,
    max_tokens: int = ANSWER_TOKENS,
    saved: str | None = None,
    **options,
) -> DataFrame:
    """``query_id, answer, error`` for each prompt. With ``saved`` (a folder for one
    model), equal prompts are sent once and answered from there later."""
    udf = reply_udf(make_client, system, max_tokens, **options)
    small_batches(prompts.sparkSession)
    if saved is None:
        answered = prompts.withColumn("_r", udf(F.col("prompt"))).select("query_id", "_r.reply", "_r.error")
    else:
        asked = [F.lit(system).alias("system"), F.lit(max_tokens).alias("most"), "prompt"]
        keyed = _kept(prompts.select("query_id", "prompt", _text_id(*asked).alias("_text_id")), "prompts")
        known = call_once(keyed, "_text_id", "prompt", udf, saved)
        answered = keyed.join(known, "_text_id", "left")
    return answered.select("query_id", F.col("reply").alias("answer"), "error")


def embed(
    df: DataFrame,
    make_embedder,
    text: str = "enriched_text",
    out: str = "embedding",
    once: bool = True,
    saved: str | None = None,
) -> DataFrame:
    """Add a vector made by a user's ``list[str] -> list[vector]``, made once
    per task and called for up to ``EMBEDDED_ROWS`` texts of an Arrow batch, which is
    bounded in bytes, so what a worker holds does not grow with the table. With ``once``, equal texts are
    embedded a single time and the vector is joined back. With ``saved`` (a folder
    for one model), vectors are kept there and texts known there are not embedded
    again."""

    def run(batches):
        vectors = make_embedder()
        for texts in batches:
            parts = (texts.iloc[at : at + EMBEDDED_ROWS].tolist() for at in range(0, len(texts), EMBEDDED_ROWS))
            yield pd.Series([np.asarray(v, dtype=np.float32) for part in parts for v in vectors(part)], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    embedder = F.pandas_udf(run, "array<float>")
    small_batches(df.sparkSession)
    if saved is not None:
        keyed = _kept(df.withColumn("_text_id", _text_id(F.col(text).alias("text"))), "embed")

        def reply(column: Column) -> Column:
            return F.struct(embedder(column).alias("reply"), F.lit(None).cast("string").alias("error"))

        known = call_once(keyed, "_text_id", text, reply, saved, kind="array<float>")
        return keyed.join(known.select("_text_id", F.col("reply").alias(out)), "_text_id", "left").drop("_text_id")
    vector = embedder(F.col(text))
    if not once:
        return df.withColumn(out, vector)
    keyed = df.withColumn("_text_id", F.sha2(text, 256))
    made = keyed.select("_text_id", text).dropDuplicates(["_text_id"]).select(
        "_text_id", vector.alias(out)
    )
    return keyed.join(made, "_text_id", "left").drop("_text_id")


def hashing_embed(
    df: DataFrame, dims: int = 256, text: str = "enriched_text", out: str = "embedding"
) -> DataFrame:
    """Default embedder without a model: hashed word counts, scaled to length
    one. Runs in the JVM; the same text gives the same vector everywhere."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tokens = word_list(F.lower(F.col(text)))
    counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims).transform(
        df.withColumn("_tokens", tokens)
    )
    scaled = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return scaled.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")
