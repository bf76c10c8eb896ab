"""Token-bounded chunks from plain text.

A document is one row and is chunked inside that row: split, measure and
re-join are JVM array expressions, so chunking adds no shuffle at any scale.
Only the greedy walk, which no array function expresses in linear time, runs in
Python, and it sees nothing but integers.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackleaf.functions import text as tx
from stackleaf.functions.arrays import last_of_each, let, numbered, settle

PARAGRAPH, SENTENCE = 0, 1
DEFAULT_CAP = 1024


def greedy_starts(cap: int):
    """UDF over ``(run, n)`` of one document: positions where a chunk starts.

    A chunk starts where ``run`` changes, or where adding the unit would lift
    the chunk's token sum above ``cap``. A unit above the cap on its own is
    kept whole. The result is increasing and starts with 0.
    """

    @F.pandas_udf("array<int>")
    def starts(run: pd.Series, n: pd.Series) -> pd.Series:
        def walk(runs, sizes):
            out, total, last = [], 0, None
            for at, (r, size) in enumerate(zip(runs.tolist(), sizes.tolist())):
                if at == 0 or r != last or total + size > cap:
                    out.append(at)
                    total = 0
                total += size
                last = r
            return out

        return pd.Series([walk(r, s) for r, s in zip(run, n)])

    return starts


def explode_units(
    items: Column, sizes: Column, cap: int, counter: tx.Counter, carry: Sequence[str] = ()
) -> Column:
    """One array of units from ``items`` (structs with ``para, text`` and the
    fields ``carry``): an item within the cap as it is, a longer one as its
    sentences. Fields: ``kind, para, text, n`` and ``carry``; ``n`` is NULL
    where the counter cannot count inside an array expression."""

    def unit(kind: int, item: Column, text: Column, n: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            item["para"].cast("int").alias("para"),
            text.alias("text"),
            n.cast("int").alias("n"),
            *[item[c].alias(c) for c in carry],
        )

    def count(text: Column) -> Column:
        return counter.each(text) if counter.each else F.lit(None)

    pairs = F.arrays_zip(items.alias("item"), sizes.alias("n"))
    return F.flatten(
        F.transform(
            pairs,
            lambda z: F.when(
                z["n"] <= cap, F.array(unit(PARAGRAPH, z["item"], z["item"]["text"], z["n"]))
            ).otherwise(
                F.transform(
                    tx.sentences(z["item"]["text"]),
                    lambda s: unit(SENTENCE, z["item"], s, count(s)),
                )
            ),
        )
    )


def with_sizes(units: DataFrame, name: str, counter: tx.Counter) -> DataFrame:
    """Add ``_n``, the token counts of the unit array ``name``."""
    if counter.each:
        return units.withColumn("_n", F.col(f"{name}.n"))
    counted = units.withColumn("_n", counter.many(F.col(f"{name}.text")))
    return settle(counted, units.columns, _n=F.col("_n"))


def spans(starts: Column, total: Column) -> Column:
    """Start positions to ``(start, len)`` spans (zero-based)."""
    return let(
        F.struct(starts.alias("starts"), total.alias("total")),
        lambda d: F.transform(
            d["starts"],
            lambda s, i: F.struct(
                s.alias("start"),
                (F.coalesce(F.get(d["starts"], i + 1), d["total"]) - s).alias("len"),
            ),
        ),
    )


def pack_documents(
    docs: DataFrame,
    *,
    keep: Sequence[str],
    text: str = "markdown",
    cap: int = DEFAULT_CAP,
    separator: str = r"\n\n+",
    counter: tx.Counter | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Greedy paragraph packing.

    Paragraphs join (by a blank line) while their token sum stays within
    ``cap``. A paragraph above the cap closes the open chunk and is packed
    sentence by sentence (joined by one space) on its own. Token counts are
    taken per unit; joiners are not counted. Documents without text give no
    chunk. With ``distinct``, of equal chunks in a document only the last is
    kept; numbers and totals still count all of them. Result: ``keep`` plus
    ``chunk_index, total_chunks, kind, text``.
    """
    counter = counter or tx.word_counter()
    items = F.transform(
        tx.paragraphs(F.col(text), separator),
        lambda p, i: F.struct(i.alias("para"), p.alias("text")),
    )
    paras = settle(docs, keep, _items=items)
    sized = paras.withColumn("_sizes", counter.many(F.col("_items.text")))
    units = settle(
        sized, keep, _units=explode_units(F.col("_items"), F.col("_sizes"), cap, counter)
    )
    # paragraphs share run -1; the sentences of a paragraph share its position
    run = F.transform(
        F.col("_units"), lambda u: F.when(u["kind"] == SENTENCE, u["para"]).otherwise(F.lit(-1))
    )
    bounded = with_sizes(units, "_units", counter).withColumn(
        "_starts", greedy_starts(cap)(run, F.col("_n"))
    )
    chunks = let(
        F.struct(
            F.col("_units.kind").alias("kinds"),
            F.col("_units.text").alias("texts"),
            spans(F.col("_starts"), F.size("_units")).alias("spans"),
        ),
        lambda d: F.transform(d["spans"], lambda b: _join_span(b, d["kinds"], d["texts"])),
    )
    rows = last_of_each(chunks, lambda c: F.sha2(c["text"], 256)) if distinct else numbered(chunks)
    return bounded.select(
        *keep, F.size("_starts").alias("total_chunks"), F.explode(rows).alias("_chunk")
    ).select(
        *keep,
        F.col("_chunk.at").alias("chunk_index"),
        "total_chunks",
        "_chunk.item.kind",
        "_chunk.item.text",
    )


def _join_span(span: Column, kinds: Column, texts: Column) -> Column:
    kind = F.get(kinds, span["start"])
    parts = F.slice(texts, span["start"] + 1, span["len"])
    text = F.when(kind == SENTENCE, F.array_join(parts, " ")).otherwise(
        F.array_join(parts, "\n\n")
    )
    return F.struct(kind.alias("kind"), text.alias("text"))


def plain_chunks(packed: DataFrame) -> DataFrame:
    """Chunk columns for text without structure: the embedded text is the text
    itself, and both heading columns are empty."""
    return packed.withColumns(
        {
            "enriched_text": F.col("text"),
            "headings": F.lit(""),
            "parent_headings": F.lit(""),
            "page_numbers": F.array().cast("array<int>"),
        }
    )


def number_chunks(chunks: DataFrame, document: Sequence[str], order: str) -> DataFrame:
    """``chunk_index`` and ``total_chunks`` for chunks that arrive as rows.

    Chunks made by this package carry both already. No window covers a whole
    document (see ``ordered``).
    """
    from stackleaf.operators.ordered import row_number

    return row_number(chunks, document, order, "chunk_index", total="total_chunks")


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """One row per (config, document, chunk id); the last position wins.

    For chunk rows of any origin. The chunkers of this package do the same
    inside the document row (``distinct``), without a shuffle.

    Ranking with ``= 1`` lets Spark cut every key to one row per map task
    before the shuffle, so a chunk repeated a million times moves once a task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("pipeline_config_hash", "content_hash", "chunk_id").orderBy(
        F.desc("chunk_index")
    )
    return (
        chunks.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")
    )
