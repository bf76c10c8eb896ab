"""Chunks from structured documents: headings, paragraphs, lists, tables, pages."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackleaf.functions import headings as hd
from stackleaf.functions import text as tx
from stackleaf.functions.arrays import last_of_each, let, numbered, settle
from stackleaf.operators.chunking import (
    DEFAULT_CAP,
    PARAGRAPH,
    SENTENCE,
    explode_units,
    spans,
    with_sizes,
)
from stackleaf.operators.ordered import previous, running_sum

# Markdown forms told apart: a heading line, a list item line, a run of table lines.
HEADING_LINE = r"(?dm)^(#{1,6}[ \t][^\n]*)$"
LIST_LINE = r"(?dm)^([ \t]*(?:[-*+]|\d+[.)])[ \t][^\n]*)$"
TABLE_LINES = r"(?dm)((?:^\|[^\n]*\n?)+)"


def blocks_from_markdown(markdown: Column) -> Column:
    """``array<struct<idx,kind,level,text,page_no>>`` in reading order.

    Heading lines, list items and tables become blocks of their own; what is
    left between blank lines is a paragraph. Text has no pages, so ``page_no``
    is NULL.
    """
    apart = markdown
    for form in (HEADING_LINE, LIST_LINE, TABLE_LINES):
        apart = F.regexp_replace(apart, form, "\n\n$1\n\n")

    def block(part: Column, at: Column) -> Column:
        hashes = F.regexp_extract(part, r"^(#{1,6})[ \t]", 1)
        marker = F.regexp_extract(part, r"^((?:[-*+]|\d+[.)])[ \t]+)", 1)
        kind = (
            F.when(hashes != "", F.lit("heading"))
            .when(marker != "", F.lit("list"))
            .when(part.startswith("|"), F.lit("table"))
            .otherwise(F.lit("paragraph"))
        )
        body = tx.strip(F.substring(part, F.length(hashes) + F.length(marker) + 1, F.length(part)))
        return F.struct(
            at.cast("int").alias("idx"),
            kind.alias("kind"),
            F.length(hashes).alias("level"),
            body.alias("text"),
            F.lit(None).cast("int").alias("page_no"),
        )

    return F.transform(tx.paragraphs(apart), block)


def saved_blocks(blocks: Column, markdown: Column) -> Column:
    """Blocks saved by the parser if there are any, else read from the saved
    text, so that a document can be chunked again without parsing it again."""
    return F.coalesce(blocks, blocks_from_markdown(markdown))


def list_runs(blocks: Column, merge: bool = True) -> Column:
    """Blocks as units ``(kind, text, pages)``; with ``merge``, consecutive
    list items form one unit (items joined by a newline)."""

    def unit(members: Column) -> Column:
        return F.struct(
            F.get(members, F.lit(0))["kind"].alias("kind"),
            F.array_join(F.transform(members, lambda b: b["text"]), "\n").alias("text"),
            F.filter(
                F.transform(members, lambda b: b["page_no"]), lambda p: p.isNotNull()
            ).alias("pages"),
        )

    def single(b: Column) -> Column:
        pages = F.when(b["page_no"].isNotNull(), F.array(b["page_no"])).otherwise(
            F.array().cast("array<int>")
        )
        return F.struct(b["kind"].alias("kind"), b["text"].alias("text"), pages.alias("pages"))

    apart = F.transform(blocks, single)
    if not merge:
        return apart

    def islands(d: Column) -> Column:
        kinds = F.transform(d["b"], lambda b, i: F.struct(b["kind"].alias("kind"), i.alias("i")))
        opens = F.filter(
            kinds,
            lambda k: (k["kind"] != "list")
            | (k["i"] == 0)
            | (F.get(d["b"], k["i"] - 1)["kind"] != "list"),
        )
        return F.transform(
            spans(F.transform(opens, lambda k: k["i"]), F.size(d["b"])),
            lambda s: unit(F.slice(d["b"], s["start"] + 1, s["len"])),
        )

    listed = F.exists(blocks, lambda b: b["kind"] == "list")
    return F.when(listed, let(F.struct(blocks.alias("b")), islands)).otherwise(apart)


def contextualize(parents: Column, heading: Column, text: Column) -> Column:
    """Text to embed: parent headings, own heading, text, one per line; empty
    parts are left out."""

    def full(x: Column) -> Column:
        return F.when(x != "", x)

    return F.concat_ws("\n", full(parents), full(heading), text)


def place_chunks(cap: int, merge_peers: bool):
    """UDF: where chunks start among the pieces of a document, and which
    headings are open there.

    Per unit: ``numbers`` (section number, empty if unnumbered, NULL if the
    unit is no heading) and ``marks`` (hash of the heading). Per piece:
    ``kinds``, ``paras`` (its unit) and ``n`` (tokens). Texts stay in the JVM;
    open headings come back as unit positions.
    """

    def place(numbers, marks, kinds, paras, sizes):
        def walk(numbers, marks, kinds, paras, sizes):
            starts, opens = [], []
            opened, unit, path, total, last = [], 0, (), 0, None
            pieces = zip(kinds.tolist(), paras.tolist(), sizes.tolist())
            for at, (kind, para, size) in enumerate(pieces):
                while unit < para:
                    number = numbers[unit]
                    if number is not None:
                        opened = [o for o in opened if o[0] and number.startswith(o[0] + ".")]
                        opened.append((number, unit))
                        path = tuple(marks[p] for _, p in opened)
                    unit += 1
                owner = -1 if merge_peers and kind == PARAGRAPH else para
                here = (path, owner)
                if here != last or total + size > cap:
                    starts.append(at)
                    opens.append([p for _, p in opened])
                    total = 0
                total += size
                last = here
            return starts, opens

        rows = [walk(*row) for row in zip(numbers, marks, kinds, paras, sizes)]
        return pd.DataFrame(rows, columns=["starts", "open"])

    place.__annotations__ = dict.fromkeys(
        ("numbers", "marks", "kinds", "paras", "sizes"), pd.Series
    ) | {"return": pd.DataFrame}
    return F.pandas_udf(place, "starts array<int>, open array<array<int>>")


def chunk_blocks(
    docs: DataFrame,
    *,
    keep: Sequence[str],
    blocks: str = "blocks",
    cap: int = DEFAULT_CAP,
    merge_peers: bool = True,
    merge_list_items: bool = True,
    counter: tx.Counter | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Structure-aware chunks, made inside each document row (no shuffle).

    Units are blocks other than headings. A unit above ``cap`` is packed
    sentence by sentence. With ``merge_peers``, neighbours under the same
    heading path join while their token sum stays within ``cap``; without it
    every unit keeps to itself. No chunk crosses a change of heading path. The
    path of the last heading carries on to the blocks below it. With
    ``distinct``, of chunks with equal embedded text only the last is kept.
    Result: ``keep`` plus ``chunk_index, total_chunks, text, enriched_text, headings,
    parent_headings, page_numbers``.
    """
    counter = counter or tx.word_counter()
    given = settle(docs, keep, _blocks=F.col(blocks))
    units = settle(given, keep, _units=list_runs(F.col("_blocks"), merge_list_items))
    titled = F.transform(
        "_units", lambda u: F.when((u["kind"] == "heading") & (u["text"] != ""), u["text"])
    )
    content = F.filter(
        F.transform(
            "_units",
            lambda u, i: F.struct(
                u["kind"].alias("kind"), i.alias("para"), u["text"].alias("text"), u["pages"].alias("pages")
            ),
        ),
        lambda u: u["kind"] != "heading",
    )
    parted = settle(units, keep, _titles=titled, _items=content)
    sized = parted.withColumn("_sizes", counter.many(F.col("_items.text")))
    pieces = settle(
        sized,
        [*keep, "_titles"],
        _pieces=explode_units(F.col("_items"), F.col("_sizes"), cap, counter, carry=["pages"]),
        _numbers=F.transform("_titles", hd.section_number),
        _marks=F.transform("_titles", lambda t: F.xxhash64(t)),
    )
    own = [*keep, "_titles", "_pieces"]
    counted = with_sizes(pieces, "_pieces", counter)
    placed = counted.select(
        *own,
        place_chunks(cap, merge_peers)(
            "_numbers", "_marks", F.col("_pieces.kind"), F.col("_pieces.para"), "_n"
        ).alias("_at"),
    )

    def chunk(b: Column, i: Column, d: Column) -> Column:
        members = F.slice(d["pieces"], b["start"] + 1, b["len"])
        texts = F.transform(members, lambda m: m["text"])
        return F.struct(
            F.when(F.get(members, F.lit(0))["kind"] == SENTENCE, F.array_join(texts, " "))
            .otherwise(F.array_join(texts, "\n\n"))
            .alias("text"),
            F.transform(F.get(d["open"], i), lambda p: F.get(d["titles"], p)).alias("path"),
            F.array_sort(
                F.array_distinct(F.flatten(F.transform(members, lambda m: m["pages"])))
            ).alias("page_numbers"),
        )

    chunks = let(
        F.struct(
            F.col("_pieces").alias("pieces"),
            F.col("_titles").alias("titles"),
            F.col("_at.open").alias("open"),
            spans(F.col("_at.starts"), F.size("_pieces")).alias("spans"),
        ),
        lambda d: F.transform(d["spans"], lambda b, i: chunk(b, i, d)),
    )

    def embedded(c: Column) -> Column:
        heading = F.coalesce(F.try_element_at(c["path"], F.lit(-1)), F.lit(""))
        return contextualize(hd.parent_path(c["path"]), heading, c["text"])

    kept = last_of_each(chunks, lambda c: F.sha2(embedded(c), 256)) if distinct else numbered(chunks)
    rows = placed.select(
        *keep, F.size("_at.starts").alias("total_chunks"), F.explode(kept).alias("_c")
    ).select(*keep, "total_chunks", F.col("_c.at").alias("chunk_index"), F.col("_c.item").alias("_c"))
    return rows.select(
        *keep,
        "chunk_index",
        "total_chunks",
        F.col("_c.text").alias("text"),
        embedded(F.col("_c")).alias("enriched_text"),
        hd.path(F.col("_c.path")).alias("headings"),
        hd.parent_path(F.col("_c.path")).alias("parent_headings"),
        F.col("_c.page_numbers").alias("page_numbers"),
    )


def merge_list_rows(rows: DataFrame, group: Sequence[str], order: str, kind: str, text: str) -> DataFrame:
    """Consecutive list items as one unit, for blocks that arrive as rows.

    Gaps and islands over the two-level ordered scans, so a document with very
    many blocks is spread over all tasks. Result: ``group``, ``unit`` (its
    number), ``kind``, ``items``, ``text``.
    """
    marked = previous(rows, group, order, F.col(kind), "_before")
    opens = F.when(
        (F.col(kind) == "list") & (F.coalesce("_before", F.lit("")) == "list"), F.lit(0)
    ).otherwise(F.lit(1))
    numbered = running_sum(marked, group, order, opens, "unit")
    return (
        numbered.groupBy(*group, "unit")
        .agg(
            F.min(kind).alias("kind"),
            F.count("*").alias("items"),
            F.array_sort(F.collect_list(F.struct(order, text))).alias("_m"),
        )
        .select(*group, "unit", "kind", "items", F.array_join(F.col(f"_m.{text}"), "\n").alias("text"))
    )
