"""Files as rows: scan, classify, route, decode, parse."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackleaf.functions import keys
from stackleaf.functions.text import clean

# Suffixes handled, by parser family.
DOCUMENT_SUFFIXES = (".pdf",)
TEXT_SUFFIXES = (".md", ".txt")
SUPPORTED = DOCUMENT_SUFFIXES + TEXT_SUFFIXES
FAMILIES = dict.fromkeys(DOCUMENT_SUFFIXES, "document") | dict.fromkeys(TEXT_SUFFIXES, "plaintext")
# Content type by suffix.
TYPES = {".pdf": "pdf", ".ipynb": "notebook", ".md": "markdown", ".txt": "text"}
# Fixed value: a document parse shorter than this counts as failed.
MIN_CHARS = 500
# The same suffixes as a listing glob in any case, so that files of other types
# are dropped while listing and never opened.
SUPPORTED_GLOB = "{*.[pP][dD][fF],*.[mM][dD],*.[tT][xX][tT]}"

BLOCKS = "array<struct<idx:int,kind:string,level:int,text:string,page_no:int>>"

# bytes, path -> text, and blocks (dicts with the fields of BLOCKS) or None
ParseFn = Callable[[bytes, str], tuple[str, list[dict] | None]]


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files directly in ``folder``: ``path, modificationTime,
    length, content``. Sub-folders are not entered."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", SUPPORTED_GLOB).load(folder)
    )


def scan_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Just these files, whatever their type; routing rejects the unsupported."""
    return spark.read.format("binaryFile").load(list(paths))


def supported(path: Column) -> Column:
    return keys.suffix(path).isin(*SUPPORTED)


def _by_suffix(table: dict[str, str], path: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), keys.suffix(path))


def content_type(path: Column) -> Column:
    """Class of a source by its address prefix, else by its suffix."""
    return (
        F.when(~path.rlike("^https?://"), F.coalesce(_by_suffix(TYPES, path), F.lit("unknown")))
        .when(path.rlike(r"youtube\.com|youtu\.be"), F.lit("youtube"))
        .otherwise(F.lit("web"))
    )


def route(path: Column) -> Column:
    """Parser family of a source: ``document``, ``plaintext``, or NULL when
    there is none (the row then belongs to the rejects)."""
    return F.when(~path.rlike("^https?://"), _by_suffix(FAMILIES, path))


def decode(content: Column) -> Column:
    """Bytes as text if they are valid UTF-8, else NULL. Nothing is cleaned."""
    return F.try_validate_utf8(content.cast("string"))


def too_short(markdown: Column, limit: int = MIN_CHARS) -> Column:
    return F.length(markdown) < limit


def parser_udf(make_parser: Callable[[], ParseFn]):
    """UDF ``(content, path) -> (markdown, blocks, error)`` around a user's
    parser, made once per task. One bad file gives an error value in its row;
    the rest of the batch goes on."""

    def parse(batches):
        run = make_parser()

        def one(content, path):
            if content is None:
                return None, None, None
            try:
                text, blocks = run(bytes(content), path)
                return text, blocks, None
            except Exception as problem:  # noqa: BLE001 - isolation is the point
                return None, None, f"{type(problem).__name__}: {problem}"

        for contents, paths in batches:
            rows = [one(c, p) for c, p in zip(contents, paths)]
            yield pd.DataFrame(rows, columns=["markdown", "blocks", "error"])

    parse.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, pd.Series]],
        "return": Iterator[pd.DataFrame],
    }
    return F.pandas_udf(parse, f"markdown string, blocks {BLOCKS}, error string")


def parse_files(
    files: DataFrame,
    *,
    document_parser: Callable[[], ParseFn] | None = None,
    parser_name: str = "document",
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Parse ``path, content`` rows into the parsed schema plus ``reason``.

    One pass over the bytes, one result: good rows have a NULL ``reason``, the
    others say why they failed. Text files pass through as they are; document
    files go to the given parser (only their bytes do), are cleaned, and must
    reach ``min_chars``.
    """
    family = F.col("_family")
    routed = files.select(
        F.col("path").alias("source_path"),
        keys.filename(F.col("path")).alias("filename"),
        keys.content_hash(F.col("content")).alias("content_hash"),
        F.ltrim(keys.suffix(F.col("path")), F.lit(".")).alias("content_type"),
        route(F.col("path")).alias("_family"),
        "content",
    )
    if document_parser is None:
        reply = F.struct(
            F.lit(None).cast("string").alias("markdown"),
            F.lit(None).cast(BLOCKS).alias("blocks"),
            F.when(family == "document", F.lit("no document parser given")).alias("error"),
        )
    else:
        reply = parser_udf(document_parser)(
            F.when(family == "document", F.col("content")), F.col("source_path")
        )
    parsed = routed.withColumn("_reply", reply).select(
        "source_path",
        "filename",
        "content_hash",
        "content_type",
        "_family",
        F.when(family == "document", F.lit(parser_name)).otherwise(family).alias("parser"),
        F.when(family == "plaintext", decode(F.col("content")))
        .when(family == "document", clean(F.col("_reply.markdown")))
        .alias("markdown"),
        F.col("_reply.blocks").alias("blocks"),
        F.when(family == "document", F.col("_reply.error")).alias("_error"),
    )
    markdown = F.col("markdown")
    reason = (
        F.when(family.isNull(), F.concat(F.lit("no parser for "), content_type(F.col("source_path"))))
        .when(F.col("_error").isNotNull(), F.col("_error"))
        .when((family == "plaintext") & markdown.isNull(), F.lit("invalid UTF-8"))
        .when(markdown.isNull(), F.lit("no text"))
        .when((family == "document") & too_short(markdown, min_chars), F.lit("too short"))
    )
    return parsed.select(
        "source_path",
        "filename",
        "content_hash",
        "content_type",
        "parser",
        "markdown",
        "blocks",
        keys.doc_key(F.col("source_path"), F.col("content_hash"), F.col("parser")).alias("doc_key"),
        reason.alias("reason"),
    )
