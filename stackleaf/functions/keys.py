"""Hashes, identifiers and file-name parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_hash(content: Column) -> Column:
    """SHA-256 of the raw bytes, lower-case hex."""
    return F.sha2(content, 256)


def filename(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot; empty for names without one
    (a leading dot alone starts no suffix)."""
    return F.lower(F.regexp_extract(filename(path), r"^.+?(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """File name without its last suffix, blanks and dashes as underscores,
    lower case."""
    bare = F.regexp_replace(filename(path), r"(?<=.)\.[^.]+$", "")
    return F.lower(F.translate(bare, " -", "__"))


def doc_key(path: Column, hash_: Column, parser: Column) -> Column:
    """Folder name of a document's artefacts."""
    return F.concat_ws("_", stem(path), F.left(hash_, F.lit(12)), parser)


def registry_key(hash_: Column, config: Column) -> Column:
    return F.concat_ws("_", hash_, config)


def chunk_id(enriched_text: Column) -> Column:
    """Content-addressed id: the same embedded text gives the same id."""
    return F.left(F.sha2(enriched_text, 256), F.lit(12))


def object_key(config: Column, hash_: Column, chunk: Column) -> Column:
    return F.format_string("chunks/%s/%s_%s.txt", config, hash_, chunk)


def binary_hash(hash_: Column) -> Column:
    """The hex digest as an integer modulo 2**63. The low 16 digits decide,
    since 2**63 divides 16**16."""
    low = F.conv(F.right(hash_, F.lit(16)), 16, 10).cast(T.DecimalType(20, 0))
    return (low % F.lit("9223372036854775808").cast(T.DecimalType(20, 0))).cast("bigint")


def encode_pages(pages: Column) -> Column:
    """Page list to its comma-joined form."""
    return F.array_join(pages.cast("array<string>"), ",")


def decode_pages(joined: Column) -> Column:
    """Comma-joined form to a page list; empty text is an empty list."""
    parts = F.filter(F.split(joined, ","), lambda p: p != "")
    return F.transform(parts, lambda p: p.cast("int"))
