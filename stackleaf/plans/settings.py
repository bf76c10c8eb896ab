"""Settings of one processing generation and their fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Every choice that changes the stored chunks. Names and
    defaults, which the fingerprint depends on."""

    parser: str = "docling"
    parser_ocr: bool = True
    chunker: str = "docling"
    chunk_tokenizer: str = "Snowflake/snowflake-arctic-embed-l-v2.0"
    chunk_max_tokens: int = 1024
    chunk_merge_peers: bool = True
    chunk_merge_list_items: bool = True
    embed_model: str = "Snowflake/snowflake-arctic-embed-l-v2.0"
    summary_model: str = "gemma4:e4b"

    def fingerprint(self) -> str:
        """First 12 hex digits of the SHA-256 of the sorted JSON form."""
        text = json.dumps(asdict(self), sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:12]


def fingerprint(**columns: Column) -> Column:
    """The same fingerprint for settings held in columns, one per setting.
    Strings must need no JSON escapes; ``to_json`` spaces its output
    differently, so the text is put together here."""
    defaults = asdict(Settings())
    parts: list[Column] = []
    for at, name in enumerate(sorted(defaults)):
        value = columns.get(name, F.lit(defaults[name]))
        quoted = isinstance(defaults[name], str)
        parts.append(F.lit(f'{"{" if at == 0 else ", "}"{name}": ' + ('"' if quoted else "")))
        parts.append(value.cast("string"))
        if quoted:
            parts.append(F.lit('"'))
    return F.left(F.sha2(F.concat(*parts, F.lit("}")), 256), F.lit(12))
