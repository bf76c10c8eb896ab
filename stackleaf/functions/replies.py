"""Expressions over model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackleaf.functions.text import BLANK_CLASS, strip

# A heading line "summary", and a label "summary:" with optional
# bold marks, both at the very start and in any case.
SUMMARY_HEADING = rf"(?iu)^[{BLANK_CLASS}]*#{{1,6}}[{BLANK_CLASS}]*summary[{BLANK_CLASS}]*\n+"
SUMMARY_LABEL = (
    rf"(?iu)^[{BLANK_CLASS}]*\**[{BLANK_CLASS}]*summary[{BLANK_CLASS}]*\**"
    rf"[{BLANK_CLASS}]*:[{BLANK_CLASS}]*\**[{BLANK_CLASS}]*"
)
FALLBACK_CHARS = 300


def clean_summary(reply: Column) -> Column:
    """Drop a leading summary heading, then a leading summary label."""
    bare = F.regexp_replace(reply, SUMMARY_HEADING, "")
    return strip(F.regexp_replace(bare, SUMMARY_LABEL, ""))


def summary_or_fallback(reply: Column, text: Column) -> Column:
    """Cleaned reply; a failed call (NULL) falls back to the start of the
    text, so that one failure never stops a document."""
    return F.coalesce(clean_summary(reply), F.left(text, F.lit(FALLBACK_CHARS)))


def structured_field(reply: Column, field: str = "summary") -> Column:
    """One string field of a JSON object reply; empty when it is missing or
    the reply is no object."""
    parsed = F.from_json(reply, f"`{field}` string")
    return F.coalesce(parsed.getField(field), F.lit(""))


def lead_sentences(text: Column, n: int = 2) -> Column:
    """Default summary when no model is given: the first sentences."""
    from stackleaf.functions.text import sentences

    return F.array_join(F.slice(sentences(text), 1, n), " ")
