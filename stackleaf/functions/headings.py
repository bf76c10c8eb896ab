"""Section numbers and heading ancestry.

A heading is *numbered* when its first token is digits joined by single dots
(``1``, ``1.2``); anything else (``Preface``, ``1.``, ``A.1``) is not. An
unnumbered heading stands alone. A numbered one keeps the open headings whose
number is a proper dotted prefix of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackleaf.functions.text import BLANK_CLASS

# Fixed value: joins the parts of a heading path.
PATH_SEPARATOR = " => "


def section_number(heading: Column) -> Column:
    """Leading section number, or an empty string."""
    pattern = rf"^[{BLANK_CLASS}]*(\p{{Nd}}+(?:\.\p{{Nd}}+)*)(?![^{BLANK_CLASS}])"
    return F.regexp_extract(heading, pattern, 1)


def heading_level(number: Column) -> Column:
    """Depth given by a section number; unnumbered headings are level 1."""
    return F.when(number == "", F.lit(1)).otherwise(F.size(F.split(number, r"\.")))


def ancestor_numbers(number: Column) -> Column:
    """Proper dotted prefixes of a section number, outermost first."""
    parts = F.split(number, r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."),
    )
    # sequence(1, 0) counts downwards, so shallow numbers need the guard
    return F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<string>"))


def path(parts: Column) -> Column:
    return F.array_join(parts, PATH_SEPARATOR)


def parent_path(parts: Column) -> Column:
    return F.when(F.size(parts) < 2, F.lit("")).otherwise(
        path(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    )
