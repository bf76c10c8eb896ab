"""Whitespace, paragraph, sentence and token expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Unicode treats as white space when text is
# stripped or split. Java's \s and Spark's trim() know only a few of them.
BLANKS = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20"
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the body of a Java regex class.
BLANK_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The same set, and all other code points, as whole classes for patterns that look at
# every character. Code points below 256 stand one by one, which makes them a
# single lookup, and one comparison keeps them from the ranges of the others.
BLANK = (
    rf"[[{''.join(rf'\x{ord(c):02x}' for c in BLANKS if ord(c) < 256)}]"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
SOLID = (
    rf"[[{''.join(rf'\x{i:02x}' for i in range(256) if chr(i) not in BLANKS)}]"
    r"[\u0100-\u167f\u3001-\x{10ffff}\u2060-\u2fff\u2030-\u205e\u200b-\u2027\u1681-\u1fff\u202a-\u202e]]"
)


@dataclass(frozen=True)
class Counter:
    """Token counting for chunkers. ``many`` counts every string of an array
    column; ``each`` counts one string and may be used inside array
    expressions (None if the counter cannot). Strings come stripped."""

    many: Callable[[Column], Column]
    each: Callable[[Column], Column] | None = None


def strip(x: Column) -> Column:
    """Trim every kind of white space at both ends. A trim with a character
    list looks at the ends only, where a regex would scan the whole text."""
    return F.btrim(x, F.lit(BLANKS))


def clean(x: Column) -> Column:
    """Squeeze runs of three or more newlines to two, then strip."""
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def _nonempty(parts: Column) -> Column:
    return F.array_remove(F.transform(parts, strip), "")


def paragraphs(x: Column, separator: str = r"\n\n+") -> Column:
    """Stripped, non-empty paragraphs in reading order."""
    return _nonempty(F.split(x, separator))


def sentences(x: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` where white space follows."""
    return _nonempty(F.split(x, rf"(?<=[.!?])[{BLANK_CLASS}]+"))


def _runs(stripped: Column) -> Column:
    """Number of non-blank runs: each, with the blanks after it, becomes one
    character. No array of tokens is built."""
    pattern = rf"{SOLID}++[^{SOLID}]*+"
    return F.length(F.regexp_replace(stripped, pattern, "x"))


def words(x: Column) -> Column:
    """Number of white-space separated tokens."""
    return _runs(strip(x))


def word_list(x: Column) -> Column:
    """White-space separated tokens. Empty ones are taken out without a lambda, which
    is evaluated token by token outside generated code."""
    return F.array_remove(F.split(strip(x), rf"{BLANK}+"), "")


def word_counter(special: int = 0) -> Counter:
    """Default counter. ``special`` is added once per string, as a model
    tokenizer adds its begin and end marks to each string it encodes."""

    def each(text: Column) -> Column:
        return _runs(text) + F.lit(special) if special else _runs(text)

    return Counter(many=lambda texts: F.transform(texts, each), each=each)


def model_counter(make_tokenizer: Callable[[], Callable[[str], int]]) -> Counter:
    """Counter backed by a user's tokenizer, built once per Python task.
    Only the strings to count go to Python and only ints come back."""
    from collections.abc import Iterator

    import pandas as pd

    def count(batches):
        tokens = make_tokenizer()
        for texts in batches:
            yield texts.map(lambda row: [tokens(t) for t in row])

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(count, "array<int>")
    return Counter(many=lambda texts: udf(texts))
