"""Ordered scans over rows of one group, in two levels.

A window over ``partitionBy(document)`` sends a whole document to one task. A
document that holds a third of all rows would then run alone. Here every scan
first works in *spans*: a span is the rows of a group whose position falls in
one range of ``SPAN`` positions, so it has a known largest size. Spans are
spread over all tasks; one summary row per span is scanned per group; the
result is added back to the rows of the span.

``order`` is an integer position that is unique in its group.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackleaf.functions.headings import section_number

SPAN = 4096


def _in_spans(df: DataFrame, group: Sequence[str], order: str, span: int) -> DataFrame:
    at = F.col(order).cast("bigint")
    return df.withColumn("_span", at - F.pmod(at, F.lit(span)))


def _scan(df, group, order, local, summary, across, merge, span):
    """The shared skeleton: per-span windows and one summary per span.

    ``local``  columns computed in the span's window
    ``summary`` aggregates per span
    ``across``  columns over the span summaries of a group
    ``merge``   the new columns

    Rows are shuffled once, by span. The summaries come from a second, pruned
    pass over the input with partial sums on the map side.
    """
    key = [*group, "_span"]
    spread = _in_spans(df, group, order, span)
    summaries = spread.groupBy(*key).agg(*summary)
    over = Window.partitionBy(*group).orderBy("_span")
    carried = summaries.select(*key, *[fn(over).alias(name) for name, fn in across.items()])
    window = Window.partitionBy(*key).orderBy(order)
    rows = spread.select("*", *[fn(window).alias(name) for name, fn in local.items()])
    return rows.join(carried, key).select(
        *df.columns, *[column.alias(name) for name, column in merge.items()]
    )


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _whole(group):
    return Window.partitionBy(*group)


def row_number(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    out: str,
    total: str | None = None,
    span: int = SPAN,
) -> DataFrame:
    """Zero-based position in the group and, as ``total``, the group's size."""
    merge = {out: (F.col("_at") - 1 + F.coalesce("_base", F.lit(0))).cast("int")}
    if total:
        merge[total] = F.col("_all")
    return _scan(
        df, group, order,
        local={"_at": lambda w: F.row_number().over(w)},
        summary=[F.count("*").alias("_rows")],
        across={
            "_base": lambda w: F.sum("_rows").over(_before(w)),
            "_all": lambda w: F.sum("_rows").over(_whole(group)),
        },
        merge=merge, span=span,
    )


def running_sum(df: DataFrame, group: Sequence[str], order: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """Sum of ``value`` up to and including the row."""
    return _scan(
        df.withColumn("_value", value), group, order,
        local={"_part": lambda w: F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, 0))},
        summary=[F.sum("_value").alias("_sum")],
        across={"_base": lambda w: F.sum("_sum").over(_before(w))},
        merge={out: F.col("_part") + F.coalesce("_base", F.lit(0))}, span=span,
    ).drop("_value")


def carry_forward(df: DataFrame, group: Sequence[str], order: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """Last non-NULL ``value`` up to and including the row."""
    return _scan(
        df.withColumn("_value", value), group, order,
        local={"_near": lambda w: F.last("_value", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0))},
        summary=[F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last")],
        across={"_far": lambda w: F.last("_last", ignorenulls=True).over(_before(w))},
        merge={out: F.coalesce("_near", "_far")}, span=span,
    ).drop("_value")


def previous(df: DataFrame, group: Sequence[str], order: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """``value`` of the row before, NULL for the first row of the group."""
    wrapped = F.struct(value.alias("v"))
    return _scan(
        df.withColumn("_value", wrapped), group, order,
        local={"_near": lambda w: F.lag("_value").over(w)},
        summary=[F.max_by("_value", order).alias("_last")],
        across={"_far": lambda w: F.lag("_last").over(w)},
        merge={out: F.coalesce("_near", "_far")["v"]}, span=span,
    ).drop("_value")


# --- heading ancestry over rows ------------------------------------------------

# open headings as two flat arrays: ``numbers`` and ``texts``
_STATE = "numbers array<string>, texts array<string>"
_TEXTS = T.ArrayType(T.StringType())


@F.pandas_udf(
    T.StructType().add("shared", T.StringType()).add("numbers", _TEXTS).add("texts", _TEXTS)
)
def _span_effect(numbers: pd.Series, headings: pd.Series) -> pd.DataFrame:
    """What one span does to the open headings: ``shared`` is the dotted prefix
    under which all its headings lie (an older heading outlives the span only
    if its number is that prefix or one of its own prefixes; NULL if none can),
    ``numbers`` and ``texts`` are the headings the span itself leaves open."""

    def effect(nums, titles):
        shared, opened = None, []
        for number, title in zip(nums, titles):
            parents = number.split(".")[:-1]
            if shared is None:
                shared = parents
            else:
                n = 0
                while n < min(len(shared), len(parents)) and shared[n] == parents[n]:
                    n += 1
                shared = shared[:n]
            opened = [o for o in opened if o[0] and number.startswith(o[0] + ".")]
            opened.append((number, title))
        return (
            ".".join(shared) if shared else None,
            [o[0] for o in opened],
            [o[1] for o in opened],
        )

    rows = [effect(n, t) for n, t in zip(numbers, headings)]
    return pd.DataFrame(rows, columns=["shared", "numbers", "texts"])


@F.pandas_udf(T.ArrayType(_TEXTS))
def _replay(numbers: pd.Series, headings: pd.Series, open_n: pd.Series, open_t: pd.Series) -> pd.Series:
    """Path at each heading of a span, from the headings open at its entry."""

    def walk(nums, titles, in_n, in_t):
        opened = list(zip(in_n, in_t))
        out = []
        for number, title in zip(nums, titles):
            opened = [o for o in opened if o[0] and number.startswith(o[0] + ".")]
            opened.append((number, title))
            out.append([t for _, t in opened])
        return out

    return pd.Series([walk(*row) for row in zip(numbers, headings, open_n, open_t)])


def _entry_states(group: Sequence[str]):
    """Per group: the open headings at the entry of every span, composed from
    the span effects in order. One short row per span goes in."""

    def compose(effects: pd.DataFrame) -> pd.DataFrame:
        effects = effects.sort_values("_span")
        opened, entries = [], []
        for prefix, nums, titles in zip(effects["shared"], effects["numbers"], effects["texts"]):
            entries.append(([o[0] for o in opened], [o[1] for o in opened]))
            opened = [
                o for o in opened if prefix and o[0] and (prefix + ".").startswith(o[0] + ".")
            ] + list(zip(nums, titles))
        out = effects[[*group, "_span"]].copy()
        out["numbers"] = [e[0] for e in entries]
        out["texts"] = [e[1] for e in entries]
        return out

    return compose


def heading_paths(df: DataFrame, group: Sequence[str], order: str, heading: str, span: int = SPAN) -> DataFrame:
    """``group, order, path`` (array) for every non-empty heading.

    The list of open headings is a sequential scan, yet what a span does to it
    is small and composes: which older headings outlive the span, and which new
    ones it leaves open. So spans are summarised in parallel, the summaries are
    composed per group (one short row per span), and spans are replayed in
    parallel from the state at their entry.
    """
    key = [*group, "_span"]
    entry = F.struct(
        F.col(order).alias("at"),
        section_number(F.col(heading)).alias("number"),
        F.col(heading).alias("heading"),
    )
    spans = (
        _in_spans(df.where(F.coalesce(heading, F.lit("")) != ""), group, order, span)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    )
    effects = spans.select(
        *key, _span_effect(F.col("_rows.number"), F.col("_rows.heading")).alias("_effect")
    ).select(*key, "_effect.shared", "_effect.numbers", "_effect.texts")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in effects.select(*key).schema)
    entries = effects.groupBy(*group).applyInPandas(_entry_states(group), f"{keys}, {_STATE}")
    return (
        spans.join(entries, key)
        .select(
            *group,
            F.explode(
                F.arrays_zip(
                    F.col("_rows.at").alias("at"),
                    _replay(
                        F.col("_rows.number"), F.col("_rows.heading"), F.col("numbers"), F.col("texts")
                    ).alias("path"),
                )
            ).alias("_r"),
        )
        .select(*group, F.col("_r.at").alias(order), F.col("_r.path").alias("path"))
    )
