"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row.

    Catalyst may put the definition of a column in place of its name, also
    inside a lambda, where it would then be computed once per *element*. A
    lambda variable is always bound to a finished value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """``keep`` plus new columns that are finished values from here on.

    Between plain selects Catalyst may merge steps and repeat an expensive
    expression at each use. It does not look through a generator, so the new
    columns pass through a one-row ``inline``.
    """
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*keep, F.inline(made))


def numbered(items: Column) -> Column:
    """``array<struct<at,item>>`` with positions from 0."""
    return F.transform(items, lambda x, i: F.struct(i.alias("at"), x.alias("item")))


def last_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """As ``numbered``, keeping of all items with the same key the last one.

    Sorting by (key, position) puts equal keys side by side, so the row needs
    no comparison of all pairs and the table needs no shuffle.
    """

    def keep(d: Column) -> Column:
        order = d["order"]
        final = F.filter(
            order,
            lambda o, j: (j == F.size(order) - 1) | (F.get(order, j + 1)["key"] != o["key"]),
        )
        return F.transform(
            F.array_sort(F.transform(final, lambda o: o["at"])),
            lambda i: F.struct(i.alias("at"), F.get(d["items"], i).alias("item")),
        )

    def sort(d: Column) -> Column:
        order = F.array_sort(
            F.transform(
                d["items"], lambda x, i: F.struct(key(x).alias("key"), i.alias("at"))
            )
        )
        return let(F.struct(d["items"].alias("items"), order.alias("order")), keep)

    return let(F.struct(items.alias("items")), sort)
