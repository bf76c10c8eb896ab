"""Order inside keys of any size: dense positions, scans by levels, digests of sorted rows.

A key may hold a third of all rows, so nothing here keeps all rows of a key in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from llm.scratch import Scratch

# Pieces that one step of a scan handles together.
FAN = 64
# Keys with more rows than this are looked up in a table sent to all tasks, which
# has at most (all rows / HEAVY) rows.
HEAVY = 100_000


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts from 0 inside each run of equal first columns; the rows are sorted by it."""
    part = TaskContext.get().partitionId()
    last, count = None, -1
    for batch in batches:
        local = []
        for key in batch.column(0).to_pylist():
            count = count + 1 if key == last else 0
            last = key
            local.append(count)
        columns = [*batch.columns, pa.array([part] * len(local), pa.int64()), pa.array(local, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "local"])


def positions(rows: DataFrame, key: str, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``at``, the place from 0 of each row among those of its ``key``
    by ``order``, nulls first.

    Rows are dealt by ranges of key and order, so a large key is spread over
    tasks; equal rows are told apart by where they were read. Only keys cut by
    a range border need an offset: at most two for each range, sent to all tasks.
    """
    names = rows.columns
    sort = [F.col(key), *order, F.monotonically_increasing_id()]
    tagged = rows.select(key, *[c for c in names if c != key], *[c.alias(f"_sort{i}") for i, c in enumerate(sort)])
    by = [F.col(f"_sort{i}").asc_nulls_first() for i in range(len(sort))]
    dealt = tagged.repartitionByRange(*by).sortWithinPartitions(*by).drop(*[f"_sort{i}" for i in range(len(sort))])
    schema = StructType([*dealt.schema.fields, StructField("part", LongType()), StructField("local", LongType())])
    saved = scratch.save(dealt.mapInArrow(_numbered, schema))
    runs = saved.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(F.col(key).alias("_key"), F.col("part").alias("_part"), F.sum("n").over(before).alias("_before"))
    offsets = F.broadcast(scratch.save(offsets.where("_before is not null")))
    placed = saved.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    return placed.select(*names, (F.col("local") + F.coalesce("_before", F.lit(0))).alias("at"))


def scan(
    pieces: DataFrame,
    key: str,
    seed: bytes,
    join: Callable[[list[bytes]], bytes],
    step: Callable[[bytes, bytes], bytes],
    scratch: Scratch,
    backwards: bool = False,
) -> DataFrame:
    """``key, k, carry`` for each row of ``pieces(key, k, value)``, whose ``k`` are dense from 0.

    ``carry`` is ``seed`` for the first piece of a key (the last, if
    ``backwards``), and ``step(carry, value)`` of the piece before for others.
    ``FAN`` pieces are joined to one of the next level until a key has one left;
    carries then go down again. So a task never holds more than ``FAN`` values.
    """
    kind = dict(pieces.dtypes)[key]
    grouped = pieces.groupBy(key, F.expr(f"k div {FAN}").alias("up")).agg(
        F.array_sort(F.collect_list(F.struct("k", "value"))).alias("pieces")
    )
    grouped = scratch.save(grouped)
    top = grouped.agg(F.max("up")).first()[0]
    if not top:
        carried = grouped.select(key, "pieces", F.lit(seed).alias("carry"))
    else:

        def joined(batches):
            for batch in batches:
                values = [join([p["value"] for p in row]) for row in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values, pa.binary())], names=[key, "k", "value"])

        upper = grouped.select(key, "up", "pieces").mapInArrow(joined, f"`{key}` {kind}, k long, value binary")
        above = scan(upper, key, seed, join, step, scratch, backwards)
        above = above.select(F.col(key).alias("_key"), F.col("k").alias("_k"), "carry")
        carried = grouped.join(above, F.col(key).eqNullSafe(F.col("_key")) & (F.col("up") == F.col("_k")))

    def walked(batches):
        for batch in batches:
            keys, places, carries = [], [], []
            for who, row, carry in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for piece in reversed(row) if backwards else row:
                    keys.append(who)
                    places.append(piece["k"])
                    carries.append(carry)
                    carry = step(carry, piece["value"])
            arrays = [pa.array(keys, batch.schema.field(0).type), pa.array(places, pa.int64()), pa.array(carries, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "k", "carry"])

    out = carried.select(key, "pieces", "carry").mapInArrow(walked, f"`{key}` {kind}, k long, carry binary")
    return scratch.save(out)


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined to the ``table`` with one row a key; ``count`` is a column of
    the table that is at least the number of rows of its key. Keys of many rows
    don't go through the shuffle."""
    keyed = table.drop(count)
    often = F.broadcast(table.where(F.col(count) > HEAVY).drop(count))
    rest = table.where(F.col(count) <= HEAVY).drop(count)
    found = rows.join(often, keys).unionByName(rows.join(often, keys, "left_anti").join(rest, keys))
    return found.select(*rows.columns, *[c for c in keyed.columns if c not in keys])


def sorted_digests(rows: DataFrame, keys: list[str], order: list[str], value: str, between: str) -> DataFrame:
    """``keys, digest`` with the lowercase SHA-256 of the values of each key, in order
    and with ``between`` between them. A digest is made in one task, as rows
    stream by; rows are not collected."""
    kinds = dict(rows.dtypes)
    sorted_rows = rows.select(*keys, *order, value).repartition(*keys).sortWithinPartitions(*keys, *order)
    n = len(keys)

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns[:n]]
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for key, part in groupby(zip(zip(*columns, strict=True), texts, strict=True), key=lambda x: x[0]):
                text = between.join(t for _, t in part)
                if key == now:
                    text = between + text
                else:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(text.encode())
            yield _batch(done, batch.schema)
        if state is not None:
            yield _batch([(*now, state.hexdigest())], batch.schema)

    def _batch(done, schema):
        arrays = [pa.array([row[i] for row in done], schema.field(i).type) for i in range(n)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([row[n] for row in done], pa.string())], names=[*keys, "digest"])

    return sorted_rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", digest string")
