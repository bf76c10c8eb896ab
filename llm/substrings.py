"""Removal of repeated word sequences by level-wise doubling.

Windows of half the length are compared first; only where they are found in
several texts are they extended to twice their length and compared again.
Of all half windows inside a full one, only the one with the smallest hash is
compared: equal full windows hold equal half windows and so choose the same
one, and a repeated full window therefore always holds a repeated chosen half.
That leaves one half window in thirteen to shuffle, and nothing is missed.

Whole copies of a text are found first, by their hash. They bring nothing that
the first copy doesn't bring, so their windows aren't extended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.scratch import Scratch, quoted, struct_ddl
from llm.words import BLANK_SEPARATED, Block, blocks, window_hashes, window_starts

WINDOW = 50
# A row without an id comes after all others.
NO_ID = (1 << 63) - 1


def choose(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` hashes the place of the smallest, the first of equals."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    place, width = np.arange(len(hashes)), 1
    while width < span:
        step = min(width, span - width)
        one, two = place[: len(place) - step], place[step:]
        place = np.where(hashes[one] <= hashes[two], one, two)
        width += step
    return place[:n]


def _halves(block: Block, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-window hashes of a block; the starts of its full windows; the chosen half of each."""
    half = window // 2
    hashes = window_hashes(words, half)
    starts = np.flatnonzero(window_starts(block.at, window))
    return hashes, starts, choose(hashes, window - half + 1)[starts]


def _chosen(window: int):
    """``(half, k, c)``: the chosen half windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, classes = (batch.column(i).to_numpy() for i in (1, 2))
            for block in blocks(batch.column(0), BLANK_SEPARATED):
                hashes, _, place = _halves(block, block.hashes(), window)
                place = np.unique(place)
                text = block.owner()[place] + block.first
                found = [hashes[place].view(np.int64), keys[text], classes[text]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["half", "k", "c"])

    return run


def _listed(column: pa.Array, i: int) -> np.ndarray:
    value = column[i].values
    return np.zeros(0, np.uint64) if value is None else value.to_numpy().view(np.uint64)


def _extend(window: int):
    """``(full, k, id)``: the full windows around repeated chosen halves, each
    hash once for a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = (batch.column(i).to_numpy() for i in (1, 2))
            for block in blocks(batch.column(0), BLANK_SEPARATED):
                words = block.hashes()
                hashes, starts, place = _halves(block, words, window)
                full = window_hashes(words, window)
                at = np.searchsorted(starts, block.at)
                for i in range(block.texts()):
                    own = slice(at[i], at[i + 1])
                    repeated = np.isin(hashes[place[own]], _listed(batch.column(3), block.first + i))
                    found = np.unique(full[starts[own][repeated]]).view(np.int64)
                    if len(found):
                        row = np.full(len(found), block.first + i)
                        columns = [found, keys[row], ids[row]]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["full", "k", "id"])

    return run


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_RESULT = "n_words long, n_removed long, kept string, kept_sha256 string"


def _result(n: list, removed: list, kept: list, texts: pa.Array, with_text: bool) -> list[pa.Array]:
    shown = [None] * len(n)
    if with_text:
        shown = [
            None if k is None else k.decode() if gone else text
            for k, gone, text in zip(kept, removed, texts.to_pylist(), strict=True)
        ]
    digest = [None if k is None else _digest(k) for k in kept]
    whole = [pa.array(x, pa.int64()) for x in (n, removed)]
    return [*whole, pa.array(shown, pa.string()), pa.array(digest, pa.string())]


def _first_look(window: int, with_text: bool):
    """Settles copies and texts without a repeated half; the others keep their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, ids, c, text, halves, copies = batch.columns
            n, removed, kept, left, rest = [], [], [], [], []
            for i in range(batch.num_rows):
                words = (text[i].as_py() or "").encode().split()
                copy = copies[i].values is not None and c[i] in copies[i].values
                is_open = not copy and halves[i].values is not None and len(words) >= window
                gone = len(words) if copy and len(words) >= window else 0
                n.append(len(words))
                removed.append(None if is_open else gone)
                kept.append(None if is_open else b"" if gone else b" ".join(words))
                left.append(text[i].as_py() if is_open else None)
                rest.append(halves[i].as_py() if is_open else None)
            yield pa.RecordBatch.from_arrays(
                [doc, key, ids, *_result(n, removed, kept, text, with_text),
                 pa.array(left, pa.string()), pa.array(rest, pa.list_(pa.int64()))],
                names=["row", "k", "id", "n_words", "n_removed", "kept", "kept_sha256", "text", "halves"],
            )

    return run


def _second_look(window: int, with_text: bool):
    """Removes the words under windows that were found in an earlier document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, found = batch.columns
            n, removed, kept = [], [], []
            for block in blocks(text, BLANK_SEPARATED):
                full = window_hashes(block.hashes(), window)
                for i in range(block.texts()):
                    a, b = int(block.at[i]), int(block.at[i + 1])
                    words = block.data[block.text_at[i] : block.text_at[i + 1]].tobytes().split()
                    own = full[a : max(a, b - window + 1)]
                    hit = np.isin(own, _listed(found, block.first + i))
                    edge = np.zeros(b - a + 1, dtype=np.int64)
                    edge[: len(hit)] += hit
                    edge[window : window + len(hit)] -= hit
                    covered = np.cumsum(edge)[:-1] > 0
                    n.append(b - a)
                    removed.append(int(covered.sum()))
                    kept.append(b" ".join(compress(words, ~covered)))
            yield pa.RecordBatch.from_arrays(
                [doc, *_result(n, removed, kept, text, with_text)],
                names=["row", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, carry: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` for each row of ``docs(doc_id, text)``.

    A word goes if a run of ``window`` words over it also starts in a row with
    a smaller ``doc_id``; runs are judged on the input. ``kept`` is the text if
    nothing goes, else the other words joined by one space (null unless
    ``with_text``); ``kept_sha256`` is the digest of the joined words either way.

    A null or blank text has no words. A row without ``doc_id`` counts as later
    than all others; rows with one id don't remove from each other. Other
    columns are ignored, but with ``carry`` all input columns except the text
    come along as ``row``. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    if window < 2:
        raise ValueError("a window has two words at least")
    text = F.col("text")
    columns = [F.col(quoted(c)) for c in docs.columns if c.lower() != "text"] if carry else [F.col("doc_id").cast("long").alias("doc_id")]
    rows = docs.select(
        F.struct(*columns).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("k"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("c"),
        text,
    )
    # whole copies: two hashes of 64 bits with different beginnings
    whole = rows.where("text is not null").select("k", "id", "c", F.xxhash64(F.lit(1), text).alias("d"))
    whole = scratch.save(whole)
    first = whole.groupBy("c", "d").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = whole.join(scratch.save(first), ["c", "d"]).where("id > first").select("k", "c")

    chosen = rows.select("text", "k", "c").mapInArrow(_chosen(window), "half long, k long, c long")
    chosen = scratch.save(chosen)
    repeated = chosen.groupBy("half").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("half")
    open_ = chosen.join(scratch.save(repeated), "half").select("k", "half", F.lit(None).cast("long").alias("copy"))
    told = open_.unionByName(copies.select("k", F.lit(None).cast("long").alias("half"), F.col("c").alias("copy")))
    told = told.groupBy("k").agg(F.collect_set("half").alias("halves"), F.collect_set("copy").alias("copies"))
    none = F.lit(None).cast("array<long>")
    told = told.select(
        "k",
        F.when(F.size("halves") > 0, F.col("halves")).otherwise(none).alias("halves"),
        F.when(F.size("copies") > 0, F.col("copies")).otherwise(none).alias("copies"),
    )
    row = struct_ddl(rows, "row")
    looked = rows.join(told, "k", "left").select("row", "k", "id", "c", "text", "halves", "copies")
    looked = scratch.save(
        looked.mapInArrow(
            _first_look(window, with_text), f"{row}, k long, id long, {_RESULT}, text string, halves array<long>"
        )
    )

    still = looked.where("text is not null")
    wide = still.select("text", "k", "id", "halves").mapInArrow(_extend(window), "full long, k long, id long")
    wide = scratch.save(wide)
    first = wide.groupBy("full").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    found = wide.join(scratch.save(first.select("full", "first")), "full").where("id > first")
    found = found.groupBy("k").agg(F.collect_set("full").alias("found"))
    settled = looked.where("text is null").select("row", "n_words", "n_removed", "kept", "kept_sha256")
    rest = still.join(found, "k", "left").select("row", "text", "found")
    made = settled.unionByName(rest.mapInArrow(_second_look(window, with_text), f"{row}, {_RESULT}"))
    made = made.select(F.col("row")["doc_id"].cast("long").alias("doc_id"), "*")
    return made if carry else made.drop("row")
