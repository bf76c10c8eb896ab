"""Benchmark passages in documents: a set join with prefix filter.

A window of an item counts as the set of its word shingles, and a document
contains the window only if it contains all of them. With the shingles of each
window ordered by rarity in the whole corpus, one is enough as the necessary
prefix: the rarest. A document is looked up by these alone. The place of the
shingle in the window and the length of the text bound where the window could
lie, and each such place is verified word by word.

Windows are a query set: they go to the tasks in blocks of bounded size, each
against all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.scratch import Scratch, quoted, struct_ddl
from llm.words import ALPHANUMERIC, blocks, window_hashes

WINDOW = 10
SHINGLE = 3
# Distinct windows in the hands of a task at once, about 120 bytes each.
BLOCK_WINDOWS = 100_000
_SIEVE_BITS = 22


def _windows(window: int):
    """``(item, words)``: the word hashes of each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), ALPHANUMERIC):
                words = block.hashes(lower=True)
                items, found = [], []
                for i in range(block.texts()):
                    own = words[block.at[i] : block.at[i + 1]]
                    size = min(window, len(own))
                    for start in range(len(own) - size + 1 if size else 0):
                        items.append(batch.column(0)[block.first + i].as_py())
                        found.append(own[start : start + size].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.string()), pa.array(found, pa.binary())], names=["item", "words"]
                )

    return run


class Sieve:
    """Membership in a sorted set of hashes; a bit table sends most others away."""

    def __init__(self, members: np.ndarray) -> None:
        self.members = members
        self.seen = np.zeros(1 << _SIEVE_BITS, dtype=bool)
        self.seen[self._slot(members)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - _SIEVE_BITS)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of members, and which member each is."""
        if not len(self.members):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[self._slot(hashes)])
        which = np.searchsorted(self.members, hashes[at])
        which[which == len(self.members)] = 0
        good = self.members[which] == hashes[at]
        return at[good], which[good]


def _shingle_size(length: int) -> int:
    return min(SHINGLE, length)


@dataclass
class Windows:
    """Distinct windows of one block: word hashes padded to the same length, and
    the items that hold each."""

    words: np.ndarray
    length: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, rows: pa.Table, window: int) -> Windows:
        places: dict[bytes, int] = {}
        items: list[list[str]] = []
        for words, names in zip(rows["words"].to_pylist(), rows["items"].to_pylist(), strict=True):
            places[words] = len(items)
            items.append(names)
        words = np.zeros((len(places), window), dtype=np.uint64)
        length = np.zeros(len(places), dtype=np.int64)
        for raw, i in places.items():
            own = np.frombuffer(raw, dtype=np.uint64)
            words[i, : len(own)], length[i] = own, len(own)
        return cls(words, length, items)

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows: shingle, window, place in it."""
        parts = []
        for i in range(len(self.length)):
            own = window_hashes(self.words[i, : self.length[i]], _shingle_size(self.length[i]))
            parts.append((own, np.full(len(own), i), np.arange(len(own))))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def sizes(self) -> list[int]:
        return sorted({_shingle_size(int(n)) for n in self.length})


def _shingle_counts(sieve: Sieve, sizes: list[int]):
    """``(shingle, n)``: how often shingles of the windows occur in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sieve.members), dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), ALPHANUMERIC):
                words = block.hashes(lower=True)
                for size in sizes:
                    # a shingle over the edge of two texts would only make it look less rare
                    _, which = sieve.find(window_hashes(words, size))
                    total += np.bincount(which, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sieve.members[seen].view(np.int64)), pa.array(total[seen])], names=["shingle", "n"]
        )

    return run


def _prefixes(windows: Windows, counts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingle of each window, sorted, with its window and its place."""
    shingle, window, place = windows.shingles()
    known = counts["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    sieve = Sieve(known[order])
    often = np.zeros(len(shingle), dtype=np.int64)
    at, which = sieve.find(shingle)
    often[at] = counts["n"].to_numpy()[order][which]
    order = np.lexsort((place, shingle, often, window))
    first = order[np.unique(window[order], return_index=True)[1]]
    first = first[np.argsort(shingle[first], kind="stable")]
    return shingle[first], window[first], place[first]


_FOUND = "c long, d long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _find(windows: Windows, prefix: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """For each text the places of windows in it, and their items."""
    shingle, window, place = prefix
    members, begin = np.unique(shingle, return_index=True)
    bounds = np.append(begin, len(shingle))
    sieve, sizes = Sieve(members), windows.sizes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0).field("text"), ALPHANUMERIC):
                words = block.hashes(lower=True)
                found_start, found_window = [], []
                for size in sizes:
                    at, which = sieve.find(window_hashes(words, size))
                    if not len(at):
                        continue
                    # a shingle can be the prefix of several windows
                    several = bounds[which + 1] - bounds[which]
                    entry = np.repeat(bounds[which] - np.cumsum(several) + several, several) + np.arange(several.sum())
                    w = window[entry]
                    start = np.repeat(at, several) - place[entry]
                    text = np.searchsorted(block.at, np.repeat(at, several), side="right") - 1
                    fits = (start >= block.at[text]) & (start + windows.length[w] <= block.at[text + 1])
                    w, start = w[fits], start[fits]
                    inside = np.arange(windows.words.shape[1])
                    near = words[np.minimum(start[:, None] + inside, len(words) - 1)]
                    same = (near == windows.words[w]) | (inside >= windows.length[w][:, None])
                    whole = same.all(axis=1)
                    found_start.append(start[whole])
                    found_window.append(w[whole])
                starts = np.concatenate([np.zeros(0, np.int64), *found_start])
                wins = np.concatenate([np.zeros(0, np.int64), *found_window])
                order = np.argsort(starts, kind="stable")
                starts, wins = starts[order], wins[order]
                ends = starts + windows.length[wins]
                cut = np.searchsorted(starts, block.at)
                items = [
                    sorted({x for w in set(wins[a:b].tolist()) for x in windows.items[w]}) if b > a else []
                    for a, b in zip(cut[:-1], cut[1:], strict=True)
                ]
                shift = np.repeat(block.at[:-1], np.diff(cut))
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x - shift)) for x in (starts, ends)]
                own = [batch.column(i).slice(block.first, block.texts()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(block.counts()), *lists, pa.array(items, pa.list_(pa.string()))],
                    names=["row", "c", "d", "n_words", "starts", "ends", "items"],
                )

    return run


_RESULT = (
    "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, "
    "spans array<struct<start:long,end:long>>, contaminated boolean"
)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, hits, items, digests = [], [], [], []
        for starts, ends, names in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True):
            merged: list[dict[str, int]] = []
            for start, end in sorted(zip(starts, ends, strict=True)):
                if merged and start <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], end)
                else:
                    merged.append({"start": start, "end": end})
            names = sorted(set(names))
            spans.append(merged)
            hits.append(sum(x["end"] - x["start"] for x in merged))
            items.append(names)
            digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(map(len, items), pa.int64()),
             pa.array(items, pa.list_(pa.string())), pa.array(digests, pa.string()), pa.array(spans, pa.list_(span)),
             pa.array([n > 0 for n in hits], pa.bool_())],
            names=["row", "n_words", "n_hit", "n_items", "items", "items_sha256", "spans", "contaminated"],
        )


def _find_settled(windows: Windows, prefix: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Both steps in one Python worker, for windows that fit in one block. A second
    worker beside it would stay in the executor's pool, with all it remembers."""
    find = _find(windows, prefix)
    return lambda batches: _settle(find(batches))


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    carry: bool = False,
) -> DataFrame:
    """For each row of ``docs(doc_id, text)`` what it holds of ``benchmark(item_id, text)``:
    ``doc_id, n_words, n_hit, n_items, items, items_sha256, spans, contaminated``.

    Words are runs of digits, letters and non-ASCII characters, with A-Z
    lower-cased. A window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window. ``spans`` are the word ranges
    under windows, ``n_hit`` the words in them, ``items`` the ids (as sorted
    strings) of items with a window in the text.

    Null texts have no words and null items no windows. A window of an item
    without id hits, but its item isn't listed. Repeated documents each give
    their row. Other columns are ignored, but with ``carry`` the whole input row
    comes along as ``row``. An empty table on either side gives no rows or no hits.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "benchmark")
    text = F.col("text")
    columns = [F.col(quoted(c)) for c in docs.columns] if carry else [F.col("doc_id").cast("long").alias("doc_id"), text]
    rows = docs.select(
        F.struct(*columns).alias("row"), F.xxhash64(text).alias("c"), F.xxhash64(F.lit(1), text).alias("d")
    )
    row = struct_ddl(rows, "row")

    def result(settled: DataFrame) -> DataFrame:
        settled = settled.select(F.col("row")["doc_id"].cast("long").alias("doc_id"), "*")
        return settled if carry else settled.drop("row")

    found = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(_windows(window), "item string, words binary")
    found = scratch.save(found.groupBy("words").agg(F.collect_set("item").alias("items")))
    parts = max(1, -(-found.count() // block_windows))
    looked = None
    for part in range(parts):
        own = found.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part)
        windows = Windows.of(own.toArrow(), window)
        sieve = Sieve(np.unique(windows.shingles()[0]))
        counts = docs.select("text").mapInArrow(_shingle_counts(sieve, windows.sizes()), "shingle long, n long")
        prefix = _prefixes(windows, counts.groupBy("shingle").agg(F.sum("n").alias("n")).toArrow())
        if parts == 1:
            return result(rows.mapInArrow(_find_settled(windows, prefix), f"{row}, {_RESULT}"))
        one = rows.mapInArrow(_find(windows, prefix), f"{row}, {_FOUND}")
        looked = one if looked is None else looked.unionByName(one)
    gathered = looked.groupBy("row", "c", "d", "n_words").agg(
        *(F.flatten(F.collect_list(x)).alias(x) for x in ("starts", "ends")),
        F.flatten(F.collect_set("items")).alias("items"),
        (F.count("*") / parts).alias("rows"),
    )
    looked = gathered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    looked = looked.select("row", "n_words", "starts", "ends", "items")
    return result(looked.mapInArrow(_settle, f"{row}, {_RESULT}"))
