"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles of a document yields two signature values, its
smallest and its largest image, so a signature takes half the hash evaluations
of plain minimum hashing. Values of the same kind under different permutations
form a band; documents that share a band are candidates.

Rows with one shingle set are one class, kept once. Inside a shared band the
first class is compared with every other one. A second pass compares what then
is still in different components, tile by tile, each pair in the first band it
shares. Rows with a partner whose signature agrees stay; their full shingle sets
are compared in the task, which hands on a spanning forest of confirmed links and
never pairs. So every two classes that share a band are either compared or
already connected, no task holds more than two tiles, and the rows that leave the
tasks grow with the rows of a group, not with its pairs. Candidates whose
signatures agree in few places go; all others are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.components import components
from llm.scratch import Scratch, small
from llm.words import BLANK_SEPARATED, blocks, mix, window_hashes, window_starts

SHINGLE = 5
# 64 bands of 6 values find a pair of similarity 0.75 with probability 1 - 4e-6.
BAND_ROWS = 6
BANDS_OF_A_KIND = 32
PERMUTATIONS = BAND_ROWS * BANDS_OF_A_KIND
SIGNATURE = 2 * PERMUTATIONS
# A pair is confirmed if one byte of each signature value agrees as often as the
# threshold less this, four and a half standard deviations of 384 values. A first look
# at some of the bytes has a slack of six.
SLACK = 0.1
FIRST_LOOK = 64
FIRST_SLACK = 0.33
# Rows of a shared band compared at once, and about how many shingles they have.
TILE = 1024
TILE_SHINGLES = 1 << 22

_random = np.random.default_rng(971)
_FACTOR = _random.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, f1 long, f2 long, checks binary, bands array<long>"


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of some texts at a time: the first text, all
    hashes, and where those of each text begin and end."""
    for block in blocks(column, BLANK_SEPARATED):
        words = block.hashes(lower=True)
        n = block.counts()
        found = window_hashes(words, size)
        good = window_starts(block.at, size)
        owner = block.owner()[: len(found)][good]
        found = found[good]
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            whole = [window_hashes(words[block.at[i] : block.at[i + 1]], int(n[i])) for i in short]
            found = np.concatenate([found, *whole])
            owner = np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            found, owner = found[order], owner[order]
        at = np.searchsorted(owner, np.arange(block.texts() + 1))
        for i in np.flatnonzero(np.diff(at) > 1):
            found[at[i] : at[i + 1]].sort()
        fresh = np.ones(len(found), dtype=bool)
        fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        yield block.first, found[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def minmax(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest image of each non-empty set under each permutation."""
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.empty((PERMUTATIONS, len(at)), dtype=np.uint32)
    high = np.empty_like(low)
    for k in range(PERMUTATIONS):
        image = values * _FACTOR[k] + _SHIFT[k]
        low[k] = np.minimum.reduceat(image, at)
        high[k] = np.maximum.reduceat(image, at)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One row of band keys per set."""
    keys = []
    for kind, values in enumerate((low, high)):
        grouped = values.reshape(BANDS_OF_A_KIND, BAND_ROWS, -1).astype(np.uint64)
        number = np.arange(BANDS_OF_A_KIND, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(kind)
        key = np.broadcast_to(mix(number), grouped[:, 0].shape)
        for i in range(BAND_ROWS):
            key = mix(key ^ grouped[:, i] + np.uint64(i + 1))
        keys.append(key)
    return np.ascontiguousarray(np.concatenate(keys).T)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
         ("checks", pa.binary()), ("bands", pa.list_(pa.int64()))]
    )
    for batch in batches:
        ids = batch.column(0)
        for first, hashes, at in shingle_sets(batch.column(1)):
            n = np.diff(at)
            filled = np.flatnonzero(n)
            f1, f2 = np.zeros((2, len(n)), dtype=np.uint64)
            checks: list[bytes | None] = [None] * len(n)
            places, bands = np.zeros(len(n) + 1, dtype=np.int32), np.zeros(0, dtype=np.int64)
            if len(filled):
                begin = at[:-1][filled]
                f1[filled] = np.add.reduceat(mix(hashes), begin)
                f2[filled] = np.add.reduceat(mix(hashes ^ np.uint64(0x5555555555555555)), begin)
                low, high = minmax(hashes, begin)
                lowest = np.ascontiguousarray(np.concatenate([low, high]).astype(np.uint8).T)
                for i, row in zip(filled, lowest, strict=True):
                    checks[i] = row.tobytes()
                keys = band_keys(low, high)
                bands = keys.view(np.int64).ravel()
                places[filled + 1] = keys.shape[1]
                places = np.cumsum(places, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(n)).cast(pa.int64()),
                    pa.array(n.astype(np.int64)),
                    pa.array(f1.view(np.int64)),
                    pa.array(f2.view(np.int64)),
                    pa.array(checks, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(places), pa.array(bands)),
                ],
                schema=schema,
            )


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set fingerprint and min-max signature of each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signatures, SIGNATURE_SCHEMA)


def _bytes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), SIGNATURE)


def _similarity(share: np.ndarray) -> np.ndarray:
    """Two different signature values share a byte once in 256 times."""
    return (share - 1 / 256) / (1 - 1 / 256)


def _agree(threshold: float):
    """Keeps pairs whose signature bytes agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = (_bytes_of(batch.column(2)) == _bytes_of(batch.column(3))).mean(axis=1)
            yield batch.select([0, 1]).filter(pa.array(_similarity(share) >= threshold - SLACK))

    return run


def _keys_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _likely(rows: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different components whose signatures agree, and that
    share no band before this one: each pair is looked at in one band."""
    band, low, high = (rows[c][0].as_py() for c in ("band", "low", "high"))
    tile, component = (rows[c].to_numpy() for c in ("tile", "component"))
    signs, keys = _bytes_of(rows["checks"].combine_chunks()), _keys_of(rows["bands"].combine_chunks())
    ones, twos = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    found_a, found_b = [], []
    for begin in range(0, len(ones), 64):
        some = ones[begin : begin + 64]
        share = (signs[some, None, :FIRST_LOOK] == signs[None, twos, :FIRST_LOOK]).mean(axis=2)
        good = (_similarity(share) >= threshold - FIRST_SLACK) & (component[some, None] != component[None, twos])
        if low == high:
            good &= some[:, None] < twos[None, :]
        i, j = np.nonzero(good)
        for part in range(0, len(i), 4096):
            a, b = some[i[part : part + 4096]], twos[j[part : part + 4096]]
            keep = _similarity((signs[a] == signs[b]).mean(axis=1)) >= threshold - SLACK
            a, b = a[keep], b[keep]
            shared = keys[a] == keys[b]
            first = keys[a, shared.argmax(axis=1)] == band
            found_a.append(a[first])
            found_b.append(b[first])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each band and pair of tiles; rows are sorted by these."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        keys = np.stack([rows[c].to_numpy() for c in ("band", "low", "high")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
            yield rows.slice(a, b - a)
        rest = rows.slice(int(cuts[-1]) if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _with_partner(threshold: float):
    """Keeps the rows that have a likely partner among those of their band and tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            a, b = _likely(rows, threshold)
            if len(a):
                yield from rows.take(pa.array(np.union1d(a, b))).combine_chunks().to_batches()

    return run


def _forest(percent: int):
    """Confirmed links that join components: a spanning forest of those between the
    rows of one band and pair of tiles, found by comparing whole sets. Each group
    has rows with signatures (``text`` is null) and rows with texts. At most one
    link fewer than there are nodes leaves the task."""
    threshold = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _bodies(batches):
            links = _joined(rows, sets, *_likely(rows, threshold), percent)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, dict[int, list[np.ndarray]]]]:
    """The signature rows of each group, and the shingle sets of its nodes. Texts are
    turned into sets batch by batch and not kept."""

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        keys = np.stack([batch.column(c).to_numpy() for c in ("band", "low", "high")])
        at = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for low, high in zip(at, at[1:], strict=False):
            yield tuple(keys[:, low]), batch.slice(int(low), int(high - low))

    for _, parts in groupby((x for batch in batches if batch.num_rows for x in cut(batch)), key=lambda x: x[0]):
        signed, sets = [], {}
        for _, part in parts:
            bare = part.column("text").is_null()
            signed.append(part.filter(bare).drop_columns(["text"]))
            full = part.filter(pa.compute.invert(bare))
            nodes = full.column("node").to_pylist()
            for first, hashes, at in shingle_sets(full.column("text")):
                for i, (low, high) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    sets.setdefault(nodes[first + i], []).append(hashes[low:high].copy())
        yield pa.Table.from_batches(signed), sets


def _joined(rows: pa.Table, sets: dict, ones: np.ndarray, twos: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the nodes at two lists of places that join components. A set is
    compared at once with those of all its partners that are still elsewhere."""
    nodes, components = rows["node"].to_numpy(), rows["component"].to_numpy()
    parent = {int(c): int(c) for c in components}

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links = []
    order = np.argsort(ones, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(ones[order]) != 0]) if len(order) else []
    for low, high in zip(starts, [*starts[1:], len(order)], strict=True):
        a = int(ones[order[low]])
        partners = [int(b) for b in twos[order[low:high]]]
        partners = [b for b in partners if top(int(components[a])) != top(int(components[b]))]
        for one in sets.get(int(nodes[a]), []):
            others = [(b, two) for b in partners for two in sets.get(int(nodes[b]), []) if len(one) and len(two)]
            for part in range(0, len(others), 256):
                some = others[part : part + 256]
                sizes = np.array([len(two) for _, two in some])
                every = np.concatenate([two for _, two in some])
                at = np.minimum(np.searchsorted(one, every), len(one) - 1)
                both = np.add.reduceat(one[at] == every, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
                near = 100 * both >= percent * (len(one) + sizes - both)
                for (b, _), yes in zip(some, near, strict=True):
                    x, y = top(int(components[a])), top(int(components[b]))
                    if yes and x != y:
                        parent[max(x, y)] = min(x, y)
                        links.append((int(min(nodes[a], nodes[b])), int(max(nodes[a], nodes[b]))))
    return links


def _confirm(percent: int):
    """Keeps pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for i in (2, 3):
                # the same text often follows itself
                packed = batch.column(i).dictionary_encode()
                sets = []
                for _, hashes, at in shingle_sets(packed.dictionary):
                    sets += [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                sides.append((packed.indices.to_numpy(), sets))
            keep = []
            for i, j in zip(sides[0][0], sides[1][0], strict=True):
                one, two = sides[0][1][i], sides[1][1][j]
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Texts are linked if the sets of their five-word shingles (ASCII letters
    lower-cased) have ``100 * intersection >= percent * union``; a text of
    fewer words is one shingle, one without words or a null text has none and
    is linked with nothing. ``component_id`` is the smallest ``doc_id`` that
    links reach, and the row with that id is ``kept``.

    Rows that share a ``doc_id`` are one node, linked if any of their texts is.
    A row without ``doc_id`` is linked with nothing, has no component and is
    kept. Other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    sig = scratch.save(signatures(docs))
    named = sig.where("doc_id is not null and n_shingles > 0")
    classes = scratch.save(
        named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"))
    )
    firsts = named.join(
        classes.select("f1", "f2", "n_shingles", F.col("node").alias("doc_id")), ["f1", "f2", "n_shingles", "doc_id"]
    ).select(F.col("doc_id").alias("node"), "n_shingles", "checks", "bands")
    firsts = scratch.save(firsts.dropDuplicates(["node", "checks"]))
    bands = firsts.select("node", F.explode("bands").alias("band"))
    shared = scratch.save(
        bands.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
        .select("band", "leader")
    )
    members = scratch.save(bands.join(shared, "band"))
    checks = firsts.select("node", "checks")
    texts = _texts_of(docs, members, scratch)
    pair = "a long, b long"

    def confirmed(likely: DataFrame) -> DataFrame:
        one = texts.select(F.col("node").alias("a"), F.col("text").alias("t1"))
        two = texts.select(F.col("node").alias("b"), F.col("text").alias("t2"))
        full = likely.join(two, "b").join(one, "a").select("a", "b", "t1", "t2")
        return scratch.save(full.mapInArrow(_confirm(percent), pair).distinct())

    stars = members.where("leader < node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    one = checks.select(F.col("node").alias("a"), F.col("checks").alias("c1"))
    two = checks.select(F.col("node").alias("b"), F.col("checks").alias("c2"))
    likely = stars.join(two, "b").join(one, "a").select("a", "b", "c1", "c2")
    likely = scratch.save(likely.mapInArrow(_agree(percent / 100), pair).distinct())
    links = confirmed(likely)
    found = scratch.save(components(links, scratch))

    placed = members.join(found, "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("component")
    )
    # bands that still hold several components, in tiles bounded by rows and by shingles
    weights = placed.join(scratch.save(firsts.groupBy("node").agg(F.max("n_shingles").alias("weight"))), "node")
    split = weights.groupBy("band").agg(
        F.min("component").alias("x"), F.max("component").alias("y"),
        F.ceil(F.greatest(F.count("*") / TILE, F.sum("weight") / TILE_SHINGLES)).alias("tiles"),
    )
    tiled = placed.join(scratch.save(split.where("x < y").select("band", "tiles")), "band")
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))).join(firsts.select("node", "checks", "bands"), "node")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    tiled = tiled.select("*", other).select(
        "band", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        "tile", "node", "component", "checks", "bands",
    )
    group = ["band", "low", "high"]
    tiled = tiled.repartition(*group).sortWithinPartitions(*group)
    paired = scratch.save(tiled.mapInArrow(_with_partner(percent / 100), tiled.schema))
    bodies = paired.select(*group, "node").distinct().join(texts, "node").select(*group, "node", "text")
    both = paired.withColumn("text", F.lit(None).cast("string")).unionByName(bodies, allowMissingColumns=True)
    both = both.repartition(*group).sortWithinPartitions(*group)
    links = links.union(scratch.save(both.mapInArrow(_forest(percent), pair).distinct()))
    found = scratch.save(components(links, scratch))
    classes = scratch.save(
        classes.join(found, "node", "left").select(
            "f1", "f2", "n_shingles", F.coalesce("component", "node").alias("component_id")
        )
    )
    rows = sig.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"], "left")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _texts_of(docs: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """The texts of all nodes that share a band with another, each text once."""
    wanted = scratch.save(members.select(F.col("node").alias("doc_id")).distinct())
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    texts = rows.join(small(wanted, 40), "doc_id").select(F.col("doc_id").alias("node"), "text")
    return scratch.save(texts)
