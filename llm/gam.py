"""Text quality by an additive model of lookup tables.

A text is described by a few statistics, each cut into bins. The model is a sum
of one table for each statistic and one for each of some pairs of them, passed
through the logistic function. Tables are learned by cyclic boosting: in turn,
each takes a small step along the shallow tree over its bins that best fits what
the others leave over. Pairs are chosen after the single tables are learned, by
what a tree over two statistics would still gain. Scoring looks up bins and adds.

The model is fitted on the driver over at most ``SAMPLE_ROWS`` labelled rows of
each label, weighted to the counts of all labelled rows; texts are measured and
scored in the tasks, all of them and whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.scratch import small_batches
from llm.words import BLANK_SEPARATED, Block, blocks, window_hashes, window_starts

# Labelled rows of each label that the model is fitted on, chosen by a hash of their id.
SAMPLE_ROWS = 10_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE, RIDGE = 0.1, 5.0
# Cuts of a tree over one statistic.
CUTS = 3

FEATURES = [
    "words", "word_length", "symbols", "sentence_marks", "other_marks", "capitals", "digits", "shouts", "lines",
    "line_words", "distinct", "commonest", "doubled", "repeated_windows", "repeated_lines",
]


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode())] = True
    return table


_KINDS = {
    "symbols": _table("#*$%&|<>"),
    "sentence_marks": _table(".,;:?"),
    "other_marks": _table("\"'()[]{}/\\+-=_^~`@"),
    "capitals": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _table("0123456789"),
    "shouts": _table("!"),
}


def _per_text(block: Block, where: np.ndarray) -> np.ndarray:
    """How many of the bytes marked in ``where`` each text has."""
    return np.diff(np.concatenate([[0], np.cumsum(where)])[block.text_at]).astype(np.float64)


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its distinct hashes, its most frequent one's count, and how many belong to repeated ones."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(o)]]))
    who = o[at]
    most = np.zeros(n)
    np.maximum.at(most, who, count)
    return np.bincount(who, minlength=n), most, np.bincount(who, weights=count * (count > 1), minlength=n)


def _measure(block: Block) -> np.ndarray:
    n = block.texts()
    words, owner, hashes = block.counts().astype(np.float64), block.owner(), block.hashes()
    size = np.maximum(_per_text(block, BLANK_SEPARATED[block.data]), 1)
    out = {"words": np.log1p(words), "word_length": size / np.maximum(words, 1)}
    for name, table in _KINDS.items():
        out[name] = _per_text(block, table[block.data]) / size
    some = np.maximum(words, 1)
    distinct, most, _ = _repeats(owner, hashes, n)
    out["distinct"], out["commonest"] = distinct / some, most / some
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out["doubled"] = np.bincount(owner, weights=same, minlength=n) / some
    good = window_starts(block.at, 3)
    _, _, again = _repeats(owner[: len(good)][good], window_hashes(hashes, 3)[good], n)
    out["repeated_windows"] = again / some
    # lines: words between line ends, named by the sum of their hashes and places
    breaks = np.concatenate([[0], np.cumsum(block.data == 10)])
    line = breaks[block.start]
    first = np.ones(len(line), dtype=bool)
    first[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(first)
    place = np.arange(len(line)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(line)]])))
    mixed = hashes * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    named = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, dtype=np.uint64)
    lines = np.bincount(owner[starts], minlength=n)
    distinct, _, _ = _repeats(owner[starts], named, n)
    out["lines"] = np.log1p(lines)
    out["line_words"] = words / np.maximum(lines, 1)
    out["repeated_lines"] = 1 - distinct / np.maximum(lines, 1)
    out["repeated_lines"][lines == 0] = 0
    return np.stack([out[name] for name in FEATURES], axis=1)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text; null and empty texts have none but zeros."""
    parts = [_measure(block) for block in blocks(column, BLANK_SEPARATED)]
    found = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
    found[found[:, 0] == 0] = 0
    return found


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def bin_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders between bins of about as many rows each; equal values share a bin."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def tree_step(g: np.ndarray, h: np.ndarray, cuts: int = CUTS) -> np.ndarray:
    """The values of a tree with at most ``cuts`` cuts over bins with sums ``g`` of
    gradients and ``h`` of curvatures, cut greedily."""
    g_sum, h_sum = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        mid = np.arange(a + 1, b)
        left = _gain(g_sum[mid] - g_sum[a], h_sum[mid] - h_sum[a])
        right = _gain(g_sum[b] - g_sum[mid], h_sum[b] - h_sum[mid])
        gain = left + right - _gain(g_sum[b] - g_sum[a], h_sum[b] - h_sum[a])
        k = int(gain.argmax())
        return float(gain[k]), int(mid[k])

    parts = [(0, len(g))]
    for _ in range(cuts):
        found = [(*best(a, b), a, b) for a, b in parts]
        gain, mid, a, b = max(found)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, mid), (mid, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = (g_sum[b] - g_sum[a]) / (h_sum[b] - h_sum[a] + RIDGE)
    return step


def pair_step(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of each of two statistics into four quadrants, and its gain."""
    g_sum, h_sum = (np.pad(s.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for s in (g, h))
    a, b = g.shape
    corner = [s[1:a, 1:b] for s in (g_sum, h_sum)]
    top = [s[1:a, -1:] for s in (g_sum, h_sum)]
    left = [s[-1:, 1:b] for s in (g_sum, h_sum)]
    whole = [s[-1, -1] for s in (g_sum, h_sum)]
    quadrants = [
        corner,
        [t - c for t, c in zip(top, corner, strict=True)],
        [f - c for f, c in zip(left, corner, strict=True)],
        [w - t - f + c for w, t, f, c in zip(whole, top, left, corner, strict=True)],
    ]
    step = np.zeros_like(g)
    if a < 2 or b < 2:
        return step, 0.0
    gain = sum(_gain(*q) for q in quadrants) - _gain(*whole)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [q[0][i, j] / (q[1][i, j] + RIDGE) for q in quadrants]
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return step, float(gain[i, j])


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Boosted tables for labels ``y`` of 0 and 1. Without both labels the model is
    their smoothed share."""
    ones, total = float(weight[y == 1].sum()), float(weight.sum())
    share = (ones + 1) / (total + 2)
    base = float(np.log(share / (1 - share)))
    features = x.shape[1]
    if len(np.unique(y)) < 2:
        return Model(base, [np.zeros(0)] * features, [np.zeros(1)] * features)
    edges = [bin_edges(x[:, j], BINS) for j in range(features)]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(x), base)

    def left_over() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            g, h = left_over()
            step = RATE * tree_step(*(np.bincount(at[j], weights=v, minlength=len(table)) for v in (g, h)))
            table += step
            total += step[at[j]]
    pair_edges = [bin_edges(x[:, j], PAIR_BINS) for j in range(features)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]

    def sums(pair: tuple[int, int]) -> list[np.ndarray]:
        i, j = pair
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        flat = coarse[i] * shape[1] + coarse[j]
        return [np.bincount(flat, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in left_over()]

    ranked = sorted(((-pair_step(*sums(pair))[1], pair) for pair in combinations(range(features), 2)))
    pairs = [pair for gain, pair in ranked[:PAIRS] if gain < 0]
    pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for pair, table in zip(pairs, pair_tables, strict=True):
            step = RATE * pair_step(*sums(pair))[0]
            table += step
            total += step[coarse[pair[0]], coarse[pair[1]]]
    return Model(base, edges, tables, pairs, pair_edges, pair_tables)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = statistics(batch.column(1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels(doc_id, quality)`` from the texts of ``docs(doc_id, text)``.

    Only labels 0 and 1 count; of several for one ``doc_id`` the larger. Rows
    without ``doc_id`` teach nothing, and of several texts of one ``doc_id`` that
    with the smallest statistics counts. At most ``SAMPLE_ROWS`` rows a label are
    used, those with the smallest hash of their id.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("quality").cast("int").alias("quality"))
    counts = {row["quality"]: row["count"] for row in known.groupBy("quality").count().collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    found = texts.mapInArrow(_measured, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = found.join(chosen, "doc_id").orderBy("doc_id").select("x", "quality").toArrow()
    y = rows["quality"].to_numpy().astype(np.float64)
    x = np.array(rows["x"].to_pylist(), dtype=np.float64).reshape(len(y), len(FEATURES))
    weight = np.ones(len(y))
    for label in (0, 1):
        here = y == label
        if here.any():
            weight[here] = counts[label] / here.sum()
    # as if the sample were the whole, so that the ridge weighs alike at every size
    return train(x, y, weight * (len(y) / max(weight.sum(), 1)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``docs(doc_id, text)``, from 0 to 1, higher where
    label 1 is likelier.

    Null, empty and blank texts have the statistics of an empty text. Rows with one
    ``doc_id`` are scored each, rows without one too. Other columns are ignored;
    an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(model.score(statistics(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
