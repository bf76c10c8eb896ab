"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts a word from the words on both sides of it: embeddings of
the neighbours, one hidden layer, and a softmax in two steps (a class of words,
then the word in its class). It is trained in numpy on masked positions of the
whole corpus: in each round every task starts from the same weights, follows
the gradient over its own documents, and the results are averaged by the number
of positions seen. A document's score is the sum of the log-probabilities of
all of its words.

The network's vocabulary are the most frequent words of the corpus; all others share
buckets by their hash. The weights have a fixed size, so what is broadcast and
what a task sends don't grow with the corpus. Within its bucket a word has its share
of the bucket's occurrences, from the counts of all words of the corpus. These stay a
table, so every word has a probability of its own and they add up to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.scratch import Scratch, small
from llm.words import BLANK_SEPARATED, blocks, mix

FREQUENT, BUCKETS, CLASS = 960, 64, 32
WORDS = FREQUENT + BUCKETS
CLASSES = WORDS // CLASS
SIDE = 2  # neighbours on each side
WIDTH, HIDDEN = 16, 32
MASKED_PERCENT = 15
ROUNDS = 2
RATE = 0.1
_BATCH = 2048
# Averages are sums of integers, so they don't depend on the order of the tasks.
_UNIT = 1 << 24
_SHARE_UNIT = 1 << 32
_PAD = WORDS
_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
SHAPES = {
    "embed": (WORDS + 1, WIDTH),
    "mid": (len(_OFFSETS) * WIDTH, HIDDEN),
    "mid_bias": (HIDDEN,),
    "top": (HIDDEN, CLASSES),
    "top_bias": (CLASSES,),
    "leaf": (CLASSES, HIDDEN, CLASS),
    "leaf_bias": (CLASSES, CLASS),
}

Weights = dict[str, np.ndarray]


def fresh_weights() -> Weights:
    rng = np.random.default_rng(5)
    return {
        name: (rng.normal(0, 0.1, shape) if len(shape) > 1 and "bias" not in name else np.zeros(shape)).astype(np.float32)
        for name, shape in SHAPES.items()
    }


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in SHAPES])


def shaped(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = values[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _hidden(w: Weights, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inputs = w["embed"][context].reshape(len(context), -1)
    return inputs, np.tanh(inputs @ w["mid"] + w["mid_bias"])


def _by_class(kind: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of one class in sorted classes."""
    at = np.searchsorted(kind, np.arange(CLASSES + 1))
    for k in np.flatnonzero(np.diff(at)):
        yield int(k), slice(int(at[k]), int(at[k + 1]))


def log_probabilities(w: Weights, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Log-probability of each word given its neighbours."""
    order = np.argsort(word // CLASS, kind="stable")
    kind, leaf = word[order] // CLASS, word[order] % CLASS
    _, hidden = _hidden(w, context[order])
    found = _log_softmax(hidden @ w["top"] + w["top_bias"])[np.arange(len(word)), kind]
    for k, own in _by_class(kind):
        inside = _log_softmax(hidden[own] @ w["leaf"][k] + w["leaf_bias"][k])
        found[own] += inside[np.arange(inside.shape[0]), leaf[own]]
    out = np.empty(len(word))
    out[order] = found
    return out


def gradient(w: Weights, context: np.ndarray, word: np.ndarray) -> Weights:
    """Gradient of the mean negative log-probability."""
    order = np.argsort(word // CLASS, kind="stable")
    context, word = context[order], word[order]
    kind, leaf, n = word // CLASS, word % CLASS, len(word)
    inputs, hidden = _hidden(w, context)
    g = {name: np.zeros(SHAPES[name], dtype=np.float32) for name in ("leaf", "leaf_bias")}
    top = np.exp(_log_softmax(hidden @ w["top"] + w["top_bias"]))
    top[np.arange(n), kind] -= 1
    top /= n
    g["top"], g["top_bias"] = hidden.T @ top, top.sum(axis=0)
    back = top @ w["top"].T
    for k, own in _by_class(kind):
        inside = np.exp(_log_softmax(hidden[own] @ w["leaf"][k] + w["leaf_bias"][k]))
        inside[np.arange(inside.shape[0]), leaf[own]] -= 1
        inside /= n
        g["leaf"][k], g["leaf_bias"][k] = hidden[own].T @ inside, inside.sum(axis=0)
        back[own] += inside @ w["leaf"][k].T
    back *= 1 - hidden**2
    g["mid"], g["mid_bias"] = inputs.T @ back, back.sum(axis=0)
    to_inputs = (back @ w["mid"].T).reshape(-1, WIDTH)
    ids = context.ravel()
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    g["embed"] = np.zeros(SHAPES["embed"], dtype=np.float32)
    g["embed"][ids[order][first]] = np.add.reduceat(to_inputs[order], first, axis=0)
    return g


class Descent:
    """Gradient steps scaled by the gradients seen so far (AdaGrad)."""

    def __init__(self, weights: Weights) -> None:
        self.weights = {k: v.copy() for k, v in weights.items()}
        self.seen = {k: np.full(v.shape, 1e-4, dtype=np.float32) for k, v in weights.items()}

    def step(self, context: np.ndarray, word: np.ndarray) -> None:
        for name, g in gradient(self.weights, context, word).items():
            self.seen[name] += g * g
            self.weights[name] -= RATE * g / np.sqrt(self.seen[name])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, n)``: how often each word hash occurs in a batch."""
    for batch in batches:
        for block in blocks(batch.column(0), BLANK_SEPARATED):
            word, n = np.unique(block.hashes(lower=True), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


class Numbering:
    """Numbers of words: by frequency, or the bucket of their hash."""

    def __init__(self, frequent: np.ndarray) -> None:
        order = np.argsort(frequent)
        self.word, self.number = frequent[order], order

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = (FREQUENT + (hashes >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.uint16)
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
            known = self.word[at] == hashes
            out[known] = self.number[at[known]]
        return out


def _tokens(numbering: Numbering):
    """``(row, doc_id, seed, ids, rare, times)``: the word numbers of each text as bytes,
    and its words in buckets with how often they occur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3), BLANK_SEPARATED):
                hashes = block.hashes(lower=True)
                numbers = numbering.of(hashes)
                ids = [numbers[a:b].tobytes() for a, b in zip(block.at[:-1], block.at[1:], strict=True)]
                own = [batch.column(i).slice(block.first, block.texts()) for i in range(3)]
                rare = numbers >= FREQUENT
                text, word, times = _distinct(block.owner()[rare], hashes[rare])
                at = pa.array(np.searchsorted(text, np.arange(block.texts() + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in (word.view(np.int64), times)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(ids, pa.binary()), *lists], names=["row", "doc_id", "seed", "ids", "rare", "times"]
                )

    return run


def _distinct(text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, by text, and how often each occurs."""
    order = np.lexsort((word, text))
    text, word = text[order], word[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (word[1:] != word[:-1])][: len(text)])
    return text[first], word[first], np.diff(np.r_[first, len(text)])


def _shares(counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """``(word, share)``: for each word that shares a bucket, the logarithm of its part of
    the bucket's occurrences, as an integer."""
    # the bucket that ``Numbering`` gives
    bucket = F.shiftrightunsigned("word", 40) % BUCKETS
    rare = counts.join(F.broadcast(frequent), "word", "left_anti").withColumn("bucket", bucket)
    totals = rare.groupBy("bucket").agg(F.sum("n").alias("total"))  # a row a bucket
    share = F.round(F.ln(F.col("n") / F.col("total")) * F.lit(float(_SHARE_UNIT))).cast("long")
    return rare.join(F.broadcast(totals), "bucket").select("word", share.alias("share"))


def _windows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at a time: the first text; words between paddings; places of the
    words in them; the text of each word; its place in the text."""
    ids = [np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in column]
    first = 0
    while first < len(ids):
        last, size = first, 0
        while last < len(ids) and (last == first or size + len(ids[last]) <= 1 << 17):
            size += len(ids[last])
            last += 1
        pad = np.full(SIDE, _PAD, dtype=np.uint16)
        n = np.array([len(x) for x in ids[first:last]])
        words = np.concatenate([pad, *(y for x in ids[first:last] for y in (x, pad))]).astype(np.int64)
        owner = np.repeat(np.arange(last - first), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        yield first, words, np.arange(len(owner)) + SIDE * (owner + 1), owner, inside
        first = last


def _train(weights: np.ndarray, turn: int):
    """``(place, total, n)``: the weights that a task arrives at, times its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        descent, seen = Descent(shaped(weights)), 0
        offsets = np.array(_OFFSETS)
        for batch in batches:
            seeds = batch.column(0).to_numpy().view(np.uint64)
            for first, words, place, owner, inside in _windows(batch.column(1)):
                key = mix(seeds[first + owner] + np.uint64(turn)) + inside.astype(np.uint64)
                place = place[mix(key) % np.uint64(100) < MASKED_PERCENT]
                for at in range(0, len(place), _BATCH):
                    own = place[at : at + _BATCH]
                    descent.step(words[own[:, None] + offsets], words[own])
                seen += len(place)
        if seen:
            total = np.rint(flat(descent.weights).astype(np.float64) * _UNIT).astype(np.int64)
            places = np.arange(len(total), dtype=np.int32)
            n = np.full(len(total), seen, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total), pa.array(n)], names=["place", "value", "n"])

    return run


def _score(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, offsets = shaped(weights), np.array(_OFFSETS)
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for first, words, place, owner, _ in _windows(batch.column(2)):
                for at in range(0, len(place), 8 * _BATCH):
                    own, text = place[at : at + 8 * _BATCH], owner[at : at + 8 * _BATCH]
                    found = log_probabilities(w, words[own[:, None] + offsets], words[own])
                    total += np.bincount(text + first, weights=found, minlength=len(total))
                    count += np.bincount(text + first, minlength=len(total))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(count), pa.array(total)], names=["row", "doc_id", "n_words", "of_ids"]
            )

    return run


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_likelihood`` for each row of
    ``docs(doc_id, text)``: the summed log-probability of all words (blank-separated,
    ASCII letters lower-cased), each predicted from both sides, and its mean.

    A null or blank text has no words, a sum of 0 and no mean. Ids may be null or
    repeated, repeated texts score alike. Other columns are ignored; an empty
    table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    counts = docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts)
    frequent = scratch.save(counts.orderBy(F.desc("n"), "word").limit(FREQUENT))
    # the others are not left out: they are scored by their share of a bucket
    order = frequent.orderBy(F.desc("n"), "word").select("word").toArrow()["word"].to_numpy()
    numbering = Numbering(order.view(np.uint64))
    shares = scratch.save(_shares(counts, frequent.select("word")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("seed"), "text"
    )
    kinds = "row long, doc_id long, seed long, ids binary, rare array<long>, times array<long>"
    tokens = scratch.save(rows.mapInArrow(_tokens(numbering), kinds))
    weights = flat(fresh_weights())
    for turn in range(rounds):
        sent = tokens.select("seed", "ids").mapInArrow(_train(weights, turn), "place int, value long, n long")
        # weighted by the positions behind each value, in a type without overflow
        mean = sent.groupBy("place").agg(
            (F.sum(F.col("value").cast("decimal(20,0)") * F.col("n")) / F.sum("n")).cast("double").alias("mean")
        )
        found = mean.toArrow()
        if found.num_rows:
            weights = weights.copy()
            weights[found["place"].to_numpy()] = found["mean"].to_numpy() / _UNIT
    kinds = "row long, doc_id long, n_words long, of_ids double"
    made = tokens.select("row", "doc_id", "ids").mapInArrow(_score(weights), kinds)
    met = tokens.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), "w.times")
    inside = met.join(small(shares, 16), "word").groupBy("row").agg(F.sum(F.col("share") * F.col("times")).alias("inside"))
    found = F.col("of_ids") + F.coalesce("inside", F.lit(0)) / F.lit(float(_SHARE_UNIT))
    scored = made.join(inside, "row", "left").select("doc_id", "n_words", found.alias("log_likelihood"))
    return scored.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_words"))
