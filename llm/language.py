"""Language identification with string kernels.

Two texts are as similar as the number of byte n-grams (lengths 1 to 3, the
blended spectrum, ASCII letters lower-cased) that both contain, whatever their
frequency, divided by the geometric mean of their own numbers. Landmark texts of each language span the
Nyström features, on which kernel ridge regression learns one score for each
language against the rest.

The features of a text enter its scores linearly, so landmarks and regression
fold into one matrix from n-grams to languages, and a batch of texts is scored
by one product of its presence matrix with it. N-grams that no landmark has
are not part of the kernel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.scratch import Scratch, quoted, small, small_batches, struct_ddl
from llm.words import LOWER, cuts, text_bytes

# Rows the classifier is fitted on and landmarks among them, over all languages.
SAMPLE_ROWS = 1200
LANDMARKS = 160
RIDGE = 1e-3
UNKNOWN = "und"
LENGTHS = (1, 2, 3)
_TEXTS_AT_ONCE = 128
# codes of n-grams of different lengths don't overlap
_FIRST_CODE = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}
_CODES = (1 << 8) + (1 << 16) + (1 << 24)


def ngram_codes(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte n-grams of texts that lie one after the other, and which
    of them stay inside one text."""
    data = LOWER[data]
    n = max(len(data) - length + 1, 0)
    code = np.zeros(n, dtype=np.int32)
    for i in range(length):
        code = code << 8 | data[i : i + n]
    good = np.ones(len(data), dtype=bool)
    for i in range(1, length):
        good[ends[ends >= i] - i] = False
    return code + np.int32(_FIRST_CODE[length]), good[:n]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, grams)``: the distinct n-gram codes of each text."""
    for batch in batches:
        raw, at = text_bytes(batch.column(1))
        grams = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = [ngram_codes(raw[a:b], np.array([b - a]), n) for n in LENGTHS]
            grams.append(np.unique(np.concatenate([code[good] for code, good in own])).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["lang", "grams"])


@dataclass
class Classifier:
    """``grams`` are the known n-gram codes; ``weights`` has a row for each and a
    column for each language."""

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each n-gram code, row 0 standing for all unknown ones; the weights by row."""
        kind = np.uint16 if len(self.grams) < 65535 else np.int32
        row = np.zeros(_CODES, dtype=kind)
        row[self.grams] = np.arange(1, len(self.grams) + 1)
        return row, np.vstack([np.zeros((1, len(self.languages))), self.weights]).astype(np.float32)


def train(langs: list[str], grams: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """Fit on texts given by their distinct n-grams; the first texts of each
    language are the landmarks."""
    languages = sorted(set(langs))
    share = max(1, landmarks // max(1, len(languages)))
    marks = [i for lang in languages for i in [i for i, x in enumerate(langs) if x == lang][:share]]
    known = np.unique(np.concatenate([grams[i] for i in marks])) if marks else np.zeros(0, np.int32)
    present = np.zeros((len(grams), len(known)), dtype=np.float32)
    for i, own in enumerate(grams):
        present[i, np.searchsorted(known, own[np.isin(own, known)])] = 1
    present /= np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
    mark = present[marks]
    kernel = (mark @ mark.T).astype(np.float64)
    value, vector = np.linalg.eigh(kernel)
    large = value > 1e-6 * value.max(initial=0)
    root = vector[:, large] / np.sqrt(value[large])
    features = (present @ mark.T).astype(np.float64) @ root
    wanted = (np.array(langs)[:, None] == np.array(languages)[None, :]).astype(np.float64)
    solved = np.linalg.solve(features.T @ features + ridge * len(grams) * np.eye(features.shape[1]), features.T @ wanted)
    return Classifier(languages, known, mark.T.astype(np.float64) @ (root @ solved))


def _predict(model: Classifier, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of, weights = model.tables()
        width = len(weights)
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            has_letter = batch.column(2).to_numpy(zero_copy_only=False)
            row = batch.column(3)
            raw, at = text_bytes(row.field("text"))
            for first, last in cuts(at, texts=_TEXTS_AT_ONCE):
                n = last - first
                data, bounds = raw[at[first] : at[last]], at[first : last + 1] - at[first]
                owner = np.repeat(np.arange(n, dtype=np.int64) * width, np.diff(bounds))
                present = np.zeros(n * width, dtype=np.float32)
                for length in LENGTHS:
                    code, good = ngram_codes(data, bounds[1:], length)
                    present[(owner[: len(code)] + row_of[code])[good]] = 1
                present = present.reshape(n, width)
                present[:, 0] = 0
                size = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
                score = present @ weights / size
                best = score.argmax(axis=1) if score.shape[1] else np.zeros(n, np.int64)
                sure = np.clip(score.max(axis=1, initial=0), 0, 1).astype(np.float64)
                known = has_letter[first:last] & (len(names) > 0)
                lang = np.full(n, UNKNOWN, dtype=object)
                lang[known] = names[best[known]]
                sure[~known] = 0
                own = [batch.column(i).slice(first, n) for i in range(2)]
                made = [*own, pa.array(lang, pa.string()), pa.array(sure)]
                names_out = ["doc_id", "held_out", "lang_pred", "score"]
                if carry:
                    made, names_out = [*made, row.slice(first, n)], [*names_out, "row"]
                yield pa.RecordBatch.from_arrays(made, names=names_out)

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: by a checksum of the id, about a third."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Classifier:
    """Fit on at most ``rows`` labelled texts, as many for each language, chosen
    by a hash of their ids. Rows without id, text or language are not used."""
    scratch = Scratch(docs.sparkSession, "language")
    usable = docs.where("doc_id is not null and text is not null and lang is not null and text <> ''")
    usable = usable.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    keys = usable.select("doc_id", "lang")
    share = max(1, rows // max(1, keys.select("lang").distinct().count()))
    # first within a part of each language, so that no task orders a whole one
    hashed = keys.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod("h", F.lit(64)))
    for parts in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*parts).orderBy("h", "doc_id")
        hashed = hashed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= share)
    chosen = hashed
    chosen = scratch.save(chosen.orderBy("place", "lang").limit(rows).select("doc_id", "lang").distinct())
    texts = usable.join(small(chosen, 60), ["doc_id", "lang"])
    found = texts.select("lang", "text").mapInArrow(_distinct, "lang string, grams binary")
    found = found.orderBy("lang", F.xxhash64("grams"), "grams").limit(2 * rows).toArrow()
    return train(
        found["lang"].to_pylist(), [np.frombuffer(x, dtype=np.int32) for x in found["grams"].to_pylist()], landmarks
    )


def identify(docs: DataFrame, model: Classifier, carry: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs(doc_id, text)``.

    ``lang_pred`` is a language the classifier has learned, or ``und`` (score 0) if
    the text is null or has no letter, or nothing was learned. Of equal scores
    the first language wins. A row without id is not held out. Other columns are
    never looked at; with ``carry`` the whole input row comes along as ``row``. An
    empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    doc_id = F.col("doc_id").cast("long")
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)) if carry else F.struct("text")
    rows = docs.select(
        doc_id.alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), letter.alias("letter"), row.alias("row")
    )
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    if carry:
        schema += ", " + struct_ddl(rows, "row")
    return rows.mapInArrow(_predict(model, carry), schema)
