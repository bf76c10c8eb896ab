"""Quality rules: base rules, and robust multivariate outliers within language and source.

Each text becomes a vector of transformed statistics. Centre and scatter of a
group are the minimum covariance determinant: mean and covariance of that
share of its rows that lies closest to them. From a robust start, concentration
steps take the closest rows and their moments until the determinant no longer
falls. Rows are cut off by Mahalanobis distance.

A step is one pass over all rows: distances fall into fine bins, the moments
of each group and bin are summed before the shuffle, and the closest bins up
to the share give the next estimate. So a group of any size costs a bounded
number of rows behind the scan, and none of its rows is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.scratch import Scratch, small
from llm.words import BLANK_SEPARATED, blocks, window_hashes, window_starts

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated three-word windows
SHARE = 0.75  # of the rows of a group that the estimate rests on
MIN_ROWS = 50  # a smaller group is judged by a larger estimate
TAIL = 1e-4  # of regular rows of a normal group beyond the cut
MAX_STEPS = 20
BINS_PER_OCTAVE = 64
# Smallest standard deviation of each statistic, a lower bound in every direction of
# the scatter. In a group without any, a tenth of words in repeats, a sixth of lines
# or 1 % of characters that are symbols lie beyond the cut by themselves.
FLOORS = {"size": 0.1, "length": 0.01, "symbols": 0.02, "lines": 0.08, "repeats": 0.06}
VECTOR = list(FLOORS)
_SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(3), BLANK_SEPARATED):
            n = block.texts()
            words, counts = block.hashes(), block.counts()
            inside = BLANK_SEPARATED[block.data]
            chars = _sums(inside & ((block.data & 0xC0) != 0x80), block.text_at)
            symbols = _sums(_SYMBOLS[block.data], block.text_at)
            # three-word windows found twice in a text: neighbours once sorted
            found = window_hashes(words, 3)
            good = np.flatnonzero(window_starts(block.at, 3))
            owner = block.owner()
            order = good[np.lexsort((found[good], owner[good]))]
            same = (found[order[1:]] == found[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
            twice = np.zeros(len(order), dtype=bool)
            twice[1:] |= same
            twice[:-1] |= same
            covered = np.zeros(len(words), dtype=bool)
            for i in range(3):
                covered[order[twice] + i] = True
            repeats = _sums(covered, block.at)
            duplicates, lines = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for i in range(n):
                text = block.data[block.text_at[i] : block.text_at[i + 1]].tobytes()
                full = [x for x in text.split(b"\n") if x.strip()]
                lines[i], duplicates[i] = len(full), len(full) - len(set(full))
            own = [batch.column(i).slice(block.first, n) for i in range(3)]
            made = [counts, chars, symbols, duplicates, repeats, lines]
            names = [c.split()[0] for c in STATS.split(", ")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.astype(np.int64)) for x in made)], names=names)


def statistics(docs: DataFrame) -> DataFrame:
    """The counts of each row of ``docs(doc_id, lang, source, text)``; lines without a
    word are not counted, and a line equal to an earlier one is a duplicate."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text"
    )
    return rows.mapInArrow(_statistics, STATS)


def vector() -> list[Column]:
    """The transformed statistics: logarithms of sizes, square roots of shares."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(words).alias("size"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words).alias("length"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("lines"),
        F.sqrt(F.col("n_repeat_words") / words).alias("repeats"),
    ]


def chi_square_below(x: float, freedom: int) -> float:
    """Share of a chi-square distribution below ``x``: the series of the incomplete gamma function."""
    a, half = freedom / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    for i in range(1, 2000):
        term *= half / (a + i)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi_square_cut(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, freedom) < share else (low, middle)
    return high


_SIZE = len(VECTOR)


def distance_cut(tail: float, n: float) -> float:
    """The squared distance that a share ``tail`` of new rows of a normal group exceeds, its
    centre and scatter estimated on ``n`` rows: a scaled F distribution, for many rows
    the chi-square distribution."""
    p, q = _SIZE, max(n - _SIZE, 1)
    logs = np.linspace(-20, 20, 40001)  # of the F values
    density = p / 2 * logs - (p + q) / 2 * np.log1p(p / q * np.exp(logs))
    density = np.exp(density - density.max())
    above = np.cumsum(density[::-1])[::-1]
    at = np.searchsorted(-above, -tail * above[0])
    return float(p * (n * n - 1) / (n * q) * np.exp(logs[min(at, len(logs) - 1)]))


def _cuts(tail: float, share: float):
    """``(g, cut)`` of each estimate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"g": rows["g"], "cut": [distance_cut(tail, share * float(n)) for n in rows["n"]]})

    return run


_PAIRS = [(i, j) for i in range(_SIZE) for j in range(i, _SIZE)]
_ESTIMATE = ", ".join(
    ["g string", "n long", "det double", *(f"c{i} double" for i in range(_SIZE)), *(f"p{i}{j} double" for i, j in _PAIRS)]
)


def _estimate_row(g: str, n: int, centre: np.ndarray, scatter: np.ndarray) -> dict:
    unit = np.array(list(FLOORS.values()))
    values, vectors = np.linalg.eigh(scatter / np.outer(unit, unit))
    values = np.maximum(values, 1)
    inverse = (vectors / values) @ vectors.T / np.outer(unit, unit)
    row = {"g": g, "n": n, "det": float(np.log(values).sum())}
    row |= {f"c{i}": float(centre[i]) for i in range(_SIZE)}
    return row | {f"p{i}{j}": float(inverse[i, j]) for i, j in _PAIRS}


def _start(rows: pd.DataFrame) -> pd.DataFrame:
    """Medians and quartile ranges of one group, from counts of fine bins."""
    centre, spread, n = np.zeros(_SIZE), np.zeros(_SIZE), 0
    for i in range(_SIZE):
        own = rows[rows["dim"] == i].sort_values("bin")
        below = own["n"].cumsum().to_numpy()
        n = int(below[-1])
        low, middle, high = (own["bin"].to_numpy()[np.searchsorted(below, q * n)] / 256 for q in (0.25, 0.5, 0.75))
        centre[i], spread[i] = middle, (high - low) / 1.349
    return pd.DataFrame([_estimate_row(rows["g"].iloc[0], n, centre, np.diag(spread**2))])


def _concentrate(share: float, factor: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The moments of the closest bins of one group that together hold the share."""
        rows = rows.sort_values("bin")
        below = rows["n"].cumsum().to_numpy()
        take = int(np.searchsorted(below, share * below[-1])) + 1
        near = rows.iloc[:take]
        n = near["n"].sum()
        shift = np.array([near[f"s{i}"].sum() for i in range(_SIZE)]) / n
        scatter = np.zeros((_SIZE, _SIZE))
        for i, j in _PAIRS:
            scatter[i, j] = scatter[j, i] = near[f"q{i}{j}"].sum() / n - shift[i] * shift[j]
        centre = np.array([rows[f"c{i}"].iloc[0] for i in range(_SIZE)]) + shift
        return pd.DataFrame([_estimate_row(rows["g"].iloc[0], int(below[-1]), centre, scatter * factor)])

    return run


def _distance() -> Column:
    off = [F.col(v) - F.col(f"c{i}") for i, v in enumerate(VECTOR)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + off[i] * off[j] * F.col(f"p{i}{j}") * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def robust_estimates(rows: DataFrame, scratch: Scratch, share: float = SHARE) -> DataFrame:
    """Centre and inverse scatter of each group ``g`` of ``rows(g, <vector>)``."""
    wide = rows.select("g", F.posexplode(F.array(*(F.floor(F.col(v) * 256 + 0.5) for v in VECTOR))).alias("dim", "bin"))
    counts = wide.groupBy("g", "dim", "bin").agg(F.count("*").alias("n"))
    now = scratch.save(counts.groupBy("g").applyInPandas(_start, _ESTIMATE))
    quantile = chi_square_cut(share, _SIZE)
    factor = share / chi_square_below(quantile, _SIZE + 2)
    centres = [f"c{i}" for i in range(_SIZE)]
    off = [F.col(v) - F.col(c) for v, c in zip(VECTOR, centres, strict=True)]
    for step in range(MAX_STEPS):
        near = rows.join(small(now, 200), "g")
        bin_ = F.floor(F.log2(_distance() + 1e-9) * BINS_PER_OCTAVE).alias("bin")
        moments = [F.sum(off[i]).alias(f"s{i}") for i in range(_SIZE)]
        moments += [F.sum(off[i] * off[j]).alias(f"q{i}{j}") for i, j in _PAIRS]
        bins = near.groupBy("g", *centres, bin_).agg(F.count("*").alias("n"), *moments)
        new = scratch.save(bins.groupBy("g").applyInPandas(_concentrate(share, factor), _ESTIMATE))
        # the first step only leaves the start behind
        both = new.alias("a").join(now.alias("b"), "g").select(F.max(F.col("b.det") - F.col("a.det")).alias("fall"))
        fall = both.first()["fall"]
        now = new
        if step and (fall is None or fall < 1e-4):
            break
    return now


def _grouped(rows: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """Adds ``g``, the group by which a row is judged, and ``into``, the groups whose
    estimates it enters. Groups are language and source, all of a language, and all rows;
    a row is judged by the first of them that has ``least`` rows, if any has."""
    named = lambda kind, *names: F.concat(F.lit(kind), F.to_json(F.struct(*names)))
    rows = rows.withColumn("own", named("own", "lang", "source")).withColumn("pool", named("pool", "lang"))
    passed = F.sum(F.when(F.col("base_failed"), 0).otherwise(1))
    sizes = scratch.save(rows.groupBy("own", "pool").agg(passed.alias("n")))
    pools = scratch.save(sizes.groupBy("pool").agg(F.sum("n").alias("m")))
    total = pools.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()["m"]
    last = F.lit("all") if total >= least else F.lit(None).cast("string")
    g = F.when(F.col("n") >= least, F.col("own")).when(F.col("m") >= least, F.col("pool")).otherwise(last)
    to = scratch.save(sizes.join(pools, "pool").select("own", "pool", g.alias("g")))
    used = to.where("g = pool").select("pool").distinct().withColumn("used", F.lit(True))
    whole = F.lit("all" if to.where("g = 'all'").limit(1).count() else None).cast("string")
    groups = F.array(F.when(F.col("g") == F.col("own"), F.col("own")), F.when(F.col("used"), F.col("pool")), whole)
    to = to.join(used, "pool", "left").select("own", "g", F.array_compact(groups).alias("into"))
    return rows.join(small(scratch.save(to), 400), "own", "left").drop("own", "pool")


def judge(docs: DataFrame, share: float = SHARE, tail: float = TAIL, least: int = MIN_ROWS) -> DataFrame:
    """Statistics and verdict for each row of ``docs(doc_id, lang, source, text)``:
    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance``.

    ``base_failed``: fewer than 50 words, or over half of them in three-word
    windows found twice or more. ``distance`` is the squared Mahalanobis distance
    from the robust centre of the row's language and source, estimated on rows
    that pass; rows beyond the cut for ``tail`` (``distance_cut``) aren't ``kept``.
    Groups under ``least`` rows are judged by the estimate of all rows of their
    language, or of the whole table if those are too few as well; where even that
    has fewer rows, ``distance`` is null and rows are kept.

    A null text has no words. Null languages and sources are values of their
    own; ids may be null or repeated. Other columns are ignored; an empty table
    gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "outliers")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = scratch.save(statistics(docs).select("*", base_failed.alias("base_failed"), *vector()))
    rows = scratch.save(_grouped(rows, scratch, least))
    entered = rows.where("not base_failed").select(F.explode("into").alias("g"), *VECTOR)
    found = robust_estimates(entered, scratch, share)
    found = scratch.save(found.join(found.select("g", "n").mapInPandas(_cuts(tail, share), "g string, cut double"), "g"))
    judged = rows.join(small(found, 200), "g", "left")
    distance = F.when(F.col("c0").isNotNull(), _distance())
    far = F.coalesce(distance > F.col("cut"), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), distance.alias("distance"),
    )
