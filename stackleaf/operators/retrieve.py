"""Top-k similarity search for a batch of questions.

The corpus is the large side and never moves: each task reads its own splits,
compares blocks of vectors with the matrix of questions, and keeps the best
``k`` per question. Only those leave the task, and one window over
``question`` merges them. No pair rows are made and the corpus is not shuffled.

Pairs are estimated by products in single precision; those that could be among the
best, given how far an estimate may be off, are measured in double precision.

The questions go to the tasks as a broadcast matrix only where their measured
size is at most ``MAX_SLICE_BYTES``; a larger batch is searched as a blocked
product of two tables (``blocked``) and never passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackleaf.functions import keys
from stackleaf.functions.vectors import METRICS
from stackleaf.sources.tables import MAX_BROADCAST_ROWS, small_batches, work_folder

# Defaults of a search.
DEFAULT_K = 10
DEFAULT_FILTER = "headings != 'Contents'"
DEFAULT_EXCLUDED = "Contents"

MAX_SLICE_BYTES = 4 << 20
# Bytes of the vectors that a task of the scan holds at a time.
BLOCK_BYTES = 32 << 20
# Vectors and questions of one product, and how many best pairs one running list is for.
_ROWS, _QUESTIONS, _KEPT = 2048, 1024, 400_000


class Slice(NamedTuple):
    """Questions of one slice: ids (Arrow, and their Spark type) and their
    vectors (one row each)."""

    ids: pa.Array
    matrix: np.ndarray
    id_type: str


def question_slices(
    questions: DataFrame,
    query_id: str = "query_id",
    vector: str = "embedding",
    max_bytes: int = MAX_SLICE_BYTES,
) -> Iterator[Slice]:
    """The question batch in slices of measured size.

    One small aggregate measures the batch. If it is too large, the number of
    hash slices doubles until the largest one fits. Questions without a vector
    are left out.
    """
    questions = questions.where(F.col(vector).isNotNull())
    size = F.size(vector) * F.lit(8) + F.lit(64)
    slices = 1
    while True:
        tagged = questions.withColumn("_slice", F.pmod(F.xxhash64(query_id), F.lit(slices)))
        sizes = tagged.groupBy("_slice").agg(
            F.sum(size).alias("b"), F.count("*").alias("n")
        )
        largest, rows = sizes.agg(F.max("b"), F.max("n")).first()
        if largest is None:
            return
        if largest <= max_bytes or rows == 1:
            break
        slices = max(slices * 2, int(2 ** np.ceil(np.log2(largest * slices / max_bytes))))
    for at in range(slices):
        table = (
            tagged.where(F.col("_slice") == at)
            .select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v"))
            .toArrow()
        )
        if table.num_rows:
            flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            id_type = questions.schema[query_id].dataType.simpleString()
            yield Slice(table["q"].combine_chunks(), flat.reshape(table.num_rows, -1), id_type)


def question_bytes(questions: DataFrame, vector: str = "embedding") -> int:
    """Bytes of a question batch as a matrix with its ids, by one small aggregate."""
    known = questions.where(F.col(vector).isNotNull())
    return known.agg(F.sum(F.size(vector) * F.lit(8) + F.lit(64))).first()[0] or 0


class BestK:
    """Running best ``k`` per question in one task. Order: score (better
    first), then id; the same order as the final merge, so cuts are exact.
    ``floor`` is the score a newcomer must reach."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.floor = np.full(questions, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((q, s, ids))
        self.held += len(q)
        if self.held > 4 * self.k * len(self.floor) + 100_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Drop what is not among the best; the rest as (question, score, id)."""
        if not self.parts:
            return None
        q, s, ids = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, -s, q))
        q = q[order]
        first = np.r_[True, q[1:] != q[:-1]]
        starts = np.flatnonzero(first)
        rank = np.arange(len(q)) - starts[np.cumsum(first) - 1]
        keep = rank < self.k
        order, q, rank = order[keep], q[keep], rank[keep]
        s, ids = s[order], ids[order]
        full = rank == self.k - 1
        self.floor[q[full]] = s[full]
        self.parts, self.held = [(q, s, ids)], len(q)
        return self.parts[0]


def _offer(best: BestK, scores: np.ndarray, ids_at, columns: np.ndarray) -> None:
    """Hand a block's scores to ``best``, leaving out what cannot get in.
    ``ids_at(rows)`` gives the ids of rows; most rows never need theirs."""
    floor = best.floor[columns]
    if len(scores) > best.k:
        kth = np.partition(scores, len(scores) - best.k, axis=0)[len(scores) - best.k]
        floor = np.maximum(floor, kth)
    r, c = np.nonzero(scores >= floor[None, :])
    if len(r):
        rows, back = np.unique(r, return_inverse=True)
        best.add(columns[c], scores[r, c], ids_at(rows)[back])


def _rounded(scores: np.ndarray, digits: int | None) -> np.ndarray:
    return scores if digits is None else np.round(scores, digits) + 0.0


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def _pair_scores(a: np.ndarray, b: np.ndarray, metric: str, digits: int | None) -> np.ndarray:
    """Score of each row of ``a`` with that of ``b``, larger is better: distances are negative."""
    if metric == "l2":
        return -_rounded(_norms(a - b), digits) + 0.0
    scores = np.einsum("ij,ij->i", a, b)
    if metric == "cosine":
        norms = _norms(a) * _norms(b)
        scores = np.divide(scores, norms, out=np.zeros_like(norms), where=norms > 0)
    return _rounded(scores, digits)


class Nearest:
    """Running best ``k`` of some questions over vectors that come block by block.

    A vector goes by its place, whose order is that of the ids. With ``ordered``
    places only grow, and then a vector that ties with a full list comes too late.
    """

    def __init__(self, questions: np.ndarray, k: int, metric: str, digits: int | None = None, ordered: bool = True) -> None:
        self.best = BestK(len(questions), k)
        self.questions, self.k, self.metric, self.digits, self.ordered = questions, k, metric, digits, ordered
        self.sizes = _norms(questions)
        # half a step of rounding, and what doubles are off
        self.half = 1e-13 if digits is None else 0.5000001 * 10.0**-digits
        self.off = 1.5 * (questions.shape[1] + 12) * float(np.finfo(np.float32).eps)
        self.seen, self.next_cut = 0, 1
        self.kept: tuple[float, np.ndarray] | None = None

    def _small(self, rows: np.ndarray, sizes: np.ndarray, unit: float, question: bool) -> np.ndarray:
        """Vectors as the estimate takes them."""
        if self.metric == "l2":
            last = np.ones(len(rows)) if question else -0.5 * (sizes / unit) ** 2
            return np.column_stack([rows / unit, last]).astype(np.float32)
        if question or self.metric == "cosine":
            return np.divide(rows, sizes[:, None], out=np.zeros_like(rows), where=sizes[:, None] > 0).astype(np.float32)
        return (rows / unit).astype(np.float32)

    def _all_small(self, unit: float) -> np.ndarray:
        """All questions as the estimate takes them, made once for many small blocks."""
        unit = unit if self.metric == "l2" else 1.0
        if self.kept is None or self.kept[0] != unit:
            self.kept = unit, self._small(self.questions, self.sizes, unit, True)
        return self.kept[1]

    def _score(self, estimate: np.ndarray, sizes: np.ndarray, unit: float) -> np.ndarray:
        if self.metric == "l2":
            return -np.sqrt(np.maximum(sizes**2 - 2 * unit**2 * estimate, 0))
        return estimate if self.metric == "cosine" else estimate * (unit * sizes)

    def _estimate(self, score: np.ndarray, sizes: np.ndarray, unit: float) -> np.ndarray:
        if self.metric == "cosine":
            return score
        if self.metric == "l2":
            return ((sizes / unit) ** 2 - (score / unit) ** 2) / 2
        return np.divide(score, unit * sizes, out=np.full(len(score), -np.inf), where=sizes > 0)

    def offer(self, rows: np.ndarray, place: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Vectors for the questions ``asking``, all by default."""
        every = asking is None
        asking = np.arange(len(self.questions)) if every else asking
        if not len(rows) or not len(asking):
            return
        sizes = np.concatenate([_norms(rows[at : at + _ROWS].astype(np.float64)) for at in range(0, len(rows), _ROWS)])
        unit = float(max(sizes.max(), self.sizes[asking].max() if self.metric == "l2" else 0)) or 1.0
        small = self._all_small(unit) if every else self._small(self.questions[asking], self.sizes[asking], unit, True)
        for at in range(0, len(rows), _ROWS):
            part, own = rows[at : at + _ROWS].astype(np.float64), place[at : at + _ROWS]
            turned = self._small(part, sizes[at : at + _ROWS], unit, False).T
            for low in range(0, len(asking), _QUESTIONS):
                self._tile(part, own, turned, small[low : low + _QUESTIONS], asking[low : low + _QUESTIONS], unit)
            self.seen += len(part)
            # the lists double what they have seen between two cuts, so each brings about k newcomers
            if self.seen >= self.next_cut:
                self.best.cut()
                self.next_cut = 2 * self.seen

    def _tile(self, part: np.ndarray, place: np.ndarray, turned: np.ndarray, small: np.ndarray, asking: np.ndarray, unit: float) -> None:
        estimate, sizes = small @ turned, self.sizes[asking]
        floor = self.best.floor[asking]
        n, k = len(part), self.k
        open_ = np.isneginf(floor)
        if open_.any() and n > k:
            # of each group its best: the k-th of those is no more than the k-th of all
            groups = min(n, max(4 * k, n // 16))
            tops = estimate[:, : n // groups * groups].reshape(len(small), -1, groups).max(axis=1)
            least = np.partition(tops, groups - k, axis=1)[:, groups - k].astype(np.float64) - self.off
            floor = np.where(open_, self._score(least, sizes, unit) - self.half * (1 + np.abs(least)), floor)
        bound = self._estimate(floor - self.half * (1 + np.abs(np.where(np.isinf(floor), 0, floor))), sizes, unit) - self.off
        if self.ordered and self.metric != "l2":
            # to a question of no length all vectors are alike: the first ones stay
            bound = np.where((sizes == 0) & ~open_, np.inf, bound)
        near = np.flatnonzero(estimate >= bound.astype(np.float32)[:, None])
        for low in range(0, len(near), 65536):
            q, r = np.divmod(near[low : low + 65536], n)
            own = asking[q]
            scores = _pair_scores(part[r], self.questions[own], self.metric, self.digits)
            known = self.best.floor[own]
            keep = scores > known if self.ordered else scores >= known
            if keep.any():
                self.best.add(own[keep], scores[keep], place[r[keep]])

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, score, place), the score as the metric has it."""
        found = self.best.cut()
        if found is None:
            none = np.zeros(0, dtype=np.int64)
            return none, np.zeros(0), none
        q, s, place = found
        return q, (s if METRICS[self.metric] else -s) + 0.0, place


def together(k: int) -> int:
    """How many questions share a running list."""
    return int(np.clip(_KEPT // k, 256, 16384))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def in_order(names: pa.Array) -> np.ndarray:
    """Places of ids in their order, that of Spark: numbers, or UTF-8 bytes."""
    plain = names if pa.types.is_integer(names.type) else names.cast(pa.binary())
    return pc.sort_indices(plain).to_numpy(zero_copy_only=False).astype(np.int64)


def _scan(
    vectors: DataFrame,
    questions: Slice,
    k: int,
    metric: str,
    digits: int | None = None,
    column: str = "embedding",
    decode=None,
    asking=None,
) -> DataFrame:
    """Best ``k`` per question and block of a task. ``vectors``: ``chunk_id`` and
    ``column``, which ``decode`` may turn into vectors. ``asking()`` may give a
    function from the ``cluster`` column to (row indices, question indices) pairs, the
    rows of a cluster and those who look at it."""
    spark = vectors.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast((questions.ids, questions.matrix))
    id_field = vectors.schema["chunk_id"]

    def search(batches):
        ids, matrix = shipped.value
        blocks = asking() if asking else None
        for names, rows, cluster in _held(batches, column, decode, blocks is not None):
            order = in_order(names)
            names, rows = names.take(pa.array(order)), rows[order]
            work = blocks(cluster[order]) if blocks else [(np.arange(len(rows)), None)]
            step = together(k)
            for low in range(0, len(matrix), step):
                nearest = Nearest(matrix[low : low + step], k, metric, digits, ordered=blocks is None)
                for at, who in work:
                    own = None if who is None else who[(who >= low) & (who < low + step)] - low
                    nearest.offer(rows if who is None else rows[at], at, own)
                q, s, place = nearest.hits()
                if len(q):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(q + low)), names.take(pa.array(place)), pa.array(s)],
                        names=["query_id", "chunk_id", "score"],
                    )

    return vectors.mapInArrow(
        search,
        f"query_id {questions.id_type}, chunk_id {id_field.dataType.simpleString()}, score double",
    )


def _held(batches, column: str, decode, clustered: bool):
    """Batches put together to blocks of about ``BLOCK_BYTES``: ids, vectors, clusters."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _matrix(batch.column(column))
        rows = decode(rows) if decode else rows
        held.append((batch.column("chunk_id"), rows, batch.column("cluster").to_numpy() if clustered else None))
        size += rows.size * 8
        if size >= BLOCK_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[pa.Array, np.ndarray, np.ndarray | None]:
    names, rows, cluster = zip(*held)
    return pa.concat_arrays(names), np.concatenate(rows), None if cluster[0] is None else np.concatenate(cluster)


def best_first(metric: str) -> Column:
    return F.desc("score") if METRICS[metric] else F.asc("score")


def rank_hits(hits: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Rank from 1 per question by score, then chunk id, and keep ``k``."""
    w = Window.partitionBy("query_id").orderBy(best_first(metric), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "cosine",
    where: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Exact search: ``query_id, chunk_id, score, rank``. With ``digits``, scores are
    rounded to so many places before they are ranked.

    ``chunks`` has ``chunk_id`` (unique per row), ``embedding`` and any columns used by ``where``, a
    SQL condition over the metadata applied before scoring (it reaches the
    Parquet scan). ``questions`` has ``query_id, embedding``.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {sorted(METRICS)}")
    kept = chunks.where(F.expr(where)) if where else chunks
    vectors = kept.select("chunk_id", "embedding").where(F.col("embedding").isNotNull())
    if question_bytes(questions) > MAX_SLICE_BYTES:
        from stackleaf.operators.blocked import top_k_blocked

        return top_k_blocked(vectors, questions.select("query_id", "embedding"), k, metric, digits)
    parts = [_scan(vectors, s, k, metric, digits=digits) for s in question_slices(questions)]
    if not parts:
        return no_hits(chunks, questions)
    return rank_hits(reduce(DataFrame.unionByName, parts), k, metric)


def no_hits(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    return chunks.sparkSession.createDataFrame(
        [],
        f"query_id {questions.schema['query_id'].dataType.simpleString()}, "
        f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double, rank int",
    )


def top_k_prefiltered(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "cosine",
    where: str = DEFAULT_FILTER,
    digits: int | None = None,
) -> DataFrame:
    """Filter, then exactly ``k`` per question (if that many are left). A
    missing heading counts as an empty one and passes the default filter."""
    if where == DEFAULT_FILTER:
        # said without a function around the column, it reaches the Parquet scan
        return top_k(chunks, questions, k, metric, f"headings IS NULL OR {where}", digits)
    known = chunks.withColumn("headings", F.coalesce("headings", F.lit("")))
    return top_k(known, questions, k, metric, where, digits)


def excluded_headings(setting: str = DEFAULT_EXCLUDED) -> list[str]:
    """Comma-separated setting to a list; parts are trimmed, empty ones dropped."""
    return [h.strip() for h in setting.split(",") if h.strip()]


def top_k_postfiltered(
    chunks: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "cosine",
    excluded: Sequence[str] | None = None,
    config: str | None = None,
    candidates: int | None = None,
    digits: int | None = None,
    fill: bool = False,
) -> DataFrame:
    """Over-fetch ``candidates`` (``2 * k`` by default, ``k`` at least), drop those with an excluded
    heading or of another config, keep up to ``k``. Without ``fill`` a question may
    get fewer than ``k``. With it, questions that got fewer search again, and only
    they: with the condition applied ahead of the scoring, which finds what any
    longer list of candidates would leave."""
    excluded = excluded_headings() if excluded is None else list(excluded)
    fetch = max(k, 2 * k if candidates is None else candidates)
    found = top_k(chunks, questions, fetch, metric, digits=digits)
    meta = attach(
        found, chunks, ["headings", "pipeline_config_hash"], questions.count() * fetch
    )
    kept = meta.where(~F.coalesce("headings", F.lit("")).isin(*excluded))
    if config is not None:
        kept = kept.where(F.col("pipeline_config_hash") == config)
    hits = rank_hits(kept.select("query_id", "chunk_id", "score"), k, metric)
    return _filled(hits, chunks, questions, k, metric, excluded, config, digits) if fill else hits


def _filled(
    hits: DataFrame, chunks: DataFrame, questions: DataFrame, k: int, metric: str,
    excluded: Sequence[str], config: str | None, digits: int | None,
) -> DataFrame:
    """Hits with those of short questions replaced by a filtered search. Hits are saved,
    so the first search runs once."""
    spark = hits.sparkSession
    folder = work_folder(spark, "hits")
    hits.write.parquet(folder)
    saved = spark.read.schema(hits.schema).parquet(folder)
    full = saved.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = questions.join(full, "query_id", "left_anti")
    if short.isEmpty():
        return saved
    wanted = chunks.where(F.col("headings").isNull() | ~F.col("headings").isin(*excluded)) if excluded else chunks
    if "" in excluded:
        wanted = wanted.where(F.col("headings").isNotNull())
    if config is not None:
        wanted = wanted.where(F.col("pipeline_config_hash") == config)
    more = top_k(wanted, short, k, metric, digits=digits)
    return saved.join(full, "query_id", "left_semi").unionByName(more)


def attach(
    hits: DataFrame, chunks: DataFrame, columns: Sequence[str], max_rows: int | None = None
) -> DataFrame:
    """Fetch chunk columns for hits, after the search, so that scoring reads
    vectors only. With ``max_rows`` known to be small the hits are broadcast
    and the corpus is scanned without a shuffle; else Spark chooses."""
    small = max_rows is not None and max_rows <= MAX_BROADCAST_ROWS
    left = F.broadcast(hits) if small else hits
    return chunks.select("chunk_id", *columns).join(left, "chunk_id").select(
        *hits.columns, *columns
    )


def attach_stored(
    hits: DataFrame, chunks: DataFrame, columns: Sequence[str], max_rows: int
) -> DataFrame:
    """As ``attach``, for stored chunks with their ``file``: a scan of ids finds
    the files that hold hits, and the wide columns are read from those only.
    There are at most ``max_rows`` hits; the search runs once, its result is
    saved to the shared folder."""
    if max_rows > MAX_BROADCAST_ROWS:
        return attach(hits, chunks, columns, max_rows)
    spark = hits.sparkSession
    folder = work_folder(spark, "hits")
    hits.write.parquet(folder)
    saved = spark.read.schema(hits.schema).parquet(folder)
    holding = chunks.select("chunk_id", "file").join(
        F.broadcast(saved.select("chunk_id").distinct()), "chunk_id", "left_semi"
    )
    files = [r.file for r in holding.select("file").distinct().collect()]
    return attach(saved, chunks.where(F.col("file").isin(files)), columns, max_rows)


def project_hits(hits: DataFrame) -> DataFrame:
    """Hit fields for the reader; the stored raw text, or the embedded text
    where the raw text is missing or empty."""
    return hits.select(
        "query_id",
        "rank",
        F.coalesce("headings", F.lit("")).alias("headings"),
        F.coalesce("parent_headings", F.lit("")).alias("parent_headings"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce(F.when(F.col("raw_text") != "", F.col("raw_text")), F.col("page_content")).alias(
            "page_content"
        ),
    )


def cite_hits(hits: DataFrame) -> DataFrame:
    """Citation fields of each hit: document, position, pages; -1 or empty
    where the stored chunk has none."""
    return hits.select(
        "query_id",
        "rank",
        "chunk_id",
        F.coalesce("filename", F.lit("")).alias("filename"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"),
        F.coalesce("total_chunks", F.lit(-1)).alias("total_chunks"),
        keys.decode_pages(F.coalesce("page_numbers", F.lit(""))).alias("page_numbers"),
    )


def rescore(
    candidates: DataFrame,
    chunks: DataFrame,
    questions: DataFrame,
    k: int,
    metric: str,
    max_rows: int,
    digits: int | None = None,
) -> DataFrame:
    """Exact scores for candidate pairs, then the best ``k`` per question.
    There are at most ``max_rows`` candidates. Pairs are scored batch by batch
    with the arithmetic of the exact search."""
    small_batches(candidates.sparkSession)
    fetch = attach_stored if "file" in chunks.columns else attach
    pairs = fetch(
        candidates.select("query_id", "chunk_id"), chunks, ["embedding"], max_rows
    ).withColumnRenamed("embedding", "_a")
    pairs = pairs.join(questions.select("query_id", F.col("embedding").alias("_b")), "query_id")
    kinds = dict(pairs.dtypes)
    exact = pairs.select("query_id", "chunk_id", "_a", "_b").mapInArrow(
        _measured(metric, digits), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    )
    return rank_hits(exact, k, metric)


def _measured(metric: str, digits: int | None):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_matrix(batch.column(i)).astype(np.float64) for i in (2, 3))
            scores = _pair_scores(a, b, metric, digits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((scores if METRICS[metric] else -scores) + 0.0)],
                names=["query_id", "chunk_id", "score"],
            )

    return run
