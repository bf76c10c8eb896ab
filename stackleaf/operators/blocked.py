"""Top-k search for question batches of any size, as a blocked product of two tables.

Corpus rows are dealt to cells, by a hash of their id or by their cluster; each
question goes to the cells it must see. A task holds the vectors of one cell and
lets the questions of that cell stream by, batch after batch, so neither side is
ever held whole: not by the driver, not by a task. The corpus is read once
whatever the number of questions. Where there are fewer cells than tasks, the
questions are dealt in parts and a cell is copied to a task for each of them, so
a question meets few cells and its hits are few.

Cells that are to be small would each get a copy of all questions. Instead many of
them make a strip, and the sides change places: a task holds a part of the questions
with their best hits, and the vectors of its strip stream by, one small cell after
the other. A question is copied once a strip, whatever the size of the cells.

Cells are sized by count ahead of the shuffle. A question's hits that come from many
cells are merged in two steps, by question and salt, then by question.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackleaf.operators import retrieve as rt
from stackleaf.sources.tables import small_batches

# Bytes of the vectors of one cell, in double precision.
CELL_BYTES = 128 << 20
# Tasks a core, and questions that are worth a part of their own.
TASKS, PART = 3, 256
# Bytes of the questions that a task holds while vectors stream by, with their best hits.
HELD_BYTES = 64 << 20
# Groups that the hits of one question are cut in before the last merge.
SALTS = 32


def grid_for(rows: int, questions: int, dims: int, cores: int, cell_bytes: int = CELL_BYTES) -> tuple[int, int]:
    """(cells, parts of the questions): as few cells as hold so many vectors, and so
    many parts that there is work for all cores; more cells where questions are few."""
    cells = max(1, min(rows, -(-rows * max(dims, 1) * 8 // cell_bytes)))
    parts = max(1, min(-(-TASKS * cores // cells), questions // PART))
    return max(cells, min(rows, -(-TASKS * cores // parts))), parts


def strips_for(rows: int, questions: int, dims: int, k: int, cores: int) -> tuple[int, int]:
    """(strips, parts of the questions) where the vectors stream by. The ids of a strip and
    the questions of a part are held, which bounds both; of the grids with work for all
    cores it is that which copies the fewest bytes."""
    strips = max(1, -(-rows * dims * 8 // CELL_BYTES))
    parts = max(1, -(-questions // max(PART, HELD_BYTES // (12 * dims + 96 * k))))

    def copied(grid: tuple[int, int]) -> int:
        return grid[0] * questions * (8 * dims + 40 * k) + grid[1] * rows * 4 * dims

    most = max(parts, min(TASKS * cores, questions // PART))
    return min(((max(strips, min(rows, -(-TASKS * cores // p))), p) for p in range(parts, most + 1)), key=copied)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Pieces of batches with one cell and side."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield (int(keys[0, low]), int(keys[1, low])), batch.slice(int(low), int(high - low))


def _product(k: int, metric: str, digits: int | None, decode=None):
    """Best ``k`` of each cell for each question of it. Rows are sorted by cell, the
    corpus side first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, parts in groupby(_runs(batches), key=lambda x: x[0][0]):
            held, rows, names = [], None, None
            for (_, side), part in parts:
                if side == 0:
                    own = rt._matrix(part.column(3))
                    held.append((part.column(2), decode(own) if decode else own))
                    continue
                if rows is None:
                    if not held:
                        continue  # a cell without vectors
                    names, rows = pa.concat_arrays([i for i, _ in held]), np.concatenate([m for _, m in held])
                    held = []
                    order = rt.in_order(names)
                    names, rows = names.take(pa.array(order)), rows[order]
                for low in range(0, part.num_rows, rt.together(k)):
                    asked = part.slice(low, rt.together(k))
                    nearest = rt.Nearest(rt._matrix(asked.column(5)).astype(np.float64), k, metric, digits)
                    nearest.offer(rows, np.arange(len(rows)))
                    yield _hits(nearest, asked.column(4), names, cell)

    return run


def _hits(nearest: rt.Nearest, asked: pa.Array, names: pa.Array, cell: int) -> pa.RecordBatch:
    q, s, place = nearest.hits()
    salt = pa.array(np.full(len(q), cell % SALTS, dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [asked.take(pa.array(q)), names.take(pa.array(place)), pa.array(s), salt],
        names=["query_id", "chunk_id", "score", "salt"],
    )


def _own(column: pa.Array) -> pa.Array:
    """A copy that does not keep the batch alive it came with."""
    return column.take(pa.array(np.arange(len(column))))


def _stream(k: int, metric: str, digits: int | None, at_once: int, decode=None):
    """As ``_product``, but the questions of a cell are held and its vectors stream by, at
    most ``at_once`` at a time; of them only the ids are kept. Rows are sorted by
    cell, the questions first, the vectors by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, parts in groupby(_runs(batches), key=lambda x: x[0][0]):
            held, names, searches, seen = [], [], None, 0
            for (_, side), part in parts:
                if side == 1:
                    held.append((_own(part.column(4)), rt._matrix(part.column(5)).astype(np.float64)))
                    continue
                if searches is None:
                    if not held:
                        break  # a cell without questions
                    asked, matrix = pa.concat_arrays([i for i, _ in held]), np.concatenate([m for _, m in held])
                    held, step = [], rt.together(k)
                    searches = [
                        (asked.slice(low, step), rt.Nearest(matrix[low : low + step], k, metric, digits))
                        for low in range(0, len(asked), step)
                    ]
                names.append(_own(part.column(2)))
                for low in range(0, part.num_rows, at_once):
                    rows = rt._matrix(part.column(3).slice(low, at_once))
                    rows = decode(rows) if decode else rows
                    for _, nearest in searches:
                        nearest.offer(rows, np.arange(seen, seen + len(rows)))
                    seen += len(rows)
            if seen:
                ids = pa.concat_arrays(names)
                for asked, nearest in searches:
                    yield _hits(nearest, asked, ids, cell)

    return run


def top_k_in_cells(
    corpus: DataFrame, questions: DataFrame, cells: int, k: int, metric: str = "cosine", digits: int | None = None,
    decode=None, numbered: bool = False, met: int | None = None, at_once: int | None = None,
) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the best ``k`` among the cells of each question.

    ``corpus``: ``cell, chunk_id, embedding``, a row in one cell. ``questions``:
    ``cell, query_id, embedding``, a row for each cell that a question must see.
    ``cells`` is about how many there are; ``numbered`` says that they are numbered from
    0 on, so that each gets a task. ``met`` is how many of them a question sees at most.
    A cell's vectors are held by a task, or with ``at_once`` its questions, and the vectors
    stream by, so many at a time.
    ``decode`` may turn the corpus column into vectors. Rows without a vector are left out.
    """
    small_batches(corpus.sparkSession)
    id_type = corpus.schema["chunk_id"].dataType.simpleString()
    question_type = questions.schema["query_id"].dataType.simpleString()
    vector = corpus.schema["embedding"].dataType.simpleString()
    left = corpus.where("embedding IS NOT NULL").select(
        F.col("cell").cast("long").alias("cell"), F.lit(0).alias("side"), "chunk_id", "embedding",
        F.lit(None).cast(question_type).alias("query_id"), F.lit(None).cast("array<double>").alias("question"),
    )
    right = questions.where("embedding IS NOT NULL").select(
        F.col("cell").cast("long").alias("cell"), F.lit(1).alias("side"), F.lit(None).cast(id_type).alias("chunk_id"),
        F.lit(None).cast(vector).alias("embedding"), "query_id", F.col("embedding").cast("array<double>").alias("question"),
    )
    both = left.unionByName(right)
    if numbered:
        both = both.repartitionById(max(1, cells), F.col("cell").cast("int"))
    else:
        both = both.repartition(max(1, cells), "cell")
    schema = f"query_id {question_type}, chunk_id {id_type}, score double, salt int"
    if at_once:
        ordered, search = both.sortWithinPartitions("cell", F.desc("side"), "chunk_id"), _stream(k, metric, digits, at_once, decode)
    else:
        ordered, search = both.sortWithinPartitions("cell", "side"), _product(k, metric, digits, decode)
    hits = ordered.mapInArrow(search, schema)
    if met is None or met > SALTS:
        near = Window.partitionBy("query_id", "salt").orderBy(rt.best_first(metric), "chunk_id")
        hits = hits.withColumn("_place", F.row_number().over(near)).where(F.col("_place") <= k)
    return rt.rank_hits(hits.select("query_id", "chunk_id", "score"), k, metric)


def top_k_blocked(
    vectors: DataFrame, questions: DataFrame, k: int, metric: str = "cosine", digits: int | None = None,
    cell_bytes: int = CELL_BYTES, decode=None,
) -> DataFrame:
    """Exact search for a question batch of any size. ``vectors``: ``chunk_id,
    embedding``; ``questions``: ``query_id, embedding``. Same rows as ``top_k``.
    A task holds the vectors of a cell of ``cell_bytes`` at a time. Cells below
    ``CELL_BYTES`` share strips, so that questions are not copied to each of them."""
    asked, dims = questions.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dims = max(dims or 1, 1)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    at_once = max(1, cell_bytes // (8 * dims)) if cell_bytes < CELL_BYTES else None
    if at_once:
        cells, parts = strips_for(vectors.count(), asked, dims, k, cores)
    else:
        cells, parts = grid_for(vectors.count(), asked, dims, cores, cell_bytes)
    number = F.col("_cell") * parts + F.col("_part")
    dealt = vectors.select(
        "chunk_id", "embedding", F.pmod(F.xxhash64("chunk_id"), F.lit(cells)).alias("_cell"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"),
    ).select("chunk_id", "embedding", number.alias("cell"))
    every = questions.select(
        "query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("_part"),
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_cell"),
    ).select("query_id", "embedding", number.alias("cell"))
    return top_k_in_cells(dealt, every, cells * parts, k, metric, digits, decode, numbered=True, met=cells, at_once=at_once)


def top_k_clustered(
    index: DataFrame, questions: DataFrame, k: int, metric: str = "cosine", digits: int | None = None,
    cell_bytes: int = CELL_BYTES, decode=None,
) -> DataFrame:
    """Cluster search for a question batch of any size. ``index``: ``chunk_id,
    embedding, cluster``; ``questions``: ``query_id, embedding, probes``, the
    clusters to look at. A cluster above ``cell_bytes`` is dealt over several cells."""
    dims = questions.agg(F.max(F.size("embedding"))).first()[0] or 1
    asked = questions.select("query_id", "embedding", F.explode("probes").alias("cluster"))
    # one row a cluster, and there are no more clusters than centres
    sizes = index.groupBy("cluster").agg(F.count("*").alias("rows"))
    parts = F.ceil(F.col("rows") * (dims * 8) / F.lit(float(cell_bytes))).cast("int").alias("parts")
    sizes = F.broadcast(sizes.select("cluster", parts))
    total = sizes.agg(F.sum("parts")).first()[0] or 1
    number = F.col("cluster").cast("long") * (1 << 32)
    dealt = index.join(sizes, "cluster").select(
        "chunk_id", "embedding", (number + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).alias("cell")
    )
    seen = asked.join(sizes, "cluster").select(
        "query_id", "embedding", "cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    ).select("query_id", "embedding", (number + F.col("part")).alias("cell"))
    return top_k_in_cells(dealt, seen, int(total), k, metric, digits, decode)
