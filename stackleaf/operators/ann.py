"""Approximate search: cluster lists, 8-bit codes, product codes.

Clusters come from ``pyspark.ml`` k-means. An index is a DataFrame with a
``cluster`` column (stored with ``partitionBy('cluster')``, so a search reads
the probed clusters only). Searching uses the same scan as the exact search: a
hot cluster is simply many splits, since nothing is grouped or shuffled by
cluster. With every cluster probed the result equals the exact search.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackleaf.operators import blocked
from stackleaf.operators import retrieve as rt

# Fixed value: clusters of an index unless set otherwise.
DEFAULT_NLIST = 128


def _vector(array: Column) -> Column:
    return array_to_vector(array.cast("array<double>"))


@dataclass
class Clusters:
    """Trained cluster centres (``nlist`` rows; they fit the driver)."""

    model: KMeansModel

    @property
    def centers(self) -> np.ndarray:
        return np.asarray(self.model.clusterCenters())

    def assign(self, vectors: DataFrame, column: str = "embedding") -> DataFrame:
        """Add ``cluster``; a map over the rows, in the JVM."""
        return self.model.transform(
            vectors.withColumn("_features", _vector(F.col(column)))
        ).drop("_features")

    def nearest(self, matrix: np.ndarray, nprobe: int) -> np.ndarray:
        """The ``nprobe`` nearest clusters of each question, one row each."""
        return nearest_centers(self.centers, matrix, nprobe)

    def finder(self):
        """``nearest`` for tasks, without the model."""
        centers = self.centers
        return lambda matrix, nprobe: nearest_centers(centers, matrix, nprobe)


def nearest_centers(centers: np.ndarray, matrix: np.ndarray, nprobe: int) -> np.ndarray:
    nprobe = min(nprobe, len(centers))
    step = max(1, 2_000_000 // len(centers))
    out = []
    for lo in range(0, len(matrix), step):
        d = (centers**2).sum(1)[None, :] - 2 * matrix[lo : lo + step] @ centers.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :nprobe].astype(np.int32))
    return np.concatenate(out) if out else np.zeros((0, nprobe), dtype=np.int32)


def train(
    vectors: DataFrame,
    nlist: int = DEFAULT_NLIST,
    seed: int = 17,
    max_iter: int = 20,
    column: str = "embedding",
) -> Clusters:
    """k-means over the vectors. The vectors are cached for the iterations
    (spilling to disk) and a lost block is read again from its source."""
    from pyspark import StorageLevel

    held = vectors.select(_vector(F.col(column)).alias("_features")).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        means = KMeans(
            k=nlist, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cluster"
        )
        return Clusters(means.fit(held))
    finally:
        held.unpersist()


def _blocks(probes: np.ndarray):
    """For a task: a function from the cluster column of a batch to the blocks
    to score, the rows of a cluster with the questions that probe it."""
    flat = probes.ravel()
    order = np.argsort(flat, kind="stable")
    used, starts = np.unique(flat[order], return_index=True)
    asking = dict(zip(used.tolist(), np.split(order // probes.shape[1], starts[1:])))

    def blocks(cluster: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        rows = np.argsort(cluster, kind="stable")
        found, at = np.unique(cluster[rows], return_index=True)
        groups = np.split(rows, at[1:])
        return [(g, asking[c]) for c, g in zip(found.tolist(), groups) if c in asking]

    return blocks


def _search_clusters(
    index: DataFrame,
    clusters: Clusters,
    questions: DataFrame,
    column: str,
    decode,
    k: int,
    nprobe: int,
    metric: str,
    digits: int | None = None,
) -> DataFrame | None:
    """Best ``k`` in the probed clusters, by the vectors that ``decode`` makes
    of ``column``. Clusters nobody probes are filtered out ahead of the scan
    (at most ``nlist`` values in the condition). A large batch of questions
    stays a table and meets the clusters in cells."""
    everywhere = nprobe >= len(clusters.centers)
    if rt.question_bytes(questions) > rt.MAX_SLICE_BYTES:
        known = questions.where("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        named = index.select("chunk_id", F.col(column).alias("embedding"), "cluster")
        if everywhere:
            return blocked.top_k_blocked(named.drop("cluster"), known, k, metric, digits, decode=decode)
        return blocked.top_k_clustered(named, probed(known, clusters, nprobe), k, metric, digits, decode=decode)
    spark = index.sparkSession
    parts = []
    for piece in rt.question_slices(questions):
        source = index.select("chunk_id", column, "cluster").where(F.col(column).isNotNull())
        asking = None
        if not everywhere:
            probes = clusters.nearest(piece.matrix, nprobe)
            shipped = spark.sparkContext.broadcast(probes)
            asking = lambda shipped=shipped: _blocks(shipped.value)
            used = np.unique(probes).tolist()
            if len(used) < len(clusters.centers):
                source = source.where(F.col("cluster").isin(used))
        parts.append(rt._scan(source, piece, k, metric, digits, column, decode, asking))
    if not parts:
        return None
    return rt.rank_hits(reduce(DataFrame.unionByName, parts), k, metric)


def probed(questions: DataFrame, clusters, nprobe: int) -> DataFrame:
    """``query_id, embedding`` with ``probes``, the clusters each question looks at, found in the tasks."""
    nearest = clusters.finder()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = nearest(rt._matrix(batch.column(1)).astype(np.float64), nprobe)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["query_id", "embedding", "probes"])

    return questions.mapInArrow(run, f"query_id {dict(questions.dtypes)['query_id']}, embedding array<double>, probes array<int>")


def ivf_search(
    index: DataFrame,
    clusters: Clusters,
    questions: DataFrame,
    k: int = rt.DEFAULT_K,
    nprobe: int = 8,
    metric: str = "cosine",
    digits: int | None = None,
) -> DataFrame:
    """Search the ``nprobe`` nearest clusters of each question. ``index``:
    ``chunk_id, embedding, cluster``."""
    hits = _search_clusters(
        index, clusters, questions, "embedding", None, k, nprobe, metric, digits
    )
    return rt.no_hits(index, questions) if hits is None else hits


# --- 8-bit codes ---------------------------------------------------------------


@dataclass
class ByteCodec:
    """Per-dimension range; a value is stored as one of 256 steps of it."""

    low: list[float]
    high: list[float]

    @staticmethod
    def fit(vectors: DataFrame, column: str = "embedding") -> "ByteCodec":
        """Ranges by one aggregate with partial results per task."""
        row = (
            vectors.where(F.col(column).isNotNull())
            .select(Summarizer.metrics("min", "max").summary(_vector(F.col(column))).alias("s"))
            .select("s.min", "s.max")
            .first()
        )
        return ByteCodec([float(x) for x in row["min"]], [float(x) for x in row["max"]])

    def encode(self, vector: Column) -> Column:
        """``array<tinyint>``: step 0..255, stored from -128."""
        low = F.array(*map(F.lit, self.low))
        span = F.array(*[F.lit(h - l) for l, h in zip(self.low, self.high)])
        scaled = F.zip_with(
            F.zip_with(vector, low, lambda x, l: x.cast("double") - l),
            span,
            lambda d, s: F.when(s == 0, F.lit(0.0)).otherwise(d / s * 255.0),
        )
        return F.transform(scaled, lambda x: (F.floor(x + 0.5) - 128).cast("tinyint"))

    def decoder(self):
        low, high = np.array(self.low), np.array(self.high)
        return lambda codes: low + (codes.astype(np.float64) + 128.0) / 255.0 * (high - low)


def sq8_index(assigned: DataFrame, codec: ByteCodec) -> DataFrame:
    """``chunk_id, cluster, codes``: one byte per dimension."""
    return assigned.select("chunk_id", "cluster", codec.encode(F.col("embedding")).alias("codes"))


def sq8_search(
    index: DataFrame,
    codec: ByteCodec,
    clusters: Clusters,
    questions: DataFrame,
    vectors: DataFrame,
    k: int = rt.DEFAULT_K,
    nprobe: int = 8,
    metric: str = "cosine",
    refine: int = 4,
    digits: int | None = None,
) -> DataFrame:
    """Search by decoded codes, then exact scores for the best ``refine * k``
    candidates of each question."""
    found = _search_clusters(
        index, clusters, questions, "codes", codec.decoder(), k * refine, nprobe, metric
    )
    if found is None:
        return rt.no_hits(index, questions)
    return rt.rescore(found, vectors, questions, k, metric, questions.count() * k * refine, digits)


# --- product codes -------------------------------------------------------------


@dataclass
class ProductCodec:
    """A codebook per slice of the vector."""

    models: list[KMeansModel]
    width: int

    @staticmethod
    def fit(
        vectors: DataFrame,
        parts: int,
        codes: int = 256,
        seed: int = 17,
        max_iter: int = 10,
        column: str = "embedding",
    ) -> "ProductCodec":
        from pyspark import StorageLevel

        dims = vectors.select(F.size(column)).first()[0]
        if dims % parts:
            raise ValueError(f"{parts} parts do not divide {dims} dimensions")
        width = dims // parts
        held = vectors.select(
            *[_vector(F.slice(column, p * width + 1, width)).alias(f"_p{p}") for p in range(parts)]
        ).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            models = [
                KMeans(
                    k=codes,
                    seed=seed + p,
                    maxIter=max_iter,
                    featuresCol=f"_p{p}",
                    predictionCol=f"_c{p}",
                ).fit(held)
                for p in range(parts)
            ]
        finally:
            held.unpersist()
        return ProductCodec(models, width)

    def encode(self, vectors: DataFrame, column: str = "embedding") -> DataFrame:
        """Add ``codes array<smallint>``."""
        out = vectors
        for p, model in enumerate(self.models):
            out = model.transform(
                out.withColumn(f"_p{p}", _vector(F.slice(column, p * self.width + 1, self.width)))
            )
        names = [f"_c{p}" for p in range(len(self.models))]
        codes = F.array(*[F.col(n).cast("smallint") for n in names])
        return out.withColumn("codes", codes).drop(
            *names, *[f"_p{p}" for p in range(len(self.models))]
        )

    def decoder(self):
        books = [np.asarray(m.clusterCenters()) for m in self.models]
        return lambda codes: np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1)


def pq_index(assigned: DataFrame, codec: ProductCodec) -> DataFrame:
    """``chunk_id, cluster, codes``: one code per slice of the vector."""
    return codec.encode(assigned).select("chunk_id", "cluster", "codes")


def pq_search(
    index: DataFrame,
    codec: ProductCodec,
    clusters: Clusters,
    questions: DataFrame,
    vectors: DataFrame,
    k: int = rt.DEFAULT_K,
    nprobe: int = 8,
    metric: str = "cosine",
    refine: int = 8,
    digits: int | None = None,
) -> DataFrame:
    """As the 8-bit search, with vectors rebuilt from the codebooks."""
    return sq8_search(index, codec, clusters, questions, vectors, k, nprobe, metric, refine, digits)
