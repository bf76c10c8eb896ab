"""A stored cluster index of one processing generation.

``centres/``, ``vectors/`` and ``manifest/`` are Parquet folders partitioned by the
index's own generation. A generation becomes current with its manifest row, the
last thing written, so a reader never meets a half-built one. ``vectors/`` is
further partitioned by batch and cluster: a batch that runs again overwrites its
own rows, and a search reads the probed clusters only.

Centres are trained once and kept; later batches are assigned to them. Each
batch notes how many of its vectors lie farther from their centre than all but
one in a hundred of the training vectors did. When that share grows, the corpus
has moved away from its centres and ``retrain`` builds the next generation.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackleaf.functions.vectors import METRICS
from stackleaf.operators import ann
from stackleaf.operators import retrieve as rt
from stackleaf.sources.tables import small_batches, spread

# Share of training vectors that count as far from their centre.
FAR_SHARE = 0.01
MAX_CENTRE_BYTES = 64 << 20
ROWS = (
    "content_hash string, chunk_id string, pipeline_config_hash string, headings string, embedding array<float>, "
    "codes array<tinyint>, distance double, generation int, batch_id bigint, cluster int"
)
_KEEP = ["content_hash", "chunk_id", "pipeline_config_hash", "headings", "embedding"]


@dataclass(frozen=True)
class IndexSettings:
    """``flat`` scans the vectors of probed clusters, ``sq8`` one byte per dimension
    and then measures ``refine * k`` candidates. At most about
    ``train_per_centre * nlist`` vectors, chosen by a hash, train the centres."""

    kind: str = "flat"
    metric: str = "cosine"
    nlist: int = ann.DEFAULT_NLIST
    nprobe: int = 8
    refine: int = 4
    train_per_centre: int = 256

    def __post_init__(self) -> None:
        if self.kind not in ("flat", "sq8") or self.metric not in METRICS:
            raise ValueError(f"unknown index {self.kind!r} or metric {self.metric!r}")


@dataclass
class Centres:
    """Cluster centres and, from the training sample, the range of each dimension."""

    centers: np.ndarray
    metric: str
    low: np.ndarray
    high: np.ndarray

    def placed(self, rows: np.ndarray) -> np.ndarray:
        """Vectors as they are clustered: of length one where only angles count."""
        if self.metric != "cosine":
            return rows
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)

    def nearest(self, matrix: np.ndarray, nprobe: int) -> np.ndarray:
        """The ``nprobe`` nearest clusters of each row."""
        out, step = [], 65536
        for at in range(0, len(matrix), step):
            out.append(ann.nearest_centers(self.centers, self.placed(matrix[at : at + step]), nprobe))
        return np.concatenate(out) if out else np.zeros((0, min(nprobe, len(self.centers))), dtype=np.int32)

    def finder(self) -> Callable:
        return self.nearest

    def encode(self, rows: np.ndarray) -> np.ndarray:
        span = self.high - self.low
        steps = np.divide(rows - self.low, span, out=np.zeros_like(rows), where=span > 0) * 255
        return (np.clip(np.floor(steps + 0.5), 0, 255) - 128).astype(np.int8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + (codes.astype(np.float64) + 128) / 255 * (self.high - self.low)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assigned(centres: Centres, coded: bool) -> Callable:
    """Adds code, distance and cluster to rows whose last column is the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows(batch.column(batch.num_columns - 1))
            cluster = centres.nearest(rows, 1)[:, 0]
            distance = np.linalg.norm(centres.placed(rows) - centres.centers[cluster], axis=1)
            codes = pa.nulls(len(rows), pa.list_(pa.int8()))
            if coded:
                flat = pa.array(centres.encode(rows).ravel())
                codes = pa.FixedSizeListArray.from_arrays(flat, rows.shape[1]).cast(pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, codes, pa.array(distance), pa.array(cluster)],
                names=[*batch.schema.names, "codes", "distance", "cluster"],
            )

    return run


class VectorIndex:
    """The index in a folder. ``settings`` are those it was built with."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self) -> "VectorIndex":
        """Lay down empty tables."""
        for table, schema, parts in (
            ("vectors", ROWS, ["generation", "batch_id", "cluster"]),
            ("centres", "cluster int, centre array<double>, generation int", ["generation"]),
            ("manifest", "settings string, low array<double>, high array<double>, far double, generation int", ["generation"]),
        ):
            empty = self.spark.createDataFrame([], schema)
            empty.write.mode("ignore").partitionBy(*parts).parquet(f"{self.folder}/{table}")
        return self

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @cached_property
    def _current(self) -> tuple[int, IndexSettings, Centres, float] | None:
        """Generation, settings, centres and far distance of the newest manifest."""
        manifest = self._table("manifest", "settings string, low array<double>, high array<double>, far double, generation int")
        row = manifest.orderBy(F.desc("generation")).first()
        if row is None:
            return None
        settings = IndexSettings(**json.loads(row["settings"]))
        centres = self._table("centres", "cluster int, centre array<double>, generation int")
        # nlist rows, bounded by MAX_CENTRE_BYTES when they were made
        found = centres.where(F.col("generation") == row["generation"]).orderBy("cluster").select("centre").collect()
        matrix = np.array([r["centre"] for r in found])
        return row["generation"], settings, Centres(matrix, settings.metric, np.array(row["low"]), np.array(row["high"])), row["far"]

    def exists(self) -> bool:
        return self._current is not None

    @property
    def settings(self) -> IndexSettings:
        return self._current[1]

    def refresh(self) -> None:
        """Look again for the newest generation."""
        self.__dict__.pop("_current", None)

    # -- writing -----------------------------------------------------------------

    def build(self, chunks: DataFrame, settings: IndexSettings) -> bool:
        """Train and write the next generation over ``chunks`` (``content_hash, chunk_id,
        pipeline_config_hash, headings, embedding, batch_id``). Returns False, and
        builds nothing, where no chunk has a vector."""
        self.refresh()
        generation = 1 + (self._current[0] if self._current else 0)
        known = chunks.where("embedding IS NOT NULL")
        rows = known.count()
        if not rows:
            return False
        dims = known.select(F.size("embedding").alias("n")).first()["n"]
        if settings.nlist * dims * 8 > MAX_CENTRE_BYTES:
            raise ValueError(f"{settings.nlist} centres of {dims} dimensions are more than {MAX_CENTRE_BYTES} bytes")
        share = settings.train_per_centre * settings.nlist / rows
        sample = known.select("embedding")
        if share < 1:
            part = F.pmod(F.xxhash64("content_hash", "chunk_id"), F.lit(1_000_000))
            sample = known.where(part < int(share * 1_000_000) + 1).select("embedding")
        if settings.metric == "cosine":
            size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
            unit = F.transform("embedding", lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))
            trained = ann.train(sample.select(unit.alias("embedding")), nlist=settings.nlist)
        else:
            trained = ann.train(sample, nlist=settings.nlist)
        codec = ann.ByteCodec.fit(sample)
        centres = Centres(trained.centers, settings.metric, np.array(codec.low), np.array(codec.high))
        kinds = ", ".join(f"{n} {t}" for n, t in sample.dtypes) + ", codes array<tinyint>, distance double, cluster int"
        measured = sample.mapInArrow(_assigned(centres, False), kinds)
        far = measured.agg(F.percentile_approx("distance", 1 - FAR_SHARE, 10_000)).first()[0]
        table = self.spark.createDataFrame(
            [(i, c.tolist(), generation) for i, c in enumerate(centres.centers)], "cluster int, centre array<double>, generation int"
        )
        self._replace(table, "centres", ["generation"])
        self._write_rows(known, generation, settings, centres)
        row = (json.dumps(asdict(settings), sort_keys=True), codec.low, codec.high, float(far), generation)
        manifest = "settings string, low array<double>, high array<double>, far double, generation int"
        self._replace(self.spark.createDataFrame([row], manifest), "manifest", ["generation"])
        self.refresh()
        return True

    def add(self, chunks: DataFrame) -> None:
        """Assign the chunks of whole batches to the centres there are and write them.
        A batch that is added again replaces its rows."""
        generation, settings, centres, _ = self._current
        self._write_rows(chunks.where("embedding IS NOT NULL"), generation, settings, centres)

    def _write_rows(self, chunks: DataFrame, generation: int, settings: IndexSettings, centres: Centres) -> None:
        small_batches(self.spark)
        named = [c for c in _KEEP if c != "embedding"]
        rows = spread(chunks).select("batch_id", *named, F.col("embedding").cast("array<float>").alias("embedding"))
        kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", codes array<tinyint>, distance double, cluster int"
        made = rows.mapInArrow(_assigned(centres, settings.kind == "sq8"), kinds)
        # few files a cluster; a large cluster is cut again by adaptive execution
        made = made.withColumn("generation", F.lit(generation)).hint("rebalance", "batch_id", "cluster")
        self._replace(made, "vectors", ["generation", "batch_id", "cluster"])

    def _replace(self, df: DataFrame, table: str, parts: list[str]) -> None:
        write = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
        write.parquet(f"{self.folder}/{table}")

    # -- reading -----------------------------------------------------------------

    def rows(self) -> DataFrame:
        """The vectors of the current generation."""
        return self._table("vectors", ROWS).where(F.col("generation") == self._current[0])

    def far_share(self) -> float:
        """The share of all vectors that lie far from their centre; about ``FAR_SHARE``
        while the corpus is like the training sample."""
        far = F.avg((F.col("distance") > self._current[3]).cast("double"))
        return self.rows().agg(far).first()[0] or 0.0

    def retrain(self, visible: Callable[[DataFrame], DataFrame] | None = None, settings: IndexSettings | None = None) -> bool:
        """Build the next generation from the stored vectors, or those ``visible`` keeps."""
        rows = self.rows().select(*_KEEP, "batch_id")
        return self.build(visible(rows) if visible else rows, settings or self.settings)

    def search(
        self,
        questions: DataFrame,
        k: int = rt.DEFAULT_K,
        nprobe: int | None = None,
        where: str | None = None,
        visible: Callable[[DataFrame], DataFrame] | None = None,
        digits: int | None = None,
    ) -> DataFrame:
        """``query_id, chunk_id, score, rank`` for ``questions(query_id, embedding)``. A chunk
        is named ``<content_hash>_<chunk_id>``. ``where`` is a condition over
        ``headings``; ``visible`` leaves out versions that are no longer live. With all
        clusters probed the result is that of the exact search; with fewer it is
        the best among the probed ones."""
        _, settings, centres, _ = self._current
        rows = self.rows()
        if where:
            rows = rows.where(where)
        if visible:
            rows = visible(rows)
        named = rows.select(
            F.concat_ws("_", "content_hash", "chunk_id").alias("chunk_id"), "embedding", "codes", "cluster"
        )
        nprobe, metric = nprobe or settings.nprobe, settings.metric
        if settings.kind == "flat":
            return ann.ivf_search(named, centres, questions, k, nprobe, metric, digits)
        found = ann._search_clusters(named, centres, questions, "codes", centres.decode, k * settings.refine, nprobe, metric)
        if found is None:
            return rt.no_hits(named, questions)
        return rt.rescore(found, named, questions, k, metric, questions.count() * k * settings.refine, digits)

    @staticmethod
    def _probed(questions: DataFrame, centres: Centres, nprobe: int) -> DataFrame:
        """Questions with the clusters each looks at."""
        known = questions.where("embedding IS NOT NULL")
        return ann.probed(known.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), centres, nprobe)
