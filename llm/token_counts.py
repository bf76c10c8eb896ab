"""Token totals kept up to date by signed deltas.

Events insert, revise or delete the count of one document under one tokenizer
version. A batch of them becomes rows of plus and minus one document and its
tokens by source, language and version; totals are sums of such rows, so they
are never recounted. A batch owns one partition of each table and a commit
rewrites just that: a repeated commit changes nothing.

The newest row of a document is found by its key in the log of earlier batches.
All shuffles are of keys and numbers; texts are counted where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("doc_id", "version")
GROUP = ("source", "lang", "version")
LOG = "doc_id long, version string, op string, source string, lang string, tokens long"
DELTA = "source string, lang string, version string, documents long, tokens long"
PARTITIONED = {"log": LOG, "deltas": DELTA}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text under a tokenizer version; null counts as empty.
    ``blank-1`` counts words between blanks, ``split-1`` cuts these at punctuation."""
    pattern = {"blank-1": r"[^\x20\x09-\x0D]+", "split-1": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"}[version]
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def counted(docs: DataFrame, version: str, op: str = "insert") -> DataFrame:
    """Insert (or revise) events for each row of ``docs(doc_id, text, source, lang)``."""
    return docs.select(
        F.col("doc_id").cast("long"),
        F.lit(version).alias("version"),
        F.lit(op).alias("op"),
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        count_tokens(F.col("text"), version).alias("tokens"),
    )


class TokenTotals:
    """The tables of one rollup below a shared folder: ``log`` has the events of each
    batch, ``deltas`` what they add to the totals."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        schema = f"{PARTITIONED[name]}, batch long"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def _replace(self, name: str, rows: DataFrame, batch: int) -> None:
        # a folder per batch: writing it again replaces that batch alone
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def commit(self, batch: int, events: DataFrame) -> None:
        """Apply ``events(doc_id, version, op, source, lang, tokens)`` as batch ``batch``.

        ``op`` is insert, revise or delete. A batch holds one event for a key: of
        repeated ones the largest counts (deletes first, then by tokens, source
        and language, nulls last). Inserting a present key revises it, revising
        an absent one inserts it, deleting an absent one does nothing. Events
        without ``doc_id`` or ``version`` or with another ``op`` are left out.
        Batches have rising numbers; only the last may be committed again.
        """
        later = self._read("log").where(F.col("batch") > batch).limit(1).count()
        if later:
            raise ValueError(f"a batch after {batch} is committed already")
        named = events.where("doc_id is not null and version is not null and op in ('insert', 'revise', 'delete')")
        columns = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in LOG.split(", ")]
        rank = F.struct((F.col("op") == "delete").alias("d"), "tokens", "source", "lang", "op")
        one = named.select(*columns).groupBy(*KEY).agg(F.max(rank).alias("e"))
        one = one.select(*KEY, F.col("e.op"), F.col("e.source"), F.col("e.lang"), F.coalesce("e.tokens", F.lit(0)).alias("tokens"))
        self._replace("log", one, batch)
        # written first: what follows reads the same rows, however often it runs
        new = self._read("log").where(F.col("batch") == batch).drop("batch")
        old = self._newest(self._read("log").where(F.col("batch") < batch).join(new.select(*KEY), list(KEY), "left_semi"))
        minus = old.where("op <> 'delete'").select(*GROUP, F.lit(-1).cast("long").alias("n"), (-F.col("tokens")).alias("t"))
        plus = new.where("op <> 'delete'").select(*GROUP, F.lit(1).cast("long").alias("n"), F.col("tokens").alias("t"))
        delta = plus.unionByName(minus).groupBy(*GROUP).agg(F.sum("n").alias("documents"), F.sum("t").alias("tokens"))
        self._replace("deltas", delta.where("documents <> 0 or tokens <> 0"), batch)

    @staticmethod
    def _newest(log: DataFrame) -> DataFrame:
        last = log.groupBy(*KEY).agg(F.max_by(F.struct("op", "source", "lang", "tokens"), "batch").alias("e"))
        return last.select(*KEY, "e.*")

    def totals(self) -> DataFrame:
        """``source, lang, version, documents, tokens``: sums of all deltas; groups
        without a document are left out."""
        found = self._read("deltas").groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return found.where("documents <> 0")

    def recount(self) -> DataFrame:
        """The same from the newest event of every document, to check the totals against."""
        live = self._newest(self._read("log")).where("op <> 'delete'")
        return live.groupBy(*GROUP).agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
