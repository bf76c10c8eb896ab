"""From raw documents to tokens: the stages, each over what the one before kept.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns
of ``docs``; what they decide is in the rows and texts they return.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import llm
from llm import byte_bpe, decontaminate, language, near_dups, substrings
from llm.queries import vocabulary_file
from llm.scratch import Scratch, quoted, small
from stackleaf.sources.tables import read_table

cloudpickle.register_pickle_by_value(llm)


def _back(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` out of the carried ``row``, some of them replaced."""
    return [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language (null, or without a letter) go."""
    found = language.identify(docs, language.fit(docs), carry=True)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*_back(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and of rows with one ``doc_id``
    and text one row. Different texts of one ``doc_id`` stay or go together."""
    scratch = Scratch(spark, "dropped")
    found = near_dups.near_duplicates(docs, percent=75).where("not kept").select("doc_id").distinct()
    left = docs.join(small(scratch.save(found), 40), "doc_id", "left_anti")
    same = F.sha2("text", 256).alias("_text")
    again = docs.where("doc_id is not null").groupBy("doc_id", same).count().where("count > 1").select("doc_id").distinct()
    again = scratch.save(again)
    if again.isEmpty():
        return left.select(*map(F.col, map(quoted, docs.columns)))
    again = small(again, 40)
    repeated = left.join(again, "doc_id", "left_semi").withColumn("_text", same).dropDuplicates(["doc_id", "_text"]).drop("_text")
    left = left.join(again, "doc_id", "left_anti").unionByName(repeated)
    return left.select(*map(F.col, map(quoted, docs.columns)))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut out; a document
    of which nothing is left goes."""
    found = substrings.remove_repeats(docs, window=50, carry=True)
    cut = F.col("n_removed") > 0
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept").cast("long")).otherwise(F.col("row")["n_chars"])
    return found.where(~cut | (F.col("n_removed") < F.col("n_words"))).select(*_back(docs, **new))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontaminate.find_benchmark(docs, read_table(spark, sf_dir, "benchmark"), window=10, carry=True)
    return found.where(~F.col("contaminated")).select(*_back(docs))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document's encoding and of its decoding."""
    return byte_bpe.digests(docs, *vocabulary_file())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

# Language scores and the tokens of byte-level BPE can't be had from SQL; tests
# hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
