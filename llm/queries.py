"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import byte_bpe, chat, decontaminate, gam, language, licenses, lm_score, near_dups, outliers, prefix_trie, repair, substrings
from llm.ordering import positions, sorted_digests
from llm.scratch import Scratch
from llm.token_counts import TokenTotals, counted
from stackleaf.sources.tables import read_table


def vocabulary_file() -> tuple[str, str]:
    """Path of the public vocabulary and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents are inserted under both tokenizer versions; then every seventh is
    deleted, and every fifth of the others is revised to its first line; then the
    deleted ones are inserted again and the others revised to their whole texts,
    so the totals are those of all whole documents."""
    docs = read_table(spark, folder, "documents")
    totals = TokenTotals(spark, Scratch(spark, "totals").folder)
    inserts = counted(docs, "blank-1").unionByName(counted(docs, "split-1"))
    totals.commit(1, inserts)
    versions = F.explode(F.array(F.lit("blank-1"), F.lit("split-1"))).alias("version")
    gone = docs.where("doc_id % 7 = 0").select("doc_id", versions).select(
        "doc_id", "version", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("tokens"),
    )
    moved = docs.where("doc_id % 7 <> 0 and doc_id % 5 = 0").withColumn("text", F.substring_index("text", "\n", 1))
    revised = counted(moved, "blank-1", "revise").unionByName(counted(moved, "split-1", "revise"))
    changes = gone.unionByName(revised)
    totals.commit(2, changes)
    totals.commit(2, changes)  # a commit that is repeated changes nothing
    gone = docs.where("doc_id % 7 = 0")
    moved = docs.where("doc_id % 7 <> 0 and doc_id % 5 = 0")
    back = [counted(rows, v, op) for rows, op in ((gone, "insert"), (moved, "revise")) for v in ("blank-1", "split-1")]
    totals.commit(3, reduce(DataFrame.unionByName, back))
    return totals.totals()


def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(read_table(spark, folder, "documents"), window=50, with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, folder, "documents"))


def op4_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judge(read_table(spark, folder, "documents"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_benchmark(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), window=10
    )
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(read_table(spark, folder, "documents"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return language.identify(docs, language.fit(docs))


def _read_back(batches):
    """Digests of what a reader gets back from formatted conversations."""
    for batch in batches:
        columns = [[] for _ in range(5)]
        for formatted, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = chat.parse(formatted)
            lines = "".join(f"{role}\n{text}\n" for role, text in turns)
            learned = "".join(chat.unescape(formatted[x["start"] : x["end"]]) for x in loss)
            for column, value in zip(
                columns, (len(turns), _sha256(lines), len(learned), _sha256(learned), len(formatted)), strict=True
            ):
                column.append(value)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=names)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation is a reply tree of one branch: every turn answers the one before."""
    own = "</s>[INST] ok [/INST]"
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(
        spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    )
    # rows of one turn follow each other
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    messages = rows.select(
        F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
    found = chat.format_trees(messages)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return found.select(F.col("tree").alias("conv_id"), "formatted", "loss").mapInArrow(_read_back, schema)


def op9_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(read_table(spark, folder, "documents"), percent=75)


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(read_table(spark, folder, "documents"), *vocabulary_file())


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations are damaged by a hash of conversation and turn, then repaired."""
    table = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")

    def spaced(name: str) -> F.Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    damaged = table.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(spaced("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text")).alias("text"),
        F.explode(F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    ).drop("col")
    found = repair.repair(damaged)
    lines = found.turns.select("conv_id", "k", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = sorted_digests(lines, ["conv_id"], ["k", "step"], "line", "\n")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    result = table.select("conv_id").distinct()
    for part in (found.conversations, digests):
        part = part.withColumnRenamed("conv_id", "_conv")
        result = result.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return result.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(_sha256(""))).alias("repaired_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations are rebuilt to share first turns in groups of five, then their trie is made."""
    table = read_table(spark, folder, "conversations").where("conv_id is not null")
    table = table.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = [F.col("turn"), F.col("role"), F.substring("text", 1, 64), F.sha2("text", 256)]
    scratch = Scratch(spark, "rebuilt")
    placed = positions(table, "conv_id", order, scratch)
    taken = F.crc32(F.col("conv_id").cast("string")) % 9
    members = table.select("conv_id").distinct().withColumn("h", taken).withColumn("base", F.expr("conv_id - conv_id % 5"))
    # no conversation takes more than 8 turns, and at most nine conversations take from one
    first = placed.where("at < 8").select(F.col("conv_id").alias("base"), "at", "role", "text")
    shared = members.where("h > 0").join(first, "base").where("at < h").select("conv_id", "at", "role", "text")
    lent = shared.groupBy("conv_id").agg(F.count("*").alias("lent"))
    own = placed.where(F.col("at") >= taken).join(scratch.save(lent), "conv_id", "left")
    own = own.select("conv_id", (F.col("at") - taken + F.coalesce("lent", F.lit(0))).alias("at"), "role", "text")
    found = prefix_trie.prefix_trie(shared.unionByName(own), members.select("conv_id"))
    names = found.ends.select("owner", "depth", "conv_id", F.col("conv_id").cast("string").alias("name"))
    digests = sorted_digests(names, ["owner", "depth"], ["conv_id"], "name", ",").withColumnRenamed("owner", "conv_id")
    counts = ["n_convs", "n_children", "n_leaves"]
    return found.nodes.join(digests, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        *counts,
        F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.lit(_sha256(""))).alias("ends_sha256"),
    )


# What a document must reach to be kept as good text.
QUALITY_CUT = 0.3


def op13_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of four fifths of the documents teach the model, which scores all of them."""
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = gam.score(docs, gam.fit(docs, labels.where(~held_out)))
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_substrings": op2_substrings,
    "op3_licenses": op3_licenses,
    "op4_outliers": op4_outliers,
    "op5_decontaminate": op5_decontaminate,
    "op6_lm_score": op6_lm_score,
    "op7_language": op7_language,
    "op8_chat": op8_chat,
    "op9_near_dups": op9_near_dups,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_turn_repair": op11_turn_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_gam": op13_quality_gam,
}
