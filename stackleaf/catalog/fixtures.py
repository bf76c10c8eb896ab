"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackleaf.functions import keys
from stackleaf.functions import text as tx
from stackleaf.operators import structure
from stackleaf.plans.settings import Settings
from stackleaf.sources.tables import read_table, spread, work_folder

# The test texts have no blank lines and are short, so the queries split at
# single newlines and use a small cap; both are ordinary parameters.
LINES = r"\n+"
CAP = 64
CONFIG = Settings().fingerprint()
OTHER_CONFIG = "000000000000"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """``path, content, seq``: every document as a file, with four suffixes."""
    ending = (
        F.when(F.col("doc_id") % 4 == 0, ".txt")
        .when(F.col("doc_id") % 4 == 1, ".md")
        .when(F.col("doc_id") % 4 == 2, ".PDF")
        .otherwise(".docx")
    )
    return documents(spark, sf).select(
        F.concat(
            F.lit("/lake/"), "source", F.lit("/Doc "), F.col("doc_id").cast("string"),
            F.lit("-v1"), ending,
        ).alias("path"),
        F.col("text").cast("binary").alias("content"),
        F.col("doc_id").alias("seq"),
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, idx, text``: every line of every document."""
    return documents(spark, sf).select(
        "doc_id", F.posexplode(tx.paragraphs(F.col("text"), LINES)).alias("idx", "text")
    )


def outline(spark: SparkSession, sf: str) -> DataFrame:
    """``doc, idx, heading``: the suppliers as numbered outlines, three levels
    deep, in four variants (in order; locally shuffled; with unnumbered
    headings; with blanks)."""
    k = F.col("s_suppkey")
    chapter, section, item = k / 100, (k / 10).cast("bigint") % 10, k % 10
    chapter = F.floor(chapter) + 1
    name = F.col("s_name")
    rows = read_table(spark, sf, "supplier").select(
        F.explode(
            F.filter(
                F.array(
                    F.struct(
                        (k * 3).alias("at"),
                        F.when(k % 100 == 0, F.concat_ws(" ", chapter.cast("string"), name)).alias("h"),
                    ),
                    F.struct(
                        (k * 3 + 1).alias("at"),
                        F.when(
                            k % 10 == 0,
                            F.concat_ws(" ", F.concat_ws(".", chapter.cast("string"), (section + 1).cast("string")), name),
                        ).alias("h"),
                    ),
                    F.struct(
                        (k * 3 + 2).alias("at"),
                        F.concat_ws(
                            " ",
                            F.concat_ws(
                                ".", chapter.cast("string"), (section + 1).cast("string"), (item + 1).cast("string")
                            ),
                            name,
                        ).alias("h"),
                    ),
                ),
                lambda r: r["h"].isNotNull(),
            )
        ).alias("r")
    ).select(F.col("r.at").alias("at"), F.col("r.h").alias("h"))
    at, h = F.col("at"), F.col("h")
    variants = F.array(
        F.struct(F.lit("plain").alias("doc"), at.alias("idx"), h.alias("heading")),
        F.struct(F.lit("mixed").alias("doc"), (F.floor(at / 8) * 8 + (at * 5) % 8).alias("idx"), h.alias("heading")),
        F.struct(
            F.lit("front").alias("doc"),
            at.alias("idx"),
            F.when(at % 7 == 3, F.when(at % 2 == 0, "Preface").otherwise("Contents")).otherwise(h).alias("heading"),
        ),
        F.struct(F.lit("gaps").alias("doc"), at.alias("idx"), F.when(at % 5 == 4, "").otherwise(h).alias("heading")),
    )
    return rows.select(F.explode(variants).alias("v")).select("v.doc", "v.idx", "v.heading")


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, markdown``: headings, list items and paragraphs of the pages,
    with a numbered sub-heading ahead of every third part."""
    pattern = r"(?s)<(h1|li|p)>(.*?)</(?:h1|li|p)>"
    tags = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all("html", F.lit(pattern), F.lit(2))

    def part(x, i):
        plain = F.trim(F.regexp_replace(F.regexp_replace(x["body"], r"<[^>]+>", " "), r"\s+", " "))
        return (
            F.when(x["tag"] == "h1", F.concat(F.lit("# 1 "), plain))
            .when(x["tag"] == "li", F.concat(F.lit("- "), plain))
            .when(i % 3 == 0, F.concat(F.lit("## 1."), i.cast("string"), F.lit(" Part\n\n"), plain))
            .otherwise(plain)
        )

    pairs = F.arrays_zip(tags.alias("tag"), bodies.alias("body"))
    return spread(read_table(spark, sf, "pages")).select(
        "page_id", F.array_join(F.transform(pairs, part), "\n\n").alias("markdown")
    )


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, markdown, blocks``: ten blocks to a page number."""
    blocks = structure.blocks_from_markdown(F.col("markdown"))
    return markdown(spark, sf).withColumn(
        "blocks",
        F.transform(
            blocks, lambda b: b.withField("page_no", (F.floor(b["idx"] / 10) + 1).cast("int"))
        ),
    )


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """``side, seq, filename, content_hash, pipeline_config_hash, text``. The
    lower half of the documents was there before. Each of the upper half is an
    edit of one of them, a new file, or an unchanged second arrival."""
    docs = documents(spark, sf).select("doc_id", "text")
    half = (read_table(spark, sf, "documents").agg(F.max("doc_id")).first()[0] + 1) // 2
    old = docs.where(F.col("doc_id") < half).select(
        F.lit("current").alias("side"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        "text",
    )
    new = docs.where(F.col("doc_id") >= half).withColumn("pair", F.col("doc_id") - half)
    before = docs.select(F.col("doc_id").alias("pair"), F.col("text").alias("old_text"))
    kind = F.col("doc_id") % 3
    incoming = new.join(before, "pair").select(
        F.lit("incoming").alias("side"),
        F.col("doc_id").alias("seq"),
        F.when(kind == 1, F.concat(F.lit("g"), F.col("doc_id").cast("string"), F.lit(".txt")))
        .otherwise(F.concat(F.lit("f"), F.col("pair").cast("string"), F.lit(".txt")))
        .alias("filename"),
        F.when(kind == 2, F.col("old_text")).otherwise(F.col("text")).alias("text"),
    )
    return old.unionByName(incoming).select(
        "side",
        "seq",
        "filename",
        F.sha2("text", 256).alias("content_hash"),
        F.lit(CONFIG).alias("pipeline_config_hash"),
        "text",
    )


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, as a ledger or a chunk store
    would be; queries then read it as often as they need."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ledger_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(live entries, incoming files): tables of keys."""
    from stackleaf.operators import ledger as lg

    both = saved(arrivals(spark, sf).drop("text"), "arrivals")
    none = both.where(F.lit(False)).drop("side")
    live = lg.swap(none, both.where(F.col("side") == "current").drop("side")).live
    return saved(live, "live"), both.where(F.col("side") == "incoming").drop("side")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk table around the embeddings: one chunk per vector."""
    docs = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"), "text", "lang", "source"
    )
    label = F.col("label")
    number = (label + 1).cast("string")
    contents = label == 0
    rows = read_table(spark, sf, "embeddings").join(docs, "vec_id", "left")
    parent = F.when(contents, "").otherwise(F.concat(number, F.lit(" S")))
    path = F.when(contents, "Contents").otherwise(
        F.concat(number, F.lit(" S => "), number, F.lit(".1 T"))
    )
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.sha2(text, 256).alias("content_hash"),
        F.concat(F.lit("f"), F.col("vec_id").cast("string"), F.lit(".txt")).alias("filename"),
        path.alias("headings"),
        parent.alias("parent_headings"),
        F.concat_ws(" ", "lang", "source").alias("summary"),
        F.when(label == 3, "").otherwise(text).alias("raw_text"),
        F.concat_ws("\n", path, text).alias("page_content"),
        label.alias("chunk_index"),
        F.lit(10).alias("total_chunks"),
        F.concat_ws(",", label.cast("string"), number).alias("page_numbers"),
        F.when(label % 2 == 0, F.lit(CONFIG)).otherwise(F.lit(OTHER_CONFIG)).alias(
            "pipeline_config_hash"
        ),
        "embedding",
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a question."""
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("What is near "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"),
        "embedding",
    )


def replies_(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, text, reply``: model replies in five forms, one of them failed."""
    form = F.col("doc_id") % 5
    return documents(spark, sf).select(
        "doc_id",
        "text",
        F.when(form == 0, F.col("text"))
        .when(form == 1, F.concat(F.lit("# Summary\n\n"), "text"))
        .when(form == 2, F.concat(F.lit("**Summary:** "), "text"))
        .when(form == 3, F.concat(F.lit("Summary: "), "text"))
        .alias("reply"),
    )


def packed(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents, plain packing."""
    from stackleaf.operators import chunking

    docs = documents(spark, sf).select(
        "doc_id", "text", keys.content_hash(F.col("text").cast("binary")).alias("content_hash")
    )
    return chunking.pack_documents(
        docs, keep=["doc_id", "content_hash"], text="text", cap=CAP, separator=LINES
    )
