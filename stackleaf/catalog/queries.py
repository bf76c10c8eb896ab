"""The registered queries: name -> function of (session, table folder)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackleaf.catalog import fixtures as fx
from stackleaf.functions import headings as hd
from stackleaf.functions import keys, replies
from stackleaf.functions import text as tx
from stackleaf.operators import ann, blocked, chunking, enrich, ordered, prompts, structure
from stackleaf.operators import ledger as lg
from stackleaf.operators import retrieve as rt
from stackleaf.plans import settings as st
from stackleaf.plans.ask import Answering, embedded
from stackleaf.plans.ingest import Ingest
from stackleaf.plans.rechunk import rechunk
from stackleaf.sources import files as fl
from stackleaf.sources import store
from stackleaf.sources.snapshots import SharedLedger
from stackleaf.sources.tables import read_table, small_side, work_folder
from stackleaf.sources.vector_index import IndexSettings, VectorIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources -------------------------------------------------------------------


@query
def scan_supported(spark, sf):
    files = fx.files(spark, sf)
    return files.where(fl.supported(F.col("path"))).select(
        "path", keys.suffix(F.col("path")).alias("suffix")
    )


@query
def scan_paths(spark, sf):
    names = ("documents", "pages", "embeddings")
    found = fl.scan_paths(spark, [f"{sf}/{n}.parquet" for n in names])
    return found.select(
        keys.filename(F.col("path")).alias("filename"),
        "length",
        keys.content_hash(F.col("content")).alias("content_hash"),
        fl.route(F.col("path")).isNull().alias("rejected"),
    )


@query
def content_type(spark, sf):
    pages = read_table(spark, sf, "pages")
    sources = (
        fx.files(spark, sf)
        .select("path")
        .union(pages.select("url"))
        .union(pages.select(F.concat(F.lit("https://youtu.be/"), F.col("page_id").cast("string"))))
    )
    return sources.select("path", fl.content_type(F.col("path")).alias("content_type"))


def _utf8_parser():
    return lambda content, path: (content.decode("utf-8"), None)


def _parsed_files(spark, sf):
    return fl.parse_files(fx.files(spark, sf), document_parser=_utf8_parser, parser_name="custom")


@query
def route_rejects(spark, sf):
    return _parsed_files(spark, sf).where(F.col("reason").isNotNull()).select(
        "source_path", "content_hash", "reason"
    )


@query
def parse_custom(spark, sf):
    return _parsed_files(spark, sf).where(F.col("reason").isNull()).select(
        "source_path", "filename", "content_type", "parser", "content_hash", "doc_key",
        F.length("markdown").cast("bigint").alias("chars"),
    )


@query
def decode_text(spark, sf):
    text = fl.decode(F.col("content"))
    return fx.files(spark, sf).select("path", text.alias("markdown"))


@query
def short_rejects(spark, sf):
    cleaned = tx.clean(F.col("text"))
    return fx.documents(spark, sf).where(fl.too_short(cleaned)).select(
        "doc_id", F.length(cleaned).cast("bigint").alias("chars")
    )


# --- keys ----------------------------------------------------------------------


@query
def content_hash(spark, sf):
    return fx.files(spark, sf).select("path", keys.content_hash(F.col("content")).alias("content_hash"))


@query
def config_fingerprint(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        st.fingerprint(chunk_max_tokens=F.col("n_chars"), parser=F.col("source")).alias("config"),
        st.fingerprint().alias("default_config"),
    )


@query
def doc_key(spark, sf):
    path, digest = F.col("path"), keys.content_hash(F.col("content"))
    return fx.files(spark, sf).select(
        "path",
        keys.filename(path).alias("filename"),
        keys.stem(path).alias("stem"),
        keys.doc_key(path, digest, F.lit("plaintext")).alias("doc_key"),
    )


@query
def chunk_ids(spark, sf):
    config = F.lit(fx.CONFIG)
    chunk = keys.chunk_id(F.col("text"))
    return fx.packed(spark, sf).select(
        "doc_id",
        "chunk_index",
        keys.registry_key(F.col("content_hash"), config).alias("registry_key"),
        chunk.alias("chunk_id"),
        keys.object_key(config, F.col("content_hash"), chunk).alias("object_key"),
    )


@query
def binary_hash(spark, sf):
    digest = F.sha2("text", 256)
    return read_table(spark, sf, "documents").select(
        "doc_id", keys.binary_hash(digest).alias("binary_hash")
    )


@query
def page_codec(spark, sf):
    last = (F.floor(F.col("n_chars") / 1800) + 1).cast("int")
    pages = F.when(F.col("n_chars") < 500, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(1), last)
    )
    stored = read_table(spark, sf, "documents").select(
        "doc_id", keys.encode_pages(pages).alias("page_numbers")
    )
    decoded = keys.decode_pages(F.col("page_numbers"))
    return stored.select(
        "doc_id",
        "page_numbers",
        F.size(decoded).cast("bigint").alias("pages"),
        F.aggregate(decoded, F.lit(0), lambda a, x: a + x).cast("bigint").alias("page_sum"),
    )


# --- text ----------------------------------------------------------------------


@query
def clean_text(spark, sf):
    spaced = F.concat(F.lit(" \n\n"), F.regexp_replace("text", r"\n", "\n\n\n\n"), F.lit("\n "))
    return fx.documents(spark, sf).select("doc_id", tx.clean(spaced).alias("cleaned"))


@query
def paragraphs(spark, sf):
    return fx.segments(spark, sf).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "text")


@query
def token_counts(spark, sf):
    return fx.segments(spark, sf).select(
        "doc_id", F.col("idx").cast("bigint").alias("idx"),
        tx.words(F.col("text")).cast("bigint").alias("tokens"),
    )


@query
def pack_paragraphs(spark, sf):
    packed = fx.packed(spark, sf).where(F.col("kind") == chunking.PARAGRAPH)
    return packed.select("doc_id", "chunk_index", "total_chunks", "text")


@query
def pack_sentences(spark, sf):
    packed = fx.packed(spark, sf).where(F.col("kind") == chunking.SENTENCE)
    return packed.select("doc_id", "chunk_index", "total_chunks", "text")


@query
def chunk_index(spark, sf):
    lines = fx.segments(spark, sf).withColumnRenamed("idx", "line")
    return chunking.number_chunks(lines, ["doc_id"], "line").select(
        "doc_id", "line", "chunk_index", "total_chunks"
    )


@query
def dedup_chunks(spark, sf):
    chunks = fx.packed(spark, sf).select(
        "doc_id",
        F.concat(F.col("doc_id").cast("string"), F.lit("_"), "content_hash").alias("content_hash"),
        F.lit(fx.CONFIG).alias("pipeline_config_hash"),
        keys.chunk_id(F.col("text")).alias("chunk_id"),
        "chunk_index",
    )
    return chunking.dedup_chunks(chunks).select("doc_id", "chunk_id", "chunk_index")


# --- structure -----------------------------------------------------------------


@query
def heading_numbers(spark, sf):
    lines = fx.segments(spark, sf).select(
        F.col("doc_id").cast("string").alias("doc"), F.col("idx").cast("bigint").alias("idx"),
        F.col("text").alias("heading"),
    )
    number = hd.section_number(F.col("heading"))
    return (
        fx.outline(spark, sf)
        .unionByName(lines)
        .withColumn("number", number)
        .select(
            "doc",
            "idx",
            "number",
            hd.heading_level(F.col("number")).cast("bigint").alias("level"),
            F.array_join(hd.ancestor_numbers(F.col("number")), ",").alias("ancestors"),
        )
    )


@query
def heading_paths(spark, sf):
    paths = ordered.heading_paths(fx.outline(spark, sf), ["doc"], "idx", "heading")
    return paths.select(
        "doc", "idx", hd.path(F.col("path")).alias("path"),
        hd.parent_path(F.col("path")).alias("parent_path"),
    )


@query
def heading_carry(spark, sf):
    rows = fx.outline(spark, sf)
    paths = ordered.heading_paths(rows, ["doc"], "idx", "heading")
    known = rows.join(paths.select("doc", "idx", hd.path(F.col("path")).alias("own")), ["doc", "idx"], "left")
    return ordered.carry_forward(known, ["doc"], "idx", F.col("own"), "path").select(
        "doc", "idx", F.coalesce("path", F.lit("")).alias("path")
    )


def _structured(spark, sf, **options):
    return structure.chunk_blocks(
        fx.page_blocks(spark, sf), keep=["page_id"], cap=fx.CAP, **options
    )


_STRUCTURE_COLUMNS = ["page_id", "chunk_index", "total_chunks", "text", "headings", "parent_headings"]


@query
def structure_chunks(spark, sf):
    return _structured(spark, sf).select(*_STRUCTURE_COLUMNS)


@query
def merge_peers(spark, sf):
    return _structured(spark, sf, merge_peers=False).select(*_STRUCTURE_COLUMNS)


@query
def contextualize(spark, sf):
    return _structured(spark, sf).select("page_id", "chunk_index", "enriched_text")


@query
def page_span(spark, sf):
    return _structured(spark, sf).select(
        "page_id", "chunk_index", keys.encode_pages(F.col("page_numbers")).alias("page_numbers")
    )


@query
def merge_list_items(spark, sf):
    """Blocks as saved rows: the ordered scans read their input more than once,
    so it should be a table, not a parse."""
    parsed = fx.page_blocks(spark, sf).select("page_id", F.explode("blocks").alias("b")).select(
        "page_id", "b.idx", "b.kind", "b.text"
    )
    return structure.merge_list_rows(
        fx.saved(parsed, "blocks"), ["page_id"], "idx", "kind", "text"
    ).select(
        "page_id", F.col("unit").cast("bigint").alias("unit"), "kind", "items", "text"
    )


@query
def rechunk_from_parsed(spark, sf):
    """Save parses (every second one without blocks), read back, chunk again."""
    corpus = store.Corpus(spark, work_folder(spark, "rechunk")).create()
    pages = fx.page_blocks(spark, sf)
    bare = F.transform(
        "blocks", lambda b: b.withField("page_no", F.lit(None).cast("int"))
    )
    parsed = pages.select(
        F.col("page_id").cast("string").alias("source_path"),
        F.col("page_id").cast("string").alias("filename"),
        F.sha2("markdown", 256).alias("content_hash"),
        F.lit("md").alias("content_type"),
        F.lit("plaintext").alias("parser"),
        "markdown",
        F.when(F.col("page_id") % 2 == 0, bare).alias("blocks"),
        F.col("page_id").cast("string").alias("doc_key"),
        F.lit(None).cast("string").alias("reason"),
    )
    corpus.write_parsed(parsed, 1)
    saved = corpus.parsed().withColumn(
        "blocks", structure.saved_blocks(F.col("blocks"), F.col("markdown"))
    )
    again = structure.chunk_blocks(saved, keep=["filename"], cap=fx.CAP)
    return again.select(
        F.col("filename").cast("bigint").alias("page_id"), *_STRUCTURE_COLUMNS[1:]
    )


# --- sinks ---------------------------------------------------------------------


def _stored(spark, sf) -> DataFrame:
    """Packed chunks in the stored form, under two configs."""
    chunks = chunking.plain_chunks(fx.packed(spark, sf)).select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        "content_hash", "chunk_index", "total_chunks", "text", "enriched_text", "headings",
        "parent_headings", F.lit("").alias("summary"), "page_numbers",
    )
    one = store.chunk_records(chunks, fx.CONFIG)
    two = store.chunk_records(chunks, fx.OTHER_CONFIG)
    return one.unionByName(two)


@query
def chunks_json_roundtrip(spark, sf):
    path = work_folder(spark, "chunks-json")
    chunks = _stored(spark, sf)
    store.write_chunks_json(chunks, path)
    back = spark.read.schema(chunks.schema).json(path)
    return back.where(F.col("pipeline_config_hash") == fx.CONFIG).select(
        "filename", "content_hash", "chunk_id", "chunk_index", "total_chunks", "text"
    )


def _saved_corpus(spark, sf, name) -> store.Corpus:
    corpus = store.Corpus(spark, work_folder(spark, name)).create()
    stored = _stored(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>"))
    corpus.write_chunks(stored, 1)
    return corpus


@query
def chunk_store_roundtrip(spark, sf):
    back = store.sidecar(
        _saved_corpus(spark, sf, "chunk-store").all_chunks().where(
            F.col("pipeline_config_hash") == fx.CONFIG
        )
    )
    return back.select("object_key", "metadata.*").select(
        "object_key", "raw_text", "filename", "content_hash", "chunk_id", "chunk_index",
        "total_chunks", "page_numbers",
    )


@query
def config_scope(spark, sf):
    corpus = _saved_corpus(spark, sf, "config-scope")
    return lg.prune(corpus.all_chunks(), fx.OTHER_CONFIG).select(
        "filename", "pipeline_config_hash", "chunk_id", "chunk_index", "binary_hash"
    )


@query
def prune_configs(spark, sf):
    corpus = _saved_corpus(spark, sf, "prune")
    live = corpus.all_chunks().groupBy("content_hash", "pipeline_config_hash").agg(
        F.min("filename").alias("filename"), F.max("total_chunks").alias("chunk_count")
    )
    events = live.select(
        F.lit(3).cast("bigint").alias("seq"), F.lit("register").alias("op"), "filename",
        F.col("filename").alias("source_path"), "content_hash", "pipeline_config_hash",
        F.lit("plaintext").alias("parser"), F.lit(None).cast("timestamp").alias("ingested_at"),
        "chunk_count",
    )
    corpus.append_events(events, 1)
    pruned = corpus.compact_to(work_folder(spark, "pruned"), configs=[fx.CONFIG])
    return pruned.all_chunks().groupBy("pipeline_config_hash").agg(
        F.count("*").alias("chunks"), F.countDistinct("content_hash").alias("documents")
    )


@query
def ingest_report(spark, sf):
    chunks = fx.packed(spark, sf).withColumn(
        "filename", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt"))
    )
    return store.ingest_report(chunks)


# --- ledger --------------------------------------------------------------------


@query
def ledger_current(spark, sf):
    """Each document registers its hash under one of two configs; documents
    labelled toxic are deleted again. Copies make upserts."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    entry = [
        "content_hash",
        F.when(F.col("doc_id") % 2 == 0, fx.CONFIG).otherwise(fx.OTHER_CONFIG).alias("pipeline_config_hash"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.concat(F.lit("/lake/f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"),
        F.lit("plaintext").alias("parser"),
        F.lit(None).cast("timestamp").alias("ingested_at"),
        F.lit(1).alias("chunk_count"),
    ]
    toxic = read_table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    events = docs.select((F.col("doc_id") * 2).alias("seq"), F.lit("register").alias("op"), *entry).unionByName(
        docs.join(toxic, "doc_id").select((F.col("doc_id") * 2 + 1).alias("seq"), F.lit("delete").alias("op"), *entry)
    )
    return lg.entries(events).drop("ingested_at")


@query
def skip_ingested(spark, sf):
    live, incoming = fx.ledger_sides(spark, sf)
    return lg.skip_known(incoming, live).select("filename", "content_hash")


@query
def ledger_lookup(spark, sf):
    live, incoming = fx.ledger_sides(spark, sf)
    return lg.lookup(incoming, live).select("content_hash", "filename")


@query
def ledger_insert_new(spark, sf):
    live, incoming = fx.ledger_sides(spark, sf)
    fresh, conflicts = lg.insert_new(live, incoming)
    return fresh.select("filename", "content_hash", F.lit("insert").alias("outcome")).unionByName(
        conflicts.select("filename", "content_hash", F.lit("conflict").alias("outcome"))
    )


@query
def find_superseded(spark, sf):
    live, incoming = fx.ledger_sides(spark, sf)
    return lg.find_superseded(live, incoming).select("filename", "content_hash")


@query
def supersede_snapshot(spark, sf):
    return lg.swap(*fx.ledger_sides(spark, sf)).live.select("filename", "content_hash")


@query
def supersede_events(spark, sf):
    change = lg.swap(*fx.ledger_sides(spark, sf))
    return change.evicted.select(F.lit("delete").alias("op"), "filename", "content_hash").unionByName(
        change.registered.select(F.lit("register").alias("op"), "filename", "content_hash")
    )


@query
def compact_chunks(spark, sf):
    """Chunks of the documents, less those of versions that are not live."""
    live = fx.saved(lg.swap(*fx.ledger_sides(spark, sf)).live, "live-after")
    chunks = fx.packed(spark, sf).select(
        "doc_id", "content_hash", F.lit(fx.CONFIG).alias("pipeline_config_hash"), "chunk_index",
        keys.chunk_id(F.col("text")).alias("chunk_id"),
    )
    return lg.compact(fx.saved(chunks, "chunks"), live).select("doc_id", "chunk_index", "chunk_id")


def _plain_ingest() -> Ingest:
    return Ingest(
        settings=st.Settings(chunker="plain", chunk_max_tokens=fx.CAP), separator=fx.LINES, dims=64
    )


def _as_files(arrivals: DataFrame) -> DataFrame:
    return arrivals.select(
        F.concat(F.lit("/lake/"), "filename").alias("path"),
        F.col("text").cast("binary").alias("content"),
        "seq",
    )


_CHUNK_KEYS = ["filename", "content_hash", "chunk_id", "chunk_index", "total_chunks"]


@query
def ingest_batch(spark, sf):
    """Two batches through the whole job; the searchable chunks at the end."""
    ingest = _plain_ingest()
    corpus = store.Corpus(spark, work_folder(spark, "ingest")).create()
    arrivals = fx.arrivals(spark, sf)
    for number, side in enumerate(("current", "incoming"), start=1):
        ingest.run(corpus, _as_files(arrivals.where(F.col("side") == side)), number)
    return corpus.chunks(ingest.settings.fingerprint()).select(*_CHUNK_KEYS)


@query
def stream_ingest(spark, sf):
    """The same two batches as a stream: files land, the stream catches up,
    more files land, the stream takes only those."""
    from stackleaf.streaming import watch

    ingest = _plain_ingest()
    root = work_folder(spark, "stream")
    corpus = store.Corpus(spark, f"{root}/corpus").create()
    arrivals = fx.arrivals(spark, sf)
    schema = _as_files(arrivals).schema
    for side in ("current", "incoming"):
        _as_files(arrivals.where(F.col("side") == side)).write.mode("append").parquet(f"{root}/landing")
        landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10_000).parquet(f"{root}/landing")
        run = watch.start(landed, corpus, ingest, f"{root}/checkpoint")
        run.awaitTermination()
    return lg.current(corpus.events()).select("filename", "content_hash", "chunk_count")


# --- model calls ---------------------------------------------------------------


@query
def summarize_default(spark, sf):
    chunks = fx.packed(spark, sf)
    return enrich.summarize(chunks).select("doc_id", "chunk_index", "summary")


@query
def clean_summary(spark, sf):
    return fx.replies_(spark, sf).where(F.col("reply").isNotNull()).select(
        "doc_id", replies.clean_summary(F.col("reply")).alias("summary")
    )


@query
def summary_fallback(spark, sf):
    return fx.replies_(spark, sf).select(
        "doc_id", replies.summary_or_fallback(F.col("reply"), F.col("text")).alias("summary")
    )


@query
def structured_reply(spark, sf):
    form = F.col("doc_id") % 3
    reply = (
        F.when(form == 0, F.to_json(F.struct(F.col("text").alias("summary"))))
        .when(form == 1, F.to_json(F.struct(F.col("text").alias("other"))))
        .otherwise(F.col("text"))
    )
    return fx.documents(spark, sf).select("doc_id", replies.structured_field(reply).alias("summary"))


def _counting_client():
    """Stand-in client: replies with the number of words, fails without any
    full stop. Deterministic, so that SQL can repeat it."""

    class Client:
        def complete(self, system, user, max_tokens):
            if "." not in user:
                raise ValueError("no sentence")
            return f"Summary: {len(user.split())} words"

    return Client()


@query
def summarize_client(spark, sf):
    """Summaries through the client harness: each distinct text is sent once,
    replies are cleaned, failures fall back to the start of the text."""
    return enrich.summarize(fx.packed(spark, sf), _counting_client).select(
        "doc_id", "chunk_index", "summary", F.col("summary_error").isNotNull().alias("failed")
    )


@query
def embed_hashing(spark, sf):
    """Properties of the default embedding: size, length one, and the word
    count that goes into it."""
    vectors = enrich.hashing_embed(fx.documents(spark, sf), 64, text="text")
    square = F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    return vectors.select(
        "doc_id",
        F.size("embedding").cast("bigint").alias("dims"),
        (F.round(F.sqrt(square), 4) + F.lit(0.0)).alias("norm"),
    )


# --- retrieval -----------------------------------------------------------------


def _top(metric):
    def run(spark, sf):
        hits = rt.top_k(fx.chunks(spark, sf), fx.questions(spark, sf), metric=metric, digits=6)
        return hits.select("query_id", "rank", "chunk_id", "score")

    run.__name__ = f"topk_{metric}"
    return run


for _metric in ("cosine", "l2", "ip"):
    query(_top(_metric))


@query
def topk_prefilter(spark, sf):
    hits = rt.top_k_prefiltered(fx.chunks(spark, sf), fx.questions(spark, sf), digits=6)
    return hits.select("query_id", "rank", "chunk_id", "score")


@query
def topk_postfilter(spark, sf):
    hits = rt.top_k_postfiltered(
        fx.chunks(spark, sf), fx.questions(spark, sf), config=fx.CONFIG, digits=6
    )
    return hits.select("query_id", "rank", "chunk_id", "score")


def _hits(spark, sf) -> DataFrame:
    chunks, questions = fx.chunks(spark, sf), fx.questions(spark, sf)
    return rt.attach(
        rt.top_k_prefiltered(chunks, questions, digits=6),
        chunks,
        ["headings", "parent_headings", "summary", "raw_text", "page_content"],
        max_rows=questions.count() * rt.DEFAULT_K,
    )


@query
def hit_projection(spark, sf):
    return rt.project_hits(_hits(spark, sf))


@query
def hit_citations(spark, sf):
    chunks, questions = fx.chunks(spark, sf), fx.questions(spark, sf)
    hits = rt.attach(
        rt.top_k_prefiltered(chunks, questions, digits=6),
        chunks,
        ["filename", "content_hash", "chunk_index", "total_chunks", "page_numbers"],
        max_rows=questions.count() * rt.DEFAULT_K,
    )
    return rt.cite_hits(hits).withColumn("page_numbers", keys.encode_pages(F.col("page_numbers")))


@query
def format_hits(spark, sf):
    return prompts.format_hits(rt.project_hits(_hits(spark, sf)))


def _prompts(spark, sf):
    results = prompts.format_hits(rt.project_hits(_hits(spark, sf)))
    return prompts.build_prompts(fx.questions(spark, sf).select("query_id", "question"), results)


@query
def prompt_build(spark, sf):
    return _prompts(spark, sf)


def _echo_client():
    """Stand-in client: the reply is the SHA-256 of the prompt."""

    class Client:
        def complete(self, system, user, max_tokens):
            return hashlib.sha256(user.encode()).hexdigest()

    return Client()


@query
def answer_batch(spark, sf):
    return enrich.answer(_prompts(spark, sf), _echo_client, prompts.SYSTEM).select(
        "query_id", "answer"
    )


def _index(spark, sf, nlist=16):
    chunks = fx.chunks(spark, sf).select("chunk_id", "embedding")
    clusters = ann.train(chunks, nlist=nlist, max_iter=5)
    return chunks, clusters, clusters.assign(chunks)


@query
def ivf_flat(spark, sf):
    """All clusters probed: equals the exact search."""
    _, clusters, index = _index(spark, sf)
    hits = ann.ivf_search(index, clusters, fx.questions(spark, sf), nprobe=16, digits=6)
    return hits.select("query_id", "rank", "chunk_id", "score")


@query
def ivf_sq8(spark, sf):
    chunks, clusters, assigned = _index(spark, sf)
    codec = ann.ByteCodec.fit(chunks)
    index = ann.sq8_index(assigned, codec)
    hits = ann.sq8_search(index, codec, clusters, fx.questions(spark, sf), chunks, nprobe=16, digits=6)
    return hits.select("query_id", "rank", "chunk_id", "score")


@query
def ivf_pq(spark, sf):
    chunks, clusters, assigned = _index(spark, sf)
    codec = ann.ProductCodec.fit(chunks, parts=8, codes=16, max_iter=5)
    index = ann.pq_index(assigned, codec)
    hits = ann.pq_search(index, codec, clusters, fx.questions(spark, sf), chunks, nprobe=16, digits=6)
    return hits.select("query_id", "rank", "chunk_id", "score")


@query
def topk_blocked(spark, sf):
    """Every vector whose id is divisible by 20, as a table of questions that never
    passes through the driver; the cells are small, so that there are several."""
    questions = fx.questions(spark, sf).where("query_id % 20 = 0").select("query_id", "embedding")
    vectors = fx.chunks(spark, sf).select("chunk_id", "embedding")
    hits = blocked.top_k_blocked(vectors, questions, rt.DEFAULT_K, digits=6, cell_bytes=1 << 16)
    return hits.select("query_id", "rank", "chunk_id", "score")


@query
def topk_postfill(spark, sf):
    """The post-filter that goes on until each question has its hits."""
    hits = rt.top_k_postfiltered(
        fx.chunks(spark, sf), fx.questions(spark, sf), config=fx.CONFIG, digits=6, fill=True
    )
    return hits.select("query_id", "rank", "chunk_id", "score")


def _stored_index(spark, sf, settings, name):
    """All vectors in a stored index: even ids train it, odd ones arrive as a second batch."""
    chunks = fx.chunks(spark, sf).select(
        "content_hash", "chunk_id", "pipeline_config_hash", "headings", "embedding",
        (F.substring("chunk_id", 2, 20).cast("bigint") % 2 + 1).alias("batch_id"),
    )
    rows = fx.saved(chunks, name)
    folder = work_folder(spark, name)
    VectorIndex(spark, folder).create().build(rows.where("batch_id = 1"), settings)
    VectorIndex(spark, folder).add(rows.where("batch_id = 2"))
    return VectorIndex(spark, folder)


def _twentieth(spark, sf):
    return fx.questions(spark, sf).where("query_id % 20 = 0").select("query_id", "embedding")


@query
def index_search(spark, sf):
    """A stored index after two batches, all clusters probed: equals the exact search."""
    index = _stored_index(spark, sf, IndexSettings(nlist=16), "index-search")
    hits = index.search(_twentieth(spark, sf), nprobe=16, digits=6)
    return hits.select("query_id", "rank", "chunk_id", "score")


@query
def index_search_sq8(spark, sf):
    """The same with codes; ten hits of forty candidates are those of the exact search
    for at least nine in ten places."""
    index = _stored_index(spark, sf, IndexSettings(kind="sq8", nlist=16), "index-sq8")
    return _recall(spark, sf, index.search(_twentieth(spark, sf), nprobe=16))


@query
def index_recall(spark, sf):
    """Twelve of 16 clusters probed: at least nine in ten of the exact hits are found."""
    index = _stored_index(spark, sf, IndexSettings(nlist=16), "index-recall")
    return _recall(spark, sf, index.search(_twentieth(spark, sf), nprobe=12))


def _recall(spark, sf, hits):
    named = fx.chunks(spark, sf).select(F.concat_ws("_", "content_hash", "chunk_id").alias("chunk_id"), "embedding")
    exact = rt.top_k(named, _twentieth(spark, sf)).select("query_id", "chunk_id")
    found = exact.join(hits.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return found.agg(
        F.count("*").alias("wanted"), (F.count("hit") >= F.count("*") * 0.9).alias("recall_reached")
    )


def _letter_counts():
    """Stand-in embedding model that SQL can repeat: how often each letter occurs."""
    return lambda texts: [[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def _document_corpus(spark, sf, name):
    """Every distinct text as one chunk of a stored corpus, embedded by letters."""
    docs = fx.documents(spark, sf).where("text IS NOT NULL")
    one = docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(
        F.concat(F.lit("f"), F.min("doc_id").cast("string")).alias("filename"), F.first("text").alias("text")
    )
    none = F.lit("")
    records = one.select(
        "content_hash", F.lit("t").alias("chunk_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"),
        "filename", "text", F.col("text").alias("enriched_text"), none.alias("headings"), none.alias("parent_headings"),
        none.alias("summary"), none.alias("page_numbers"), keys.binary_hash(F.col("content_hash")).alias("binary_hash"),
        F.lit(fx.CONFIG).alias("pipeline_config_hash"),
    )
    corpus = store.Corpus(spark, work_folder(spark, name)).create()
    records = enrich.embed(records, _letter_counts, once=False).withColumn("embedding", F.col("embedding").cast("array<float>"))
    corpus.write_chunks(records, 1)
    stored = corpus.all_chunks()
    events = stored.select(
        F.lit(3).cast("bigint").alias("seq"), F.lit("register").alias("op"), "filename",
        F.col("filename").alias("source_path"), "content_hash", "pipeline_config_hash", F.lit("text").alias("parser"),
        F.current_timestamp().alias("ingested_at"), F.lit(1).alias("chunk_count"),
    )
    corpus.append_events(events, 1)
    return corpus


def _answering(spark, sf, name):
    corpus = _document_corpus(spark, sf, name)
    corpus.index(fx.CONFIG).build(corpus.all_chunks(), IndexSettings(nlist=8))
    return Answering(corpus, fx.CONFIG, _letter_counts, nprobe=8, digits=6)


def _text_questions(spark, sf):
    picked = fx.documents(spark, sf).where("doc_id % 20 = 0 AND text IS NOT NULL")
    return picked.select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 200).alias("question"))


@query
def ask_text(spark, sf):
    """Questions in words: embedded, searched in the stored index, answered."""
    found = _answering(spark, sf, "ask-text").ask(_text_questions(spark, sf), _echo_client)
    return found.select("query_id", "answer")


@query
def ask_citations(spark, sf):
    """Where the hits of questions in words come from."""
    answering = _answering(spark, sf, "ask-citations")
    asked = embedded(_text_questions(spark, sf), _letter_counts)
    cited = answering.citations(answering.hits(asked), asked)
    return cited.select("query_id", "rank", "filename", "content_hash", F.size("page_numbers").cast("bigint").alias("pages"))


@query
def delete_document(spark, sf):
    """Every seventh document is deleted by name; the rest stays searchable."""
    corpus = _document_corpus(spark, sf, "delete-document")
    names = fx.documents(spark, sf).where("doc_id % 7 = 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"))
    gone = corpus.delete_documents(names, 2).select("filename", "content_hash", F.lit("deleted").alias("state"))
    left = corpus.chunks(fx.CONFIG).select("filename", "content_hash", F.lit("live").alias("state"))
    return gone.unionByName(left)


@query
def compact_in_place(spark, sf):
    """Every seventh document is deleted, then the corpus is packed in place: what a
    reader sees that had opened it before, what one sees now, and all that is stored."""
    corpus = _document_corpus(spark, sf, "compact-in-place")
    names = fx.documents(spark, sf).where("doc_id % 7 = 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"))
    before = corpus.chunks(fx.CONFIG)
    corpus.compact()
    corpus.delete_documents(names, 2)
    opened = corpus.chunks(fx.CONFIG)
    corpus.compact()
    sides = (("before", before), ("opened", opened), ("after", corpus.chunks(fx.CONFIG)), ("stored", corpus.all_chunks()))
    # each read by a job of its own, after both compactions
    picked = [side.select(F.lit(name).alias("reader"), "filename", "content_hash") for name, side in sides]
    return reduce(DataFrame.unionByName, [fx.saved(side, "reader") for side in picked])


@query
def ledger_two_writers(spark, sf):
    """Two writers open an empty ledger; the second one to write decides again."""
    live, incoming = fx.ledger_sides(spark, sf)
    columns = ["filename", *lg.KEY]
    shared = SharedLedger(spark, work_folder(spark, "shared-ledger"), ", ".join(f"{c} string" for c in columns))
    seen = shared.table.latest()
    shared.put(live.select(columns), seen)
    fresh, conflicts = shared.put(incoming.select(columns), seen)
    outcomes = [rows.select("filename", "content_hash", F.lit(x).alias("outcome")) for rows, x in
                ((fresh, "insert"), (conflicts, "conflict"), (shared.entries(), "entry"))]
    return reduce(DataFrame.unionByName, outcomes)


@query
def rechunk_generation(spark, sf):
    """Documents ingested with short chunks, then chunked again from their saved
    parses: the searchable chunks of the new generation."""
    corpus = store.Corpus(spark, work_folder(spark, "rechunk")).create()
    short = Ingest(settings=st.Settings(chunker="plain", chunk_max_tokens=fx.CAP // 2), separator=fx.LINES, dims=64)
    arrivals = fx.arrivals(spark, sf)
    for number, side in enumerate(("current", "incoming"), start=1):
        short.run(corpus, _as_files(arrivals.where(F.col("side") == side)), number)
    rechunk(corpus, short.settings.fingerprint(), _plain_ingest(), 10, batch_documents=100_000)
    return corpus.chunks(corpus.active()).select(*_CHUNK_KEYS)


@query
def follow_folder(spark, sf):
    """Files are there, the follower catches up; then files come and others are edited
    in place, and it takes only those."""
    from stackleaf.streaming import watch

    root = work_folder(spark, "follow")
    corpus = store.Corpus(spark, f"{root}/corpus").create()
    # a folder as a table: a file edited in place is its row of the second round
    files = fx.saved(fx.arrivals(spark, sf).select(
        F.concat(F.lit("/lake/"), "filename").alias("path"), F.timestamp_seconds("seq").alias("modificationTime"),
        F.length(F.col("text").cast("binary")).cast("bigint").alias("length"), F.col("text").cast("binary").alias("content"), "seq", "side",
    ), "folder")
    there = ["current"]

    def listed():
        newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))
        return files.where(F.col("side").isin(there)).withColumn("_n", newest).where("_n = 1").drop("_n", "side")

    def opened(taken):
        # the listing is broadcast, contents stay where they are
        at = ["path", "modificationTime"]
        return files.where(F.col("side").isin(there)).drop("side").join(small_side(taken.select(*at)), at, "left_semi")

    follower = watch.Follower(
        corpus, _plain_ingest(), f"{root}/state", listed=listed, opened=opened
    )
    follower.catch_up()
    there.append("incoming")
    follower.catch_up()
    return lg.current(corpus.events()).select("filename", "content_hash", "chunk_count")
