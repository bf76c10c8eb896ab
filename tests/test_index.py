"""Search as a blocked product, the stored index, questions in words, deletion."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_retrieve import brute, found, questions_of, vectors

from stackleaf.operators import blocked
from stackleaf.operators import retrieve as rt
from stackleaf.plans.ask import Answering
from stackleaf.plans.ingest import Ingest
from stackleaf.plans.settings import Settings
from stackleaf.sources import vector_index
from stackleaf.sources.store import Corpus
from stackleaf.sources.vector_index import IndexSettings, VectorIndex


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("k", [1, 6, 400])
def test_blocked_product_is_the_exact_search(spark, metric, k):
    chunks, data = vectors(spark, 300, 8, seed=1)
    asked = questions_of(spark, data)
    hits = blocked.top_k_blocked(chunks.select("chunk_id", "embedding"), asked, k, metric, 6, cell_bytes=2000)
    assert found(hits) == brute(data, [data[i * 3].astype(float) for i in range(7)], k, metric)


def test_large_question_batches_take_the_blocked_way(spark, monkeypatch):
    chunks, data = vectors(spark, 200, 8, seed=4)
    asked = questions_of(spark, data, 20)
    plain = found(rt.top_k(chunks, asked, 5, where="headings <> 'Contents'", digits=6))
    monkeypatch.setattr(rt, "MAX_SLICE_BYTES", 100)
    monkeypatch.setattr(rt, "question_slices", None)  # no vector goes to the driver
    assert found(rt.top_k(chunks, asked, 5, where="headings <> 'Contents'", digits=6)) == plain


def test_blocked_product_of_odd_tables(spark):
    chunks, data = vectors(spark, 30, 4, seed=2)
    asked = questions_of(spark, data, 3)
    numbered = chunks.select(F.substring("chunk_id", 2, 9).cast("int").alias("chunk_id"), "embedding")
    with_null = numbered.unionByName(spark.createDataFrame([(99, None)], numbered.schema))
    nulls = asked.select("query_id", "embedding").unionByName(spark.createDataFrame([(77, None)], "query_id bigint, embedding array<float>"))
    hits = blocked.top_k_blocked(with_null, nulls, 2).collect()
    assert len(hits) == 6 and all(isinstance(h.chunk_id, int) and h.chunk_id != 99 for h in hits)
    assert blocked.top_k_blocked(numbered.limit(0), asked, 2).count() == 0
    assert blocked.top_k_blocked(numbered, asked.limit(0), 2).count() == 0


def test_corpus_is_read_once_and_questions_are_not_broadcast(spark, tmp_path):
    chunks, data = vectors(spark, 100, 8, seed=3)
    chunks.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    questions_of(spark, data).write.parquet(str(tmp_path / "q"))
    asked = spark.read.parquet(str(tmp_path / "q"))
    hits = blocked.top_k_blocked(stored.select("chunk_id", "embedding"), asked, 3, cell_bytes=500)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Broadcast" not in plan and "CartesianProduct" not in plan
    assert plan.count("WindowGroupLimit") >= 2


def test_short_questions_are_filled(spark):
    chunks, data = vectors(spark, 120, 8, seed=6)
    asked = questions_of(spark, data, 5)
    # all but ten rows are excluded, and of the ten some have no heading
    rare = chunks.withColumn("headings", F.when(F.substring("chunk_id", 4, 2) == "7", None).when(F.col("chunk_id") < "c0110", "Contents").otherwise("x"))
    hits = rt.top_k_postfiltered(rare, asked, 8, digits=6, fill=True)
    known = {r.chunk_id for r in rare.where("headings IS NULL OR headings <> 'Contents'").collect()}
    expected = brute(data, [data[i * 3].astype(float) for i in range(5)], 8, "cosine", lambda i: f"c{i:04d}" in known)
    assert found(hits) == expected
    fewer = rt.top_k_postfiltered(rare, asked, 8, digits=6)
    assert fewer.count() < hits.count()
    # more than there are: what exists
    assert rt.top_k_postfiltered(rare, asked, 500, digits=6, fill=True).count() == 5 * len(known)


def rows_of(chunks):
    return chunks.select(
        F.lit("d").alias("content_hash"), "chunk_id", "pipeline_config_hash", "headings", "embedding",
        F.when(F.col("chunk_id") < "c0200", 1).otherwise(2).cast("bigint").alias("batch_id"),
    )


@pytest.mark.parametrize("kind", ["flat", "sq8"])
@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_stored_index(spark, tmp_path, kind, metric):
    chunks, data = vectors(spark, 300, 8, seed=5)
    rows, folder = rows_of(chunks), str(tmp_path / "i")
    index = VectorIndex(spark, folder).create()
    assert not index.exists()
    assert index.build(rows.where("batch_id = 1"), IndexSettings(kind=kind, metric=metric, nlist=6, refine=30))
    for _ in range(2):  # a repeated batch changes nothing
        VectorIndex(spark, folder).add(rows.where("batch_id = 2"))
    opened = VectorIndex(spark, folder)
    assert opened.rows().count() == 300 and opened.settings.metric == metric
    asked = questions_of(spark, data)
    expected = brute(data, [data[i * 3].astype(float) for i in range(7)], 5, metric)
    named = {q: [f"d_{c}" for c in ids] for q, ids in expected.items()}
    assert found(opened.search(asked, 5, nprobe=6, digits=6)) == named
    some = found(opened.search(asked, 5, nprobe=2, digits=6))
    assert np.mean([len(set(some[q]) & set(named[q])) / 5 for q in named]) > (0.4 if metric == "ip" else 0.8)
    filtered = found(opened.search(asked, 5, nprobe=6, where="headings <> 'Contents'", digits=6))
    kept = brute(data, [data[i * 3].astype(float) for i in range(7)], 5, metric, lambda i: i % 3 != 0)
    assert filtered == {q: [f"d_{c}" for c in ids] for q, ids in kept.items()}


def test_index_of_large_question_batches(spark, tmp_path, monkeypatch):
    chunks, data = vectors(spark, 300, 8, seed=5)
    index = VectorIndex(spark, str(tmp_path / "i")).create()
    index.build(rows_of(chunks), IndexSettings(nlist=6))
    asked = questions_of(spark, data, 20)
    few, every = found(index.search(asked, 5, nprobe=2, digits=6)), found(index.search(asked, 5, nprobe=6, digits=6))
    monkeypatch.setattr(rt, "MAX_SLICE_BYTES", 10)
    monkeypatch.setattr(rt, "question_slices", None)
    assert found(index.search(asked, 5, nprobe=2, digits=6)) == few
    assert found(index.search(asked, 5, nprobe=6, digits=6)) == every
    rows = index.rows().select("chunk_id", "embedding", "cluster")
    probed = VectorIndex._probed(asked, index._current[2], 2)
    split = blocked.top_k_clustered(rows, probed, 5, digits=6, cell_bytes=300)  # clusters over several cells
    assert {q: [f"d_{c}" for c in ids] for q, ids in found(split).items()} == few


def test_drift_and_retraining(spark, tmp_path):
    chunks, _ = vectors(spark, 300, 8, seed=5)
    rows, folder = rows_of(chunks), str(tmp_path / "i")
    index = VectorIndex(spark, folder).create()
    settings = IndexSettings(nlist=6, metric="l2")
    index.build(rows.where("batch_id = 1"), settings)
    assert index.far_share() <= 0.02
    shifted = F.transform("embedding", lambda x: x + F.lit(20).cast("float"))
    index.add(rows.where("batch_id = 2").withColumn("embedding", shifted))
    assert index.far_share() > 0.3
    reader = VectorIndex(spark, folder)
    assert reader.exists()
    index.retrain(lambda r: r.where("chunk_id <> 'c0001'"))
    assert index.far_share() <= 0.02 and index.rows().count() == 299
    assert reader.rows().count() == 300  # a reader keeps the generation it opened
    reader.refresh()
    assert reader.rows().count() == 299


def test_a_generation_without_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    chunks, _ = vectors(spark, 60, 4, seed=5)
    index = VectorIndex(spark, str(tmp_path / "i")).create()
    index.build(rows_of(chunks), IndexSettings(nlist=3))
    real = VectorIndex._replace

    def broken(self, df, table, parts):
        if table == "manifest":
            raise RuntimeError("lost")
        real(self, df, table, parts)

    monkeypatch.setattr(VectorIndex, "_replace", broken)
    with pytest.raises(RuntimeError):
        index.retrain(lambda r: r.where("chunk_id < 'c0010'"))
    monkeypatch.setattr(VectorIndex, "_replace", real)
    assert VectorIndex(spark, index.folder).rows().count() == 60
    assert not VectorIndex(spark, str(tmp_path / "j")).create().build(rows_of(chunks).limit(0), IndexSettings())
    monkeypatch.setattr(vector_index, "MAX_CENTRE_BYTES", 8)
    with pytest.raises(ValueError):
        index.build(rows_of(chunks), IndexSettings(nlist=3))


def plug_ins():
    """An embedder and a client; closures, as workers can't import this file."""

    def letters():
        return lambda texts: [[t.lower().count(c) for c in "abcdefgh"] for t in texts]

    def echo():
        class Echo:
            def complete(self, system, user, max_tokens):
                return user

        return Echo()

    return letters, echo


letters, echo = plug_ins()


def ingest(**more):
    return Ingest(settings=Settings(chunker="plain", chunk_max_tokens=8), min_chars=1, make_embedder=letters, **more)


def files(spark, **texts):
    rows = [("/in/" + name.replace("__", "."), bytearray(text), i) for i, (name, text) in enumerate(texts.items())]
    return spark.createDataFrame(rows, "path string, content binary, seq bigint")


@pytest.mark.parametrize("settings", [None, IndexSettings(nlist=2, nprobe=2)])
def test_ask_in_words(spark, tmp_path, settings):
    corpus, job = Corpus(spark, str(tmp_path / "c")).create(), ingest(index=settings)
    job.run(corpus, files(spark, a__txt=b"aaa aab\n\nccc ccd", b__txt=b"ddd"), 1)
    job.run(corpus, files(spark, b__txt=b"eee eef", c__txt=b"ggg"), 2)
    if settings is not None:
        job.run(corpus, files(spark, b__txt=b"eee eef", c__txt=b"ggg"), 2)  # a replay
    config = job.settings.fingerprint()
    assert corpus.index(config).exists() == (settings is not None)
    asked = spark.createDataFrame([(1, "a"), (2, "e"), (3, "d")], "query_id int, question string")
    answering = Answering(corpus, config, letters, k=1)
    answers = {r.query_id: r.answer for r in answering.ask(asked, echo).collect()}
    assert "aaa aab" in answers[1] and "eee eef" in answers[2] and "ddd" not in answers[3]
    from stackleaf.plans.ask import embedded

    vectors_ = embedded(asked, letters)
    cited = {r.query_id: r.filename for r in answering.citations(answering.hits(vectors_), vectors_).collect()}
    assert cited[1] == "a.txt" and cited[2] == "b.txt"
    if settings is None:
        return

    # one document goes; its chunks and vectors stay on disk until compaction
    before = corpus.all_chunks().count()
    names = spark.createDataFrame([("a.txt",), ("never.txt",), ("a.txt",)], "filename string")
    for _ in range(2):
        assert [r.filename for r in corpus.delete_documents(names, 3).collect()] == ["a.txt"]
    assert corpus.all_chunks().count() == before
    assert "a.txt" not in {r.filename for r in corpus.chunks(config).collect()}
    cited = {r.filename for r in answering.citations(answering.hits(vectors_), vectors_).collect()}
    assert "a.txt" not in cited and cited
    # and may come back
    job.run(corpus, files(spark, a__txt=b"aaa aab\n\nccc ccd"), 4)
    cited = {r.query_id: r.filename for r in answering.citations(answering.hits(vectors_), vectors_).collect()}
    assert cited[1] == "a.txt"


def test_delete_by_pair_and_generation(spark, tmp_path):
    corpus, job = Corpus(spark, str(tmp_path / "c")).create(), ingest()
    other = Ingest(settings=Settings(chunker="plain", chunk_max_tokens=9), min_chars=1, make_embedder=letters)
    for run, batch in ((job, 1), (other, 2)):
        run.run(corpus, files(spark, a__txt=b"aaa", b__txt=b"bbb"), batch)
    live = corpus.chunks(job.settings.fingerprint()).select("filename", "content_hash")
    pair = live.where("filename = 'a.txt'")
    assert corpus.delete_documents(pair, 3, job.settings.fingerprint()).count() == 1
    assert corpus.chunks(other.settings.fingerprint()).count() == 2
    assert corpus.delete_documents(live.select("content_hash"), 4).count() == 3
    with pytest.raises(ValueError):
        corpus.delete_documents(live.selectExpr("filename AS name"), 5)


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
@pytest.mark.parametrize("digits", [None, 3])
def test_estimates_never_lose_a_hit(metric, digits):
    """Single precision only picks what is measured: ties, zeros, offsets and sizes of all kinds."""
    rng = np.random.default_rng(4)
    for kind in range(5):
        rows = rng.normal(size=(5000, 7)) * 10.0 ** (kind - 2)
        rows[100:2500] = rows[5]
        rows[3000:3100] = 0
        rows += 1000 if kind == 4 else 0
        asked = np.concatenate([rows[[5, 7, 3000, 4999]], rng.normal(size=(3, 7))])
        nearest = rt.Nearest(asked, 12, metric, digits)
        for low in range(0, 5000, 1700):
            nearest.offer(rows[low : low + 1700], np.arange(low, min(low + 1700, 5000)))
        # ties of a full list are not held
        assert nearest.best.held <= 4 * 12 * len(asked) + 100_000
        q, s, place = nearest.best.cut()
        for i, question in enumerate(asked):
            every = rt._pair_scores(rows, np.tile(question, (5000, 1)), metric, digits)
            want = np.lexsort((np.arange(5000), -every))[:12]
            assert place[q == i].tolist() == want.tolist() and np.array_equal(s[q == i], every[want])


def test_hits_of_a_question_do_not_grow_with_the_tables():
    """A batch that asks with every vector meets few cells, and no list is longer than a bound."""
    small, large = (blocked.grid_for(n, n, 64, 12) for n in (100_000, 600_000))
    assert small == (1, 36) and large == (3, 12)
    assert blocked.grid_for(3_000_000, 150_000, 26, 12)[0] == 5
    assert blocked.grid_for(1_000_000, 10, 64, 12) == (36, 1)  # few questions: more cells
    assert all(256 <= rt.together(k) <= 16384 for k in (1, 10, 80, 100_000))


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_small_cells_share_strips(spark, monkeypatch, metric):
    """Questions are copied once a strip, not once a cell, and the rows are those of the exact search."""
    chunks, data = vectors(spark, 2000, 8, seed=6)
    asked = questions_of(spark, data, 20)
    plain = found(rt.top_k(chunks, asked, 5, metric, digits=6))
    dealt = []
    inner = blocked.top_k_in_cells

    def counted(corpus, questions, *rest, **named):
        dealt.append((corpus.count(), questions.count()))
        return inner(corpus, questions, *rest, **named)

    monkeypatch.setattr(blocked, "top_k_in_cells", counted)
    pairs = chunks.select("chunk_id", "embedding")
    hits = blocked.top_k_blocked(pairs, asked, 5, metric, 6, cell_bytes=512)  # 250 cells
    assert found(hits) == plain
    assert found(blocked.top_k_blocked(pairs.limit(1000), asked, 5, metric, 6, cell_bytes=512)).keys() == plain.keys()
    most = blocked.TASKS * spark.sparkContext.defaultParallelism
    assert dealt[0] == (2000, 20 * most) and dealt[1] == (1000, 20 * most)
    monkeypatch.setattr(blocked, "PART", 2)  # the questions in parts
    monkeypatch.setattr(blocked, "HELD_BYTES", 1)
    assert found(blocked.top_k_blocked(pairs, asked, 5, metric, 6, cell_bytes=512)) == plain
    assert dealt[2][0] == 20_000


def test_what_strips_copy_grows_with_the_tables():
    """One to thirty times the vectors and questions: bytes as the tables, until what a task holds asks for more copies."""

    def copied(n):
        strips, parts = blocked.strips_for(102_564 * n, 5_129 * n, 64, 10, 6)
        assert strips * parts >= 18 and 102_564 * n / strips * 512 <= 128 << 20 and 5_129 * n / parts <= 40_000
        return (strips * 5_129 * (512 + 400) + parts * 102_564 * 256) * n

    assert copied(1) < 0.1e9 and copied(6) <= 6 * copied(1) and copied(30) < 5.5e9
    assert blocked.strips_for(0, 0, 1, 10, 6) == (1, 1)
    assert blocked.strips_for(100, 3_000_000, 64, 100_000, 1)[1] == -(-3_000_000 // 256)


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_vectors_stream_by_held_questions(monkeypatch, metric):
    """No more vectors than asked for at a time, ties by id over cells and batches, cells without one of the sides."""
    rng = np.random.default_rng(7)
    data, asked = rng.normal(size=(700, 6)).astype(np.float32), rng.normal(size=(11, 6))
    data[::50], data[300:340] = data[0], 0
    asked[3], asked[4] = 0, data[0]
    rows = [(5, 1, None, None, q, list(v)) for q, v in enumerate(asked)] + [(5, 0, f"c{i:04d}", list(map(float, v)), None, None) for i, v in enumerate(data)]
    rows = [(2, 0, "alone", [1.0] * 6, None, None), *rows, (9, 1, None, None, 99, [1.0] * 6)]
    schema = pa.schema(
        [("cell", pa.int64()), ("side", pa.int32()), ("chunk_id", pa.string()), ("embedding", pa.list_(pa.float32())),
         ("query_id", pa.int64()), ("question", pa.list_(pa.float64()))]
    )
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    offered, offer = [], rt.Nearest.offer
    monkeypatch.setattr(rt.Nearest, "offer", lambda self, part, *rest: (offered.append(len(part)), offer(self, part, *rest))[1])
    monkeypatch.setattr(rt, "together", lambda k: 4)
    out = pa.Table.from_batches(blocked._stream(9, metric, 6, 16)(iter(table.to_batches(max_chunksize=53)))).to_pylist()
    assert max(offered) == 16 and sum(offered) == 3 * len(data)
    assert {r["salt"] for r in out} == {5}
    for q, v in enumerate(asked):
        scores = rt._pair_scores(data.astype(float), np.tile(v, (700, 1)), metric, 6)
        want = [f"c{i:04d}" for i in np.lexsort((np.arange(700), -scores))[:9]]
        sign = -1 if metric == "l2" else 1
        own = sorted((r for r in out if r["query_id"] == q), key=lambda r: (-sign * r["score"], r["chunk_id"]))
        assert [r["chunk_id"] for r in own] == want
    assert len(out) == 9 * 11


def test_large_batches_search_by_codes_too(spark, tmp_path, monkeypatch):
    chunks, data = vectors(spark, 300, 8, seed=5)
    index = VectorIndex(spark, str(tmp_path / "i")).create()
    index.build(rows_of(chunks), IndexSettings(kind="sq8", nlist=6, refine=2))
    asked = questions_of(spark, data, 20)
    few, every = (found(index.search(asked, 5, nprobe=n, digits=6)) for n in (2, 6))
    monkeypatch.setattr(rt, "MAX_SLICE_BYTES", 10)
    for n, same in ((2, few), (6, every)):
        hits = index.search(asked, 5, nprobe=n, digits=6)
        assert "codes#" in hits._jdf.queryExecution().executedPlan().toString()
        assert found(hits) == same
