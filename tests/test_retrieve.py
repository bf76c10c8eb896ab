"""Exact and approximate search, prompts, model calls."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackleaf.operators import ann, enrich, prompts
from stackleaf.operators import retrieve as rt
from stackleaf.plans import ask as ask_plan
from stackleaf.sources import reply_store


def vectors(spark, n, dims, seed, prefix="c", parts=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dims))
    data = centers[rng.integers(0, 8, n)] + 0.5 * rng.normal(size=(n, dims))
    data[n // 2 : n // 2 + 5] = data[0]  # equal vectors: the id decides
    data = data.astype(np.float32)
    rows = [(f"{prefix}{i:04d}", [float(x) for x in v], "Contents" if i % 3 == 0 else "1 A") for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, headings string")
    return df.repartition(parts).withColumn("pipeline_config_hash", F.lit("c")), data


def questions_of(spark, data, n=7):
    rows = [(i, [float(x) for x in data[i * 3]], f"q{i}") for i in range(n)]
    return spark.createDataFrame(rows, "query_id bigint, embedding array<float>, question string")


def brute(data, qs, k, metric, keep=lambda i: True):
    x = data.astype(float)
    out = {}
    for qi, q in enumerate(qs):
        if metric == "l2":
            s = -np.sqrt(((x - q) ** 2).sum(1))
        else:
            s = x @ q
            if metric == "cosine":
                s = s / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
        s = np.round(s, 6)
        order = sorted((i for i in range(len(x)) if keep(i)), key=lambda i: (-s[i], f"c{i:04d}"))
        out[qi] = [f"c{i:04d}" for i in order[:k]]
    return out


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("k", [1, 6, 1000])
def test_top_k_equals_brute_force(spark, metric, k):
    chunks, data = vectors(spark, 300, 8, seed=1)
    qs = [data[i * 3].astype(float) for i in range(7)]
    assert found(rt.top_k(chunks, questions_of(spark, data), k, metric, digits=6)) == brute(data, qs, k, metric)


def test_question_slices_give_the_same(spark, monkeypatch):
    chunks, data = vectors(spark, 200, 8, seed=2)
    questions = questions_of(spark, data, 20)
    whole = found(rt.top_k(chunks, questions, 5))
    assert len(list(rt.question_slices(questions, max_bytes=400))) > 1
    monkeypatch.setattr(rt.question_slices, "__defaults__", ("query_id", "embedding", 400))
    assert found(rt.top_k(chunks, questions, 5)) == whole


def test_running_cut_is_exact():
    rng = np.random.default_rng(0)
    best = rt.BestK(3, 4)
    scores = np.round(rng.normal(size=(500, 3)), 1)  # many ties
    ids = np.array([f"c{i:03d}" for i in rng.permutation(500)])
    for lo in range(0, 500, 7):
        rt._offer(best, scores[lo : lo + 7], lambda r: ids[lo + r], np.arange(3))
        best.cut()
    at, kept, names = best.cut()
    for q in range(3):
        want = sorted(zip(-scores[:, q], ids))[:4]
        got = sorted(zip(-kept[at == q], names[at == q]))
        assert [g[1] for g in got] == [w[1] for w in want]


def test_no_questions_or_chunks(spark):
    chunks, data = vectors(spark, 20, 4, seed=3)
    none = questions_of(spark, data).where("false")
    assert rt.top_k(chunks, none).collect() == []
    assert rt.top_k(chunks.where("false"), questions_of(spark, data, 2)).collect() == []
    with pytest.raises(ValueError):
        rt.top_k(chunks, none, metric="hamming")


def test_filters(spark):
    chunks, data = vectors(spark, 300, 8, seed=4)
    chunks = chunks.withColumn("headings", F.when(F.col("headings") != "1 A", F.col("headings")))
    questions = questions_of(spark, data)
    qs = [data[i * 3].astype(float) for i in range(7)]
    # a missing heading passes the pre-filter, and it fills up to k
    assert found(rt.top_k_prefiltered(chunks, questions, digits=6)) == brute(data, qs, 10, "cosine", lambda i: i % 3)
    # the post-filter drops from the first 2k and does not fill up
    want = {q: [c for c in ids if int(c[1:]) % 3][:10] for q, ids in brute(data, qs, 20, "cosine").items()}
    assert found(rt.top_k_postfiltered(chunks, questions, config="c", digits=6)) == want
    assert found(rt.top_k_postfiltered(chunks, questions, config="other")) == {}


def test_post_filter_may_return_fewer(spark):
    rows = [(f"c{i:02d}", [1.0, i / 100], "Contents" if i < 15 else "x", "c") for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, headings string, pipeline_config_hash string")
    question = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    hits = rt.top_k_postfiltered(chunks, question).orderBy("rank").collect()
    assert [(r["rank"], r.chunk_id) for r in hits] == [(i + 1, f"c{15 + i}") for i in range(5)]
    assert rt.top_k_prefiltered(chunks, question).count() == 10
    assert rt.excluded_headings(" Contents, ,Index ") == ["Contents", "Index"]


def test_search_plan(spark, tmp_path):
    chunks, data = vectors(spark, 50, 4, seed=5)
    chunks.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    hits = rt.top_k_prefiltered(stored, questions_of(spark, data, 2), where="headings = '1 A'")
    text = hits._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<chunk_id:string,embedding:array<float>,headings:string>" in text
    assert "Join" not in text and "Cartesian" not in text
    assert text.count("Exchange hashpartitioning") == 1


# --- approximate ---------------------------------------------------------------


def recall(hits, truth):
    got = found(hits)
    return np.mean([len(set(got.get(q, [])) & set(ids)) / len(ids) for q, ids in truth.items()])


@pytest.fixture(scope="module")
def corpus(spark):
    chunks, data = vectors(spark, 600, 16, seed=6)
    clusters = ann.train(chunks, nlist=12, max_iter=8)
    questions = questions_of(spark, data, 20)
    truth = found(rt.top_k(chunks, questions))
    return chunks, clusters, clusters.assign(chunks).cache(), questions, truth


def test_cluster_search(corpus):
    chunks, clusters, index, questions, truth = corpus
    assert found(ann.ivf_search(index, clusters, questions, nprobe=12)) == truth
    recalls = [recall(ann.ivf_search(index, clusters, questions, nprobe=n), truth) for n in (1, 3, 12)]
    assert recalls == sorted(recalls) and recalls[0] > 0.4 and recalls[-1] == 1


def test_clusters_prune_partitions(spark, corpus, tmp_path):
    chunks, clusters, index, questions, truth = corpus
    index.write.partitionBy("cluster").parquet(str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    hits = ann.ivf_search(stored, clusters, questions.limit(1), nprobe=2)
    assert "PartitionFilters: [cluster" in hits._jdf.queryExecution().executedPlan().toString()
    assert found(ann.ivf_search(stored, clusters, questions, nprobe=12)) == truth


def test_byte_codes(corpus):
    chunks, clusters, index, questions, truth = corpus
    codec = ann.ByteCodec.fit(chunks)
    coded = ann.sq8_index(index, codec)
    assert dict(coded.dtypes)["codes"] == "array<tinyint>"
    assert recall(ann.sq8_search(coded, codec, clusters, questions, chunks, nprobe=12), truth) > 0.99


def test_product_codes(corpus):
    chunks, clusters, index, questions, truth = corpus
    codec = ann.ProductCodec.fit(chunks, parts=4, codes=32, max_iter=4)
    coded = ann.pq_index(index, codec)
    low = recall(ann.pq_search(coded, codec, clusters, questions, chunks, nprobe=12, refine=1), truth)
    high = recall(ann.pq_search(coded, codec, clusters, questions, chunks, nprobe=12, refine=10), truth)
    assert high >= low and high > 0.9
    with pytest.raises(ValueError):
        ann.ProductCodec.fit(chunks, parts=5)


# --- prompts and model calls ---------------------------------------------------


def test_hits_to_prompt(spark):
    hits = spark.createDataFrame(
        [(1, 2, "h", "p2", "s2", "", "enriched"), (1, 1, None, None, None, "raw", "enriched")],
        "query_id int, rank int, headings string, parent_headings string, summary string, raw_text string, page_content string",
    )
    shown = rt.project_hits(hits)
    assert {r["rank"]: r.page_content for r in shown.collect()} == {1: "raw", 2: "enriched"}
    text = prompts.format_hits(shown).first().results
    assert text == "--- Passage 1 ---\nSection: \nSummary: \nraw\n\n--- Passage 2 ---\nSection: p2\nSummary: s2\nenriched\n"
    asked = spark.createDataFrame([(1, "Why?"), (2, "How?")], "query_id int, question string")
    got = {r.query_id: r.prompt for r in prompts.build_prompts(asked, prompts.format_hits(shown)).collect()}
    assert got[1].startswith("Question:\nWhy?\n\n") and got[1].endswith(text)
    assert got[2].endswith("Passages:\n")


def chunk_rows(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "i int, text string")


def test_summaries_with_faults(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def make():
        class Client:
            def complete(self, system, user, max_tokens):
                (log / f"{time.time_ns()}-{random.random()}").write_text(user)
                if user == "bad":
                    raise RuntimeError("no")
                return f"**Summary:** about {user}"

        return Client()

    chunks = chunk_rows(spark, ["a", "bad", "a", "b", "a"])
    out = {r.i: (r.summary, r.summary_error) for r in enrich.summarize(chunks, make, saved=str(tmp_path / "saved")).collect()}
    assert out == {
        0: ("about a", None),
        1: ("bad", "RuntimeError: no"),
        2: ("about a", None),
        3: ("about b", None),
        4: ("about a", None),
    }
    assert sorted(p.read_text() for p in log.iterdir()) == ["a", "b", "bad"]
    # only the failed text is sent again
    enrich.summarize(chunks, make, saved=str(tmp_path / "saved")).collect()
    assert sorted(p.read_text() for p in log.iterdir()) == ["a", "b", "bad", "bad"]


def test_retry_waits_and_structured_reply():
    waits = []

    class Client:
        calls = 0

        def complete_structured(self, system, user, form, max_tokens):
            self.calls += 1
            if self.calls < 4:
                raise enrich.Throttled()
            return {"summary": "ok"}

    args = ("s", "u", 10, enrich.SUMMARY_FORM)
    assert enrich._call(Client(), *args, enrich.WAITS, waits.append) == "ok"
    assert waits == [60, 120, 240]

    class Never:
        def complete(self, system, user, max_tokens):
            raise enrich.Throttled()

    waits.clear()
    with pytest.raises(enrich.Throttled):
        enrich._call(Never(), "s", "u", 10, None, enrich.WAITS, waits.append)
    assert waits == [60, 120, 240, 480]


def test_calls_in_flight_are_bounded(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import threading

        lock, state = threading.Lock(), {"now": 0, "most": 0}

        class Client:
            def complete(self, system, user, max_tokens):
                with lock:
                    state["now"] += 1
                    state["most"] = max(state["most"], state["now"])
                time.sleep(0.02)
                with lock:
                    state["now"] -= 1
                return str(state["most"])

        return Client()

    asked = spark.range(40).coalesce(1).selectExpr("id AS query_id", "string(id) AS prompt")
    most = [int(r.answer) for r in enrich.answer(asked, make, "s", in_flight=3).collect()]
    assert max(most) == 3 and folder


def test_embedders(spark):
    df = spark.createDataFrame([("a b a",), ("a b a",), ("",)], "enriched_text string")
    made = [r.embedding for r in enrich.hashing_embed(df, 32).collect()]
    assert made[0] == made[1] and abs(sum(x * x for x in made[0]) - 1) < 1e-6 and not any(made[2])
    custom = enrich.embed(df, lambda: lambda texts: [[len(t), 1] for t in texts]).collect()
    assert [r.embedding for r in custom] == [[5.0, 1.0], [5.0, 1.0], [0.0, 1.0]]


def test_ask(spark):
    chunks, data = vectors(spark, 40, 4, seed=8)
    chunks = chunks.selectExpr(
        "*", "'' AS parent_headings", "chunk_id AS summary", "'' AS text", "chunk_id AS enriched_text",
        "'d' AS content_hash",
    )

    def make():
        class Client:
            def complete(self, system, user, max_tokens):
                return f"{user.count('--- Passage')} {user.splitlines()[1]}"

        return Client()

    got = ask_plan.ask(chunks, questions_of(spark, data, 3), make, k=4).collect()
    assert sorted(r.answer for r in got) == ["4 q0", "4 q1", "4 q2"]


def test_near_ties_rank_by_full_scores(spark):
    rows = [("a", [1.0, 0.0006]), ("b", [1.0, 0.0]), ("c", [1.0, 1e-9])]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    question = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<double>")
    for metric in ("cosine", "l2"):
        assert found(rt.top_k(chunks, question, 3, metric))[1][0] == "b"
    assert set(found(rt.top_k(chunks, question))) == {1}
    assert rt.top_k(chunks, question.where("query_id = 2")).collect() == []


def test_distances_of_long_vectors_are_exact(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(1000, 1, 64)
    data = [base + rng.normal(0, 1e-5, 64) for _ in range(60)]
    chunks = spark.createDataFrame([(f"c{i:03d}", x.tolist()) for i, x in enumerate(data)], "chunk_id string, embedding array<double>")
    question = spark.createDataFrame([(1, data[7].tolist())], "query_id int, embedding array<double>")
    hits = rt.top_k(chunks, question, 5, "l2").orderBy("rank").collect()
    want = np.sqrt(((np.array(data) - data[7]) ** 2).sum(1))
    assert [r.chunk_id for r in hits] == [f"c{i:03d}" for i in np.argsort(want)[:5]]
    assert hits[0].score == 0.0


def test_many_candidates_and_pushed_default_filter(spark, tmp_path):
    chunks, data = vectors(spark, 300, 4, seed=9)
    hits = rt.top_k_postfiltered(chunks, questions_of(spark, data, 2), k=150, candidates=300)
    assert hits.count() == 2 * 150
    chunks.write.parquet(str(tmp_path / "c"))
    plan = rt.top_k_prefiltered(spark.read.parquet(str(tmp_path / "c")), questions_of(spark, data, 2))
    text = plan._jdf.queryExecution().toString()
    assert "Not(EqualTo(headings,Contents))" in text


def test_reply_store_merges_runs(spark, tmp_path, monkeypatch):
    """Runs stay few, what is read are the partitions of the wanted keys, and a version
    that was never named does not count."""
    monkeypatch.setattr(reply_store, "PART_ROWS", 5)
    kept = reply_store.ReplyStore(spark, str(tmp_path / "r"), fan=2)
    keyed = lambda texts: spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), t) for t in texts], "key string, text string")
    upper = lambda c: F.struct(F.when(c != "bad", F.upper(c)).alias("reply"), F.when(c == "bad", F.lit("no")).alias("error"))
    read = lambda df: {r.key: (r.reply, r.error) for r in df.collect()}
    want = {}
    for i in range(7):
        texts = [f"t{i}-{j}" for j in range(12)] + ["bad", "t0-0"]
        got = read(kept.complete(keyed(texts), upper, 4, wave_rows=20))
        new = {hashlib.sha256(t.encode()).hexdigest(): (t.upper(), None) if t != "bad" else (None, "no") for t in texts}
        assert got == new
        want |= new
        if i == 4:
            # a run that was written and not named, as after a fault
            kept._write(spark.createDataFrame([("ff", "x", None)], kept.schema), 0)
    every = spark.createDataFrame([(k,) for k in [*want, "ff"]], "key string")
    assert read(kept.known(every)) == want
    _, runs = kept.runs()
    assert sorted(level for _, level, _ in runs) == [0, 1, 2]
    one = kept.known(keyed(["t3-1"]))
    scans = one._jdf.queryExecution().executedPlan().toString().split("FileScan parquet [key")[1:]
    assert len(scans) == len(runs) and all("PartitionFilters: [part" in x for x in scans)
    assert [r.reply for r in one.collect()] == ["T3-1"]


def test_answers_and_vectors_are_kept(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def note(texts):
        for text in texts:
            (log / f"{time.time_ns()}-{random.random()}").write_text(text)

    def make_client():
        class Client:
            def complete(self, system, user, max_tokens):
                note([user])
                return system + user

        return Client()

    def make_embedder():
        def run(texts):
            note(texts)
            return [[len(t)] for t in texts]

        return run

    asked = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p"), (4, None)], "query_id int, prompt string")
    for _ in range(2):
        got = {r.query_id: (r.answer, r.error) for r in enrich.answer(asked, make_client, "s:", saved=str(tmp_path / "a")).collect()}
        assert got == {1: ("s:p", None), 2: ("s:q", None), 3: ("s:p", None), 4: (None, "no text")}
    assert sorted(p.read_text() for p in log.iterdir()) == ["p", "q"]
    # another instruction is another question
    assert enrich.answer(asked.where("query_id = 1"), make_client, "t:", saved=str(tmp_path / "a")).first().answer == "t:p"
    rows = spark.createDataFrame([(1, "xx"), (2, "yyy"), (3, "xx")], "i int, enriched_text string")
    for _ in range(2):
        made = enrich.embed(rows, make_embedder, saved=str(tmp_path / "v")).collect()
        assert sorted((r.i, list(r.embedding)) for r in made) == [(1, [2.0]), (2, [3.0]), (3, [2.0])]
    assert sorted(p.read_text() for p in log.iterdir()) == ["p", "p", "q", "xx", "yyy"]


def test_embedders_get_bounded_batches(spark):
    """However large a split is, a worker holds a few texts of it at a time."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 2500, 1, 1).selectExpr("concat(id, repeat(' x', 2000)) AS enriched_text")
    made = enrich.embed(df, lambda: lambda texts: [[len(texts), t.count("x")] for t in texts], once=False).collect()
    assert {r.embedding[1] for r in made} == {2000.0} and len(made) == 2500
    assert max(r.embedding[0] for r in made) <= enrich.EMBEDDED_ROWS
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
