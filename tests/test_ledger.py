"""Versioning rules, the corpus on disk, the ingest job."""

import itertools

import pytest
from pyspark.sql import functions as F

from stackleaf.operators import ledger as lg
from stackleaf.plans.ingest import Ingest
from stackleaf.plans.settings import Settings
from stackleaf.sources.store import Corpus

COLS = "filename string, content_hash string, pipeline_config_hash string, seq bigint"


def table(spark, pairs, config="c"):
    rows = [(f, h, config, i) for i, (f, h) in enumerate(pairs)]
    return spark.createDataFrame(rows, COLS)


def pairs(df):
    return sorted((r.filename, r.content_hash) for r in df.collect())


# current, incoming, live afterwards, evicted
CASES = [
    ("", "A:1", "A:1", ""),
    ("A:1", "A:1", "A:1", ""),
    ("A:1", "A:2", "A:2", "A:1"),
    ("A:2", "A:1", "A:1", "A:2"),
    ("A:1", "B:1", "A:1", ""),
    ("A:1", "A:2 B:1", "A:2 B:1", "A:1"),
    ("A:1 B:2", "A:2", "B:2", "A:1"),
    ("", "A:1 B:1", "A:1", ""),
    ("A:1 C:3", "A:2 B:1 C:1", "A:2 B:1", "A:1 C:3"),
]


def parse(text):
    return [tuple(p.split(":")) for p in text.split()]


def test_swap(spark):
    """All cases in all orders of arrival, each under a config of its own."""
    before, arriving, want_live, want_evicted = [], [], set(), set()
    for n, (current, incoming, live, evicted) in enumerate(CASES):
        for m, order in enumerate(itertools.permutations(parse(incoming))):
            config = f"{n}-{m}"
            before += [(f, h, config) for f, h in parse(current)]
            arriving += [(f, h, config, i) for i, (f, h) in enumerate(order)]
            want_live |= {(f, h, config) for f, h in parse(live)}
            want_evicted |= {(f, h, config) for f, h in parse(evicted)}
    known = spark.createDataFrame(before, COLS.rsplit(",", 1)[0])
    incoming = spark.createDataFrame(arriving, COLS)
    change = lg.swap(known, incoming)
    triples = lambda df: {tuple(r) for r in df.select("filename", "content_hash", "pipeline_config_hash").collect()}
    assert triples(change.live) == want_live
    assert triples(change.evicted) == want_evicted
    # the same files again change nothing
    again = lg.swap(spark.createDataFrame(sorted(want_live), known.schema), incoming)
    assert triples(again.live) == want_live
    assert triples(again.registered) == set()


def test_swap_keeps_other_configs(spark):
    before = table(spark, [("A", "1")], "old").drop("seq")
    change = lg.swap(before, table(spark, [("A", "2")], "new"))
    assert pairs(change.live) == [("A", "1"), ("A", "2")]
    assert pairs(change.evicted) == []


def test_latest_arrival_of_a_filename_wins(spark):
    change = lg.swap(table(spark, []).drop("seq"), table(spark, [("A", "1"), ("A", "3"), ("A", "2")]))
    assert pairs(change.live) == [("A", "2")]


def event(seq, op, name, digest, config="c"):
    return (seq, op, name, "/" + name, digest, config, "plaintext", None, 1)


def test_current_insert_and_lookup(spark):
    events = spark.createDataFrame(
        [
            event(1, "register", "A", "1"),
            event(2, "delete", "A", "1"),
            event(3, "register", "B", "1"),
            event(1, "register", "C", "2"),
            event(4, "delete", "C", "2"),
            event(5, "delete", "gone", "9"),
            event(1, "register", "D", "3", "other"),
        ],
        lg.EVENT_SCHEMA,
    )
    live = lg.current(events)
    assert pairs(live) == [("B", "1"), ("D", "3")]
    assert lg.entries(events).columns == lg.ENTRY_COLUMNS
    fresh, conflicts = lg.insert_new(live, table(spark, [("X", "1"), ("Y", "2")]))
    assert (pairs(fresh), pairs(conflicts)) == ([("Y", "2")], [("X", "1")])
    fresh, conflicts = lg.insert_new(live, table(spark, [("Z", "2"), ("Y", "2")]))
    assert (pairs(fresh), pairs(conflicts)) == ([("Y", "2")], [("Z", "2")])
    found = lg.lookup(table(spark, [("", "1"), ("", "7")]), live).collect()
    assert {(r.content_hash, r.filename) for r in found} == {("1", "B"), ("7", None)}
    assert pairs(lg.prune_events(live, "c", 9)) == [("D", "3")]


def test_ranking_is_cut_before_the_shuffle(spark):
    events = spark.createDataFrame([event(1, "register", "A", "1")], lg.EVENT_SCHEMA)
    text = lg.current(events)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 2


# --- the ingest job on disk ----------------------------------------------------


def files(spark, **named):
    rows = [(f"/in/{n.replace('__', '.')}", bytearray(t)) for n, t in named.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def plain(**options):
    return Ingest(settings=Settings(chunker="plain", chunk_max_tokens=4), dims=16, **options)


def searchable(corpus, ingest):
    rows = corpus.chunks(ingest.settings.fingerprint()).collect()
    return sorted((r.filename, r.text) for r in rows)


def test_ingest_versions_and_replay(spark, tmp_path):
    ingest, corpus = plain(), Corpus(spark, str(tmp_path / "c")).create()
    ingest.run(corpus, files(spark, a__txt=b"one two\n\none two\n\nthree four", b__md=b"bee"), 1)
    first = searchable(corpus, ingest)
    assert first == [("a.txt", "one two\n\none two"), ("a.txt", "three four"), ("b.md", "bee")]
    # same files again: nothing new
    assert ingest.run(corpus, files(spark, a__txt=b"one two\n\none two\n\nthree four", b__md=b"bee"), 2).count() == 0
    assert searchable(corpus, ingest) == first
    # an edit, run twice under one batch number
    for _ in range(2):
        report = ingest.run(corpus, files(spark, a__txt=b"new"), 3).collect()
        assert [(r.filename, r.chunk_count) for r in report] == [("a.txt", 1)]
        assert searchable(corpus, ingest) == [("a.txt", "new"), ("b.md", "bee")]
    # back to the first version
    ingest.run(corpus, files(spark, a__txt=b"one two\n\none two\n\nthree four"), 4)
    assert searchable(corpus, ingest) == first
    # only live versions survive compaction, and stay searchable
    small = corpus.compact_to(str(tmp_path / "d"))
    assert searchable(small, ingest) == first
    assert small.all_chunks().count() == 3 < corpus.all_chunks().count()
    assert lg.current(small.events()).count() == 2


def test_ingest_rejects_and_failed_edit(spark, tmp_path):
    ingest, corpus = plain(), Corpus(spark, str(tmp_path / "c")).create()
    ingest.run(corpus, files(spark, a__txt=b"good"), 1)
    ingest.run(corpus, files(spark, a__txt=b"\xff\xfe", x__docx=b"?", p__pdf=b"%PDF", n__txt=b"fine"), 2)
    # a version that cannot be read does not push out the old one
    assert searchable(corpus, ingest) == [("a.txt", "good"), ("n.txt", "fine")]
    reasons = {r.source_path: r.reason for r in corpus.rejects().collect()}
    assert reasons == {
        "/in/a.txt": "invalid UTF-8",
        "/in/x.docx": "no parser for unknown",
        "/in/p.pdf": "no document parser given",
    }


def test_ingest_copy_and_move_in_one_batch(spark, tmp_path):
    ingest, corpus = plain(), Corpus(spark, str(tmp_path / "c")).create()
    ingest.run(corpus, files(spark, a__txt=b"one"), 1)
    ingest.run(corpus, files(spark, a__txt=b"two", b__txt=b"one", c__txt=b"two"), 2)
    assert searchable(corpus, ingest) == [("a.txt", "two"), ("b.txt", "one")]
    # the copy of a failed document's content is not registered twice
    ingest.run(corpus, files(spark, a__txt=b"\xff", d__txt=b"two"), 3)
    assert searchable(corpus, ingest) == [("a.txt", "two"), ("b.txt", "one")]


def test_same_names_in_one_batch(spark, tmp_path):
    def two(a, b):
        rows = [("/in/a/r.txt", bytearray(a)), ("/in/b/r.txt", bytearray(b))]
        return spark.createDataFrame(rows, "path string, content binary")

    ingest, corpus = plain(), Corpus(spark, str(tmp_path / "c")).create()
    ingest.run(corpus, two(b"one", b"two"), 1)
    assert searchable(corpus, ingest) == [("r.txt", "two")]
    reasons = {r.source_path: r.reason for r in corpus.rejects().collect()}
    assert reasons == {"/in/a/r.txt": "replaced in the same batch"}
    # the last cannot be read, so the one before it counts
    ingest.run(corpus, two(b"three", b"\xff"), 2)
    assert searchable(corpus, ingest) == [("r.txt", "three")]


def test_empty_document_is_registered(spark, tmp_path):
    ingest, corpus = plain(), Corpus(spark, str(tmp_path / "c")).create()
    report = ingest.run(corpus, files(spark, e__txt=b""), 1).collect()
    assert [(r.filename, r.chunk_count) for r in report] == [("e.txt", 0)]


def test_unfinished_batch_is_invisible(spark, tmp_path):
    ingest, corpus = plain(), Corpus(spark, str(tmp_path / "c")).create()
    ingest.run(corpus, files(spark, a__txt=b"one"), 1)
    # a batch that stops after its chunks were written
    stray = corpus.all_chunks().drop("batch_id", "file").withColumn("text", F.lit("stray"))
    corpus.write_chunks(stray, 2)
    assert searchable(corpus, ingest) == [("a.txt", "one")]


def test_structured_ingest_and_parser(spark, tmp_path):
    def parser():
        def parse(content, path):
            if b"bad" in content:
                raise ValueError("broken")
            text = content.decode()
            block = lambda i, kind, t, page: {"idx": i, "kind": kind, "level": 1, "text": t, "page_no": page}
            return text, [block(0, "heading", "1 T", 1), block(1, "paragraph", text, 2)]

        return parse

    ingest = Ingest(document_parser=parser, min_chars=3, dims=16)
    corpus = Corpus(spark, str(tmp_path / "c")).create()
    ingest.run(
        corpus, files(spark, a__pdf=b"alpha", b__PDF=b"bad file", s__pdf=b"x", m__md=b"# 2 M\n\nbeta"), 1
    )
    rows = {r.filename: r for r in corpus.chunks(ingest.settings.fingerprint()).collect()}
    assert set(rows) == {"a.pdf", "m.md"}
    assert (rows["a.pdf"].headings, rows["a.pdf"].page_numbers) == ("1 T", "2")
    assert (rows["m.md"].enriched_text, rows["m.md"].page_numbers) == ("2 M\nbeta", "")
    reasons = {r.source_path: r.reason for r in corpus.rejects().collect()}
    assert reasons == {"/in/b.PDF": "ValueError: broken", "/in/s.pdf": "too short"}


def test_config_scope_reads_one_partition(spark, tmp_path):
    ingest, corpus = plain(), Corpus(spark, str(tmp_path / "c")).create()
    ingest.run(corpus, files(spark, a__txt=b"one"), 1)
    other = Ingest(settings=Settings(chunker="plain", chunk_max_tokens=9), dims=16)
    other.run(corpus, files(spark, a__txt=b"one"), 2)
    config = ingest.settings.fingerprint()
    text = lg.prune(corpus.all_chunks(), config)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(pipeline_config_hash" in text and config in text
    assert len(searchable(corpus, ingest)) == len(searchable(corpus, other)) == 1
    kept = corpus.compact_to(str(tmp_path / "k"), configs=[config])
    assert searchable(kept, ingest) == [("a.txt", "one")] and searchable(kept, other) == []


def test_ask_over_the_corpus(spark, tmp_path):
    """The same text in two documents is two hits; wide columns are read from
    the files with hits only."""
    from stackleaf.operators import enrich
    from stackleaf.plans.ask import retrieve

    ingest, corpus = plain(), Corpus(spark, str(tmp_path / "c")).create()
    ingest.run(corpus, files(spark, a__txt=b"shared words\n\nonly in a here", b__txt=b"shared words\n\nb has this"), 1)
    ingest.run(corpus, files(spark, c__txt=b"something else entirely"), 2)
    config = ingest.settings.fingerprint()
    asked = enrich.hashing_embed(
        spark.createDataFrame([(1, "shared words")], "query_id int, enriched_text string"), 16
    )
    hits = retrieve(corpus.chunks(config), asked, k=2).collect()
    assert [h.page_content for h in hits] == ["shared words"] * 2
    held = corpus.chunks(config).where("filename = 'c.txt'").first().file
    narrow = corpus.chunks(config).where(F.col("file").isin(held))
    assert [r.filename for r in narrow.collect()] == ["c.txt"]
    assert len(narrow.inputFiles()) >= 1
    assert "file_path" in narrow._jdf.queryExecution().executedPlan().toString()


def test_ingest_saves_replies(spark, tmp_path):
    """A batch that runs again does not call the model again."""
    log = tmp_path / "calls"
    log.mkdir()

    def make():
        class Client:
            def complete(self, system, user, max_tokens):
                import uuid

                (log / uuid.uuid4().hex).write_text(user)
                return "Summary: " + user.upper()

        return Client()

    ingest = plain(make_client=make, make_embedder=lambda: lambda texts: [[len(t)] for t in texts])
    corpus = Corpus(spark, str(tmp_path / "c")).create()
    arrived = files(spark, a__txt=b"same\n\none two three four", b__txt=b"same\n\nfour three two one")
    for _ in range(2):
        ingest.run(corpus, arrived, 1)
    rows = sorted((r.filename, r.summary, list(r.embedding)) for r in corpus.chunks(ingest.settings.fingerprint()).collect())
    assert rows == [
        ("a.txt", "ONE TWO THREE FOUR", [18.0]),
        ("a.txt", "SAME", [4.0]),
        ("b.txt", "FOUR THREE TWO ONE", [18.0]),
        ("b.txt", "SAME", [4.0]),
    ]
    assert sorted(p.read_text() for p in log.iterdir()) == ["four three two one", "one two three four", "same"]


def test_small_batches_do_not_sort_the_ledger(spark, tmp_path):
    ingest, corpus = plain(), Corpus(spark, str(tmp_path / "c")).create()
    ingest.run(corpus, files(spark, a__txt=b"one", b__txt=b"two", c__txt=b"three"), 1)
    config = ingest.settings.fingerprint()
    near = corpus.live_near(table(spark, [("b.txt", "x"), ("z.txt", "y")]), config, 2)
    assert [r.filename for r in near.collect()] == ["b.txt"]
    assert "BroadcastHashJoin" in near._jdf.queryExecution().executedPlan().toString()
