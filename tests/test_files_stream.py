"""Real files: scanning, rejects, and the folder stream."""

import time

from stackleaf.functions import keys
from stackleaf.operators import ledger as lg
from stackleaf.plans.ingest import Ingest
from stackleaf.plans.settings import Settings
from stackleaf.sources import files as fl
from stackleaf.sources import store
from stackleaf.streaming import watch


def put(folder, **named):
    folder.mkdir(exist_ok=True)
    for name, content in named.items():
        (folder / name.replace("__", ".")).write_bytes(content)


def names(df):
    return sorted(p.rsplit("/", 1)[-1] for (p,) in df.select("path").collect())


def test_scan_folder(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, a__txt=b"a", B__MD=b"b", c__Pdf=b"c", d__docx=b"d", e=b"e")
    put(folder / "sub", f__txt=b"f")
    assert names(fl.scan_folder(spark, str(folder))) == ["B.MD", "a.txt", "c.Pdf"]
    two = fl.scan_paths(spark, [str(folder / "d.docx"), str(folder / "a.txt")])
    assert names(two) == ["a.txt", "d.docx"]


def test_parse_files(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, a__txt=b" kept as it is \n", bad__txt=b"\xc3\x28", long__pdf=b"x" * 600, short__pdf=b"x", d__docx=b"d")
    everything = fl.scan_paths(spark, [str(p) for p in folder.iterdir()])
    rows = {
        r.filename: r
        for r in fl.parse_files(everything, document_parser=lambda: lambda c, p: ("\n\n\n" + c.decode(), None)).collect()
    }
    assert rows["a.txt"].markdown == " kept as it is \n" and rows["a.txt"].reason is None
    assert rows["long.pdf"].markdown == "x" * 600 and rows["long.pdf"].parser == "document"
    assert rows["bad.txt"].reason == "invalid UTF-8"
    assert rows["short.pdf"].reason == "too short"
    assert rows["d.docx"].reason == "no parser for unknown"
    assert rows["a.txt"].doc_key == f"a_{rows['a.txt'].content_hash[:12]}_plaintext"


def test_watch_folder(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, a__txt=b"one", b__txt=b"bee", bad__txt=b"\xff", no__bin=b"?")
    ingest = Ingest(settings=Settings(chunker="plain"), dims=16)
    corpus = store.Corpus(spark, str(tmp_path / "c")).create()
    run = lambda: watch.start(
        watch.new_files(spark, str(folder)), corpus, ingest, str(tmp_path / "checkpoint")
    ).awaitTermination()
    live = lambda: sorted(
        (r.filename, r.text) for r in corpus.chunks(ingest.settings.fingerprint()).collect()
    )
    run()
    assert live() == [("a.txt", "one"), ("b.txt", "bee")]
    assert [r.reason for r in corpus.rejects().collect()] == ["invalid UTF-8"]
    # nothing new: nothing happens
    before = corpus.events().count()
    run()
    assert corpus.events().count() == before
    # a new file is taken; an edit in place is not seen by the stream ...
    put(folder, c__md=b"sea", a__txt=b"one, edited")
    run()
    assert live() == [("a.txt", "one"), ("b.txt", "bee"), ("c.md", "sea")]
    # ... but by the batch job over the folder
    ingest.run(corpus, fl.scan_folder(spark, str(folder)), 50)
    assert live() == [("a.txt", "one, edited"), ("b.txt", "bee"), ("c.md", "sea")]


def test_json_sink_and_report(spark, tmp_path):
    df = spark.createDataFrame(
        [("h", "f.txt", 0, "c", "é\n\"x\""), ("h", "f.txt", 1, "c", "y"), ("g", "g.txt", 0, "d", "z")],
        "content_hash string, filename string, chunk_index int, pipeline_config_hash string, text string",
    )
    store.write_chunks_json(df, str(tmp_path / "j"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "j"))
    assert sorted(back.select(df.columns).collect()) == sorted(df.collect())
    report = {(r.filename, r.chunk_count) for r in store.ingest_report(df).collect()}
    assert report == {("f.txt", 2), ("g.txt", 1)}


def test_sidecar(spark):
    df = spark.createDataFrame(
        [("h" * 64, "f.txt", 0, 1, "t", "1 A\nt", "1 A", "", "s", [2, 3])],
        "content_hash string, filename string, chunk_index int, total_chunks int, text string, "
        "enriched_text string, headings string, parent_headings string, summary string, page_numbers array<int>",
    )
    df = df.withColumn("content_hash", keys.content_hash(df.text.cast("binary")))
    row = store.sidecar(store.chunk_records(df, "cfg")).first()
    assert row.object_key == f"chunks/cfg/{row.metadata.content_hash}_{row.metadata.chunk_id}.txt"
    assert (row.metadata.raw_text, row.metadata.page_numbers) == ("t", "2,3")
    assert len(row.metadata) == 11


def test_ledger_has_one_row_per_version(spark, tmp_path):
    corpus = store.Corpus(spark, str(tmp_path / "c")).create()
    assert lg.current(corpus.events()).count() == 0
    assert corpus.rejects().count() == 0


def test_follow_sees_edits(spark, tmp_path, monkeypatch):
    """Catch-up, edits in place, more files than a batch takes, a lost driver, and the watch."""
    folder = tmp_path / "in"
    put(folder, a__txt=b"one", b__txt=b"bee", c__txt=b"sea", no__bin=b"?")
    ingest = Ingest(settings=Settings(chunker="plain"), dims=16)
    corpus = store.Corpus(spark, str(tmp_path / "c")).create()
    make = lambda: watch.Follower(corpus, ingest, str(tmp_path / "state"), str(folder), first_batch=7, max_files=2)
    live = lambda: sorted((r.filename, r.text) for r in corpus.chunks(ingest.settings.fingerprint()).collect())
    assert make().catch_up() == 2
    assert live() == [("a.txt", "one"), ("b.txt", "bee"), ("c.txt", "sea")]
    assert make().catch_up() == 0
    # an edit in place is ingested once
    put(folder, a__txt=b"one, edited")
    events = corpus.events().count()
    assert make().catch_up() == 1
    assert live()[0] == ("a.txt", "one, edited")
    assert corpus.events().count() == events + 2
    assert make().catch_up() == 0
    # lost after the ledger, before the state: the batch is made again and is the same
    put(folder, b__txt=b"bee, edited")
    run = ingest.run

    def lost(*args):
        run(*args)
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(ingest, "run", lost)
        try:
            make().catch_up()
        except OSError:
            pass
    events = corpus.events().count()
    assert make().catch_up() == 1 and corpus.events().count() == events
    # then the watch takes what comes
    watching = make().follow("1 second")
    try:
        put(folder, d__md=b"dee")
        for _ in range(60):
            if len(live()) == 4 or watching.exception():
                break
            time.sleep(0.5)
    finally:
        watching.stop()
    assert live() == [("a.txt", "one, edited"), ("b.txt", "bee, edited"), ("c.txt", "sea"), ("d.md", "dee")]


def test_follow_takes_any_number_of_files_as_one_table(spark, tmp_path, monkeypatch):
    """A catch-up is one batch whose listing is a table; many files are not opened by a list of paths."""
    folder = tmp_path / "in"
    put(folder, a__txt=b"one", b__txt=b"bee", c__txt=b"sea", no__bin=b"?")
    ingest = Ingest(settings=Settings(chunker="plain"), dims=16)
    corpus = store.Corpus(spark, str(tmp_path / "c")).create()
    monkeypatch.setattr(watch, "LISTED_FILES", 2)
    monkeypatch.setattr(watch, "scan_paths", None)
    follower = watch.Follower(corpus, ingest, str(tmp_path / "state"), str(folder))
    assert follower.catch_up() == 1 and follower.catch_up() == 0
    live = lambda: sorted((r.filename, r.text) for r in corpus.chunks(ingest.settings.fingerprint()).collect())
    assert live() == [("a.txt", "one"), ("b.txt", "bee"), ("c.txt", "sea")]
    # one batch of rows that no list could name: more than one batch of 10,000 before
    rows = spark.range(10_001).selectExpr(
        "concat('/x/f', id, '.txt') AS path", "timestamp_seconds(id) AS modificationTime", "1L AS length",
        "cast(concat('text ', id) AS binary) AS content",
    )
    asked = []

    def opened(taken):
        asked.append(taken.count())
        return rows.join(taken.select("path"), "path", "left_semi")

    made = []
    monkeypatch.setattr(ingest, "run", lambda corpus, files, batch_id: made.append(files.count()))
    many = watch.Follower(corpus, ingest, str(tmp_path / "other"), listed=lambda: rows, opened=opened)
    assert many.catch_up() == 1 and asked == made == [10_001] and many.catch_up() == 0
