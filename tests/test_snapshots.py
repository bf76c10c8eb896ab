"""Versions of a table: packing in place, readers meanwhile, two writers, faults."""

import threading

import pytest
from pyspark.sql import functions as F

from stackleaf.operators import ledger as lg
from stackleaf.plans.ingest import Ingest
from stackleaf.plans.settings import Settings
from stackleaf.sources import folders, snapshots
from stackleaf.sources.store import Corpus

KEYS = "filename string, content_hash string, pipeline_config_hash string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def entries(spark, text):
    return spark.createDataFrame([(*p.split(":"), "c") for p in text.split()], KEYS)


def test_claim_once(spark, tmp_path):
    path = str(tmp_path / "new" / "1.json")
    won = []
    tries = [threading.Thread(target=lambda n=n: won.append((folders.claim(spark, path, f"é{n}"), n))) for n in range(8)]
    [t.start() for t in tries]
    [t.join() for t in tries]
    assert sum(ok for ok, _ in won) == 1
    assert folders.text_of(spark, path) == f"é{next(n for ok, n in won if ok)}"
    assert folders.names(spark, str(tmp_path / "new"), "") == ["1.json"]
    assert folders.names(spark, str(tmp_path / "none"), "") == []


def test_two_writers_are_serial(spark, tmp_path):
    """Writers that opened the same version end as if one had come after the other."""
    shared = snapshots.SharedLedger(spark, str(tmp_path / "l"), KEYS)
    assert rows(shared.entries()) == []
    seen = shared.table.latest()
    new, conflicts = shared.put(entries(spark, "a:1 b:2"), seen)
    assert (rows(new), rows(conflicts)) == ([("a", "1", "c"), ("b", "2", "c")], [])
    new, conflicts = shared.put(entries(spark, "c:2 d:3 e:3"), seen)
    assert rows(new) == [("d", "3", "c")]
    assert rows(conflicts) == [("c", "2", "c"), ("e", "3", "c")]
    assert rows(shared.entries()) == [("a", "1", "c"), ("b", "2", "c"), ("d", "3", "c")]
    assert rows(shared.entries(1)) == [("a", "1", "c"), ("b", "2", "c")]
    # the second writer's first attempt left files that no version holds
    assert shared.table.stale_files(keep=2).count() >= 1
    held = {r.path for v in (1, 2) for r in shared.table.manifest(v).collect()}
    assert held.isdisjoint(r.path for r in shared.table.stale_files(keep=2).collect())


def test_writer_overtaken_while_it_decides(spark, tmp_path):
    """Another writer commits between a decision and its version file."""
    shared = snapshots.SharedLedger(spark, str(tmp_path / "l"), KEYS)
    other = snapshots.SharedLedger(spark, str(tmp_path / "l"), KEYS)
    commit, overtaken = shared.table.commit, []

    def late(*args):
        if not overtaken:
            overtaken.append(other.put(entries(spark, "z:1")))
        return commit(*args)

    shared.table.commit = late
    new, conflicts = shared.put(entries(spark, "a:1 b:2"))
    assert (rows(new), rows(conflicts)) == ([("b", "2", "c")], [("a", "1", "c")])
    assert rows(shared.entries()) == [("b", "2", "c"), ("z", "1", "c")]


def test_insert_new_of_one_hot_key(spark):
    """A key with many entries, whole rows repeated, null columns."""
    live = entries(spark, "x:9")
    many = spark.range(500).select(
        F.concat(F.lit("f"), (F.col("id") % 250).cast("string")).alias("filename"), F.lit("1").alias("content_hash"),
        F.lit("c").alias("pipeline_config_hash"),
    )
    extra = spark.createDataFrame([("q", "9", "c"), (None, "5", "c"), ("n", None, "c"), ("n", None, "c")], KEYS)
    new, conflicts = lg.insert_new(live, many.unionByName(extra))
    assert {tuple(r) for r in new.collect()} == {("f0", "1", "c"), (None, "5", "c"), ("n", None, "c")}
    assert new.count() == 3 and conflicts.count() == 501
    assert conflicts.where("filename = 'f0'").count() == 1


@pytest.fixture
def corpus(spark, tmp_path):
    made = Corpus(spark, str(tmp_path / "c")).create()
    ingest = Ingest(settings=Settings(chunker="plain"), dims=8)

    def put(batch, **named):
        files = spark.createDataFrame([(f"/in/{n}.txt", bytearray(t.encode()), i) for i, (n, t) in enumerate(named.items())],
                                      "path string, content binary, seq bigint")
        return ingest.run(made, files, batch)

    made.put, made.config = put, ingest.settings.fingerprint()
    made.texts = lambda: rows(made.chunks(made.config).select("filename", "text"))
    made.on_disk = lambda: rows(made.all_chunks().select("filename", "text"))
    return made


def test_compact_in_place(corpus):
    assert corpus.compact() == 0
    corpus.put(1, a="one", b="two", c="three")
    corpus.put(2, a="one, edited")
    want = [("a.txt", "one, edited"), ("b.txt", "two"), ("c.txt", "three")]
    opened = corpus.chunks(corpus.config).select("filename", "text")
    assert corpus.compact() == 1
    # dead chunks are gone, in one file; a reader that was there before reads on
    assert corpus.texts() == corpus.on_disk() == rows(opened) == want
    assert corpus._packed().manifest(1).count() == 1
    # nothing to do: no new version
    assert corpus.compact() == 1
    # batches after it are read beside the packed files, and edits of packed documents seen
    corpus.put(3, b="two, edited", d="four")
    want = [("a.txt", "one, edited"), ("b.txt", "two, edited"), ("c.txt", "three"), ("d.txt", "four")]
    assert corpus.texts() == want
    assert corpus.compact() == 2
    assert corpus.texts() == corpus.on_disk() == want
    # a batch that runs again after it was packed changes nothing
    report = rows(corpus.put(2, a="one, edited").select("filename", "chunk_count"))
    assert report == [("a.txt", 1)]
    assert corpus.texts() == corpus.on_disk() == want
    # deleted documents leave the disk, and come back as new ones
    corpus.delete_documents(corpus.spark.createDataFrame([("d.txt",)], "filename string"), 4)
    assert corpus.compact() == 3
    assert corpus.on_disk() == want[:3]
    corpus.put(5, d="four")
    assert corpus.compact() == 4
    assert corpus.texts() == corpus.on_disk() == want


def test_files_without_dead_chunks_stay(corpus):
    corpus.put(1, a="one", b="two")
    corpus.compact(file_bytes=2)
    corpus.put(2, c="three")
    corpus.compact(file_bytes=2)
    before = {r.path for r in corpus._packed().manifest(2).collect()}
    corpus.put(3, c="three, edited")
    corpus.compact(file_bytes=2)
    after = {r.path for r in corpus._packed().manifest(3).collect()}
    # only the file with the dead chunk was written anew
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    assert corpus.texts() == corpus.on_disk() == [("a.txt", "one"), ("b.txt", "two"), ("c.txt", "three, edited")]


def test_fault_between_write_and_switch(corpus, monkeypatch):
    corpus.put(1, a="one", b="two")
    corpus.put(2, a="one, edited")
    want = [("a.txt", "one, edited"), ("b.txt", "two")]

    def lost(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots.folders, "claim", lost)
        with pytest.raises(OSError):
            corpus.compact()
    # files and manifest are there, but no version names them
    assert corpus._packed().latest() == 0 and corpus.texts() == want
    assert corpus.compact() == 1
    assert corpus.texts() == corpus.on_disk() == want


def test_unfinished_batch_stays_out(corpus, monkeypatch):
    """A batch that lost its driver before its ledger entry is neither seen nor packed,
    and counts once it has run again, though later batches were packed meanwhile."""
    corpus.put(1, a="one")
    with monkeypatch.context() as m:
        m.setattr(Corpus, "append_events", lambda *_: (_ for _ in ()).throw(OSError("driver lost")))
        with pytest.raises(OSError):
            corpus.put(2, b="two")
    corpus.put(3, c="three")
    assert corpus.compact() == 1
    assert corpus._packed().notes(1)["open"] == [2]
    assert corpus.texts() == [("a.txt", "one"), ("c.txt", "three")]
    corpus.put(2, b="two")
    assert corpus.texts() == [("a.txt", "one"), ("b.txt", "two"), ("c.txt", "three")]
    assert corpus.compact() == 2
    assert corpus._packed().notes(2)["open"] == []
    assert corpus.texts() == corpus.on_disk() == [("a.txt", "one"), ("b.txt", "two"), ("c.txt", "three")]
