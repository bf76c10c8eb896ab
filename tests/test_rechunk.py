"""A new generation from saved parses."""

import pytest
from pyspark.sql import functions as F

from stackleaf.operators import ledger as lg
from stackleaf.plans.ingest import Ingest
from stackleaf.plans.rechunk import rechunk
from stackleaf.plans.settings import Settings
from stackleaf.sources.files import BLOCKS
from stackleaf.sources.store import Corpus


def ingest(cap):
    return Ingest(settings=Settings(chunker="plain", chunk_max_tokens=cap), dims=8)


def files(spark, **named):
    rows = [(f"/in/{n}.txt", bytearray(t.encode()), i) for i, (n, t) in enumerate(named.items())]
    return spark.createDataFrame(rows, "path string, content binary, seq bigint")


def test_rechunk(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, str(tmp_path / "c")).create()
    old, new = ingest(100), ingest(2)
    before, after = old.settings.fingerprint(), new.settings.fingerprint()
    old.run(corpus, files(spark, a="one two\n\nthree", b="four\n\nfive six\n\nseven eight", c="nine", e=""), 1)
    old.run(corpus, files(spark, c="nine, edited"), 2)
    corpus.activate(before, 0)
    with pytest.raises(ValueError):
        rechunk(corpus, before, old, 10)

    # the job loses its driver in its second batch
    append, calls = Corpus.append_events, []

    def lost(self, events, batch_id):
        calls.append(batch_id)
        if len(calls) == 2:
            raise OSError("driver lost")
        append(self, events, batch_id)

    with monkeypatch.context() as m:
        m.setattr(Corpus, "append_events", lost)
        with pytest.raises(OSError):
            rechunk(corpus, before, new, 10, batch_documents=1)
    assert corpus.active() == before and len(calls) == 2
    old.run(corpus, files(spark, late="ten"), 50)

    # a document that comes between is left to a later run, and finished batches are not made again
    monkeypatch.setattr(Corpus, "append_events", lambda self, e, b: (calls.append(b), append(self, e, b))[1])
    report = {(r.filename, r.chunk_count) for r in rechunk(corpus, before, new, 10, batch_documents=1).collect()}
    assert len(calls) == len(set(calls)) + 1  # only the lost batch twice
    assert report == {("a.txt", 2), ("b.txt", 3), ("c.txt", 1), ("e.txt", 0)}
    assert corpus.active() == after
    texts = {(r.filename, r.text) for r in corpus.chunks(corpus.active()).collect()}
    assert texts == {
        ("a.txt", "one two"), ("a.txt", "three"), ("b.txt", "four"), ("b.txt", "five six"), ("b.txt", "seven eight"),
        ("c.txt", "nine, edited"),
    }
    # the old generation is as it was, until it is pruned
    assert corpus.chunks(before).count() == 4
    assert corpus.compact_to(str(tmp_path / "pruned"), configs=[after]).chunks(before).count() == 0
    # the late document comes with the next run; then both generations know all hashes
    assert rechunk(corpus, before, new, 100).count() == 5
    live = lg.current(corpus.events()).groupBy("pipeline_config_hash").agg(F.count("*").alias("n"))
    assert {(r[0], r[1]) for r in live.collect()} == {(before, 5), (after, 5)}


def test_rechunk_of_nothing(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c")).create()
    assert corpus.active() is None
    new = ingest(2)
    assert rechunk(corpus, "none", new, 1).count() == 0
    assert corpus.active() == new.settings.fingerprint()


def test_saved_parses_can_be_read_in_even_splits(spark, tmp_path):
    import pyarrow.parquet as pq

    corpus = Corpus(spark, str(tmp_path / "corpus")).create()
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.sha2(F.concat("id", i.cast("string")), 256)), " ")
    fields = ("source_path", "filename", "content_hash", "content_type", "parser", "doc_key")
    rows = spark.range(0, 1000, 1, 1).select(
        *[F.col("id").cast("string").alias(f) for f in fields], words.alias("markdown"),
        F.lit(None).cast(BLOCKS).alias("blocks"), F.lit(None).cast("string").alias("reason"),
    )
    corpus.write_parsed(rows, 1)
    (file,) = (tmp_path / "corpus" / "parsed" / "batch_id=1").glob("*.parquet")
    groups = pq.ParquetFile(file).metadata
    sizes = [groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)]
    assert len(sizes) > 2 and max(sizes) < 16 << 20
    assert corpus.parsed().count() == 1000
