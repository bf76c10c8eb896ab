"""The stages of the pipeline, one after the other, against brute force on a small corpus."""

import hashlib

import corpus_pipeline
from llm.queries import vocabulary_file

from test_duplicates import brute_components, brute_removed
from test_texts import item_words


def test_stages(spark, corpus, tmp_path):
    rows = [(i, t) for i, t in dict(corpus).items() if i is not None] + [(80, "12 34 !!")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in rows], columns)
    folder = str(tmp_path)
    spark.createDataFrame([(1, rows[4][1]), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    texts = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}

    def check(name, before, want):
        frame = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in before.items()], columns)
        after = steps[name](spark, frame, folder)
        assert after.columns == docs.columns
        assert {r.doc_id: r.text for r in after.collect()} == want
        return want

    texts = check("language_id", dict(rows), texts)
    found = brute_components(list(texts.items()))
    texts = check("near_duplicates", texts, {i: t for i, t in texts.items() if found[i] == i})
    digest = {row[1]: row[2:] for row in brute_removed(list(texts.items()), 50)}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], columns)
    cut = {r.doc_id: r for r in steps["substring_dedup"](spark, frame, folder).collect()}
    assert set(cut) == {i for i, (n, gone, _) in digest.items() if not 0 < gone == n}
    for i, row in cut.items():
        n, gone, sha = digest[i]
        assert row.n_chars == len(row.text) and (gone or row.text == texts[i])
        assert hashlib.sha256(b" ".join(row.text.encode().split())).hexdigest() == sha
    texts = {i: r.text for i, r in cut.items()}
    item = item_words(dict(rows)[4])
    windows = [item[s : s + 10] for s in range(max(1, len(item) - 9))]

    def hit(text):
        own = item_words(text)
        return any(own[s : s + len(w)] == w for w in windows for s in range(len(own) - len(w) + 1))

    texts = check("benchmark_decontamination", texts, {i: t for i, t in texts.items() if not hit(t)})
    final = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in final} == set(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in final)
    assert vocabulary_file()[0].endswith(".tiktoken")


def test_an_empty_table_goes_through(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], columns)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.collect() == []


def test_repeated_rows_and_odd_column_names(spark, tmp_path):
    """Rows with one id and text leave one; names with dots and of inner columns pass."""
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, "a", 7), (1, words, "a", 8), (2, "une phrase de plus", "b", 9), (None, "no id", "c", 1), (None, "no id", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `lang` string, `a.b` int").selectExpr("*", "1 AS row", "2 AS `x y`")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        found = sorted((r["doc_id"] or 0, r["text"]) for r in after.collect())
        once = [(0, "no id"), (0, "no id"), (1, words), (2, "une phrase de plus")]
        assert found == (once if name == "near_duplicates" else sorted([*once, (1, words)])), name
