"""The additive model: statistics, trees, scores and held-out rows."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from llm import gam


def plain(text):
    """The statistics of one text, word by word."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return [0.0] * len(gam.FEATURES)
    size, raw = sum(len(w.encode()) for w in words), (text or "").encode()
    share = lambda kind: sum(gam._KINDS[kind][list(raw)]) / size
    lines = [line for line in (tuple(w for w in __import__("re").split(r"[\x20\x09-\x0D]+", x) if w) for x in text.split("\n")) if line]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    found = {
        "words": np.log1p(len(words)), "word_length": size / len(words), "lines": np.log1p(len(lines)),
        "line_words": len(words) / len(lines), "distinct": len(set(words)) / len(words),
        "commonest": Counter(words).most_common(1)[0][1] / len(words),
        "doubled": sum(a == b for a, b in zip(words, words[1:])) / len(words),
        "repeated_windows": sum(n for n in windows.values() if n > 1) / len(words),
        "repeated_lines": 1 - len(set(lines)) / len(lines),
    }
    return [float(found.get(name, 0) if name in found else share(name)) for name in gam.FEATURES]


TEXTS = [
    "One two three. One two three!\nOne two three.", None, "", " \n\t ", "a a a a a a", "x\n\nx\ny x\n", "É#$ 12,5 (b) <c> @d",
    "word " * 5000, "ALL CAPS!! HERE!!", "a" * 3000, "b\x0bc\x0cd\re",
]


def test_statistics_are_counted():
    found = gam.statistics(pa.array(TEXTS))
    for text, row in zip(TEXTS, found, strict=True):
        assert row == pytest.approx(plain(text)), text


def test_tree_finds_the_best_cut():
    rng = np.random.default_rng(4)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        step = gam.tree_step(g, h, cuts=1)
        gains = [gam._gain(g[:i].sum(), h[:i].sum()) + gam._gain(g[i:].sum(), h[i:].sum()) for i in range(1, 9)]
        cut = int(np.argmax(gains)) + 1 if max(gains) > gam._gain(g.sum(), h.sum()) else 9
        assert step[:cut] == pytest.approx(g[:cut].sum() / (h[:cut].sum() + gam.RIDGE))
        assert cut == 9 or step[cut:] == pytest.approx(g[cut:].sum() / (h[cut:].sum() + gam.RIDGE))
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
        step, gain = gam.pair_step(g, h)
        best = max(
            sum(gam._gain(g[a, b].sum(), h[a, b].sum()) for a in (np.s_[:i], np.s_[i:]) for b in (np.s_[:j], np.s_[j:]))
            for i in range(1, 4)
            for j in range(1, 5)
        )
        assert gain == pytest.approx(best - gam._gain(g.sum(), h.sum()))


def test_a_pair_is_learned():
    """Labels that no single statistic tells apart."""
    rng = np.random.default_rng(6)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.train(x, y, np.ones(len(y)))
    assert (0, 1) in model.pairs
    fresh = rng.random((1000, 3))
    hit = (model.score(fresh) > 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))
    assert hit.mean() > 0.9


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(8)
    x = rng.random((500, 4))
    model = gam.train(x, (x[:, 2] + rng.normal(size=500) / 4 > 0.5).astype(float), np.ones(500))
    for row, found in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.base
        for v, edges, table in zip(row, model.edges, model.tables, strict=True):
            total += table[sum(e <= v for e in edges)]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(e <= row[i] for e in model.pair_edges[i]), sum(e <= row[j] for e in model.pair_edges[j])]
        assert found == pytest.approx(1 / (1 + np.exp(-total)))
    assert len(model.pairs) <= min(gam.PAIRS, len(list(combinations(range(4), 2))))


def test_held_out_rows(spark, frame):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        own, quality = [rng.choice(words) for _ in range(rng.randrange(5, 200))], int(rng.random() < 0.8)
        if not quality:
            own = [w + rng.choice(["#", "$$", "|"]) for w in own] if i % 2 else [own[0]] * len(own)
        rows.append((i, " ".join(own)))
        labels += [(i, quality, "x")] * (1 + i % 2)
    labels += [(None, 1, "x"), (5, None, "x"), (7, 9, "x"), (100_000, 1, "x")]
    docs = frame([*rows, (3, rows[3][1]), (None, rows[4][1]), (900, None), (901, ""), (902, "w " * 200_000)])
    labels = spark.createDataFrame(labels, "doc_id long, quality int, score string")
    model = gam.fit(docs, labels.where("doc_id is null or doc_id % 5 <> 0"))
    found = gam.score(docs, model).collect()
    assert len(found) == len(rows) + 5
    scores = {r["doc_id"]: r["score"] for r in found}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[900] == scores[901] and scores[902] < 0.5
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    held = [(scores[i] >= 0.5) == known[i] for i in range(0, 600, 5)]
    assert np.mean(held) > 0.97


def test_without_labels_or_texts(spark, frame, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = gam.fit(frame([(1, "x")]), none)
    assert [r["score"] for r in gam.score(frame([(1, "x")]), model).collect()] == [0.5]
    assert gam.score(empty, gam.fit(empty, none)).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert gam.score(frame([(1, "x")]), gam.fit(frame([(1, "x")]), one)).first()["score"] == pytest.approx(2 / 3)
