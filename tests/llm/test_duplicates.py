"""Near duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import near_dups, substrings, words
from tests.llm.conftest import thue_morse

BLANK = r"[^\x20\x09-\x0D]+"


def shingles(text):
    own = re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} or ({tuple(own)} if own else set())


def brute_components(rows):
    """Links between all pairs of ids, then the smallest id reachable."""
    named = [(i, shingles(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in named}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in named:
        for j, b in named:
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                low[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in named}


def test_near_duplicates_equal_brute_force(frame, corpus):
    got = near_dups.near_duplicates(frame(corpus)).collect()
    want = brute_components(corpus)
    assert len(got) == len(corpus)
    for row in got:
        assert row.component_id == (None if row.doc_id is None else want[row.doc_id])
        assert row.kept == (row.doc_id is None or row.doc_id == row.component_id)
    sizes = sorted((i is None, i or 0, len(shingles(t))) for i, t in corpus)
    assert sizes == sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got)


def test_near_duplicates_of_a_hot_group_and_small_tiles(frame, monkeypatch):
    """A chain of small changes: neighbours are linked, ends are not; many tiles."""
    monkeypatch.setattr(near_dups, "TILE", 4)
    text = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        text[(i * 7) % 100] = f"x{i}"
        if i % 3 == 0:
            rows.append((i, " ".join(text)))
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(frame(rows)).collect()}
    assert got == brute_components(rows)


def test_a_pair_is_likely_in_a_later_band_than_bytes_suggest():
    """All bytes of the first band agree by chance; by whole keys the rows meet in the
    fourth and the sixth, and are compared in the fourth."""
    signs = np.random.default_rng(6).integers(0, 256, (2, near_dups.SIGNATURE), dtype=np.uint8)
    signs[1, : near_dups.SIGNATURE * 4 // 5] = signs[0, : near_dups.SIGNATURE * 4 // 5]
    keys = np.arange(128, dtype=np.int64).reshape(2, 64)
    keys[:, 3], keys[:, 5] = 900, 901
    rows = {"low": [0, 0], "high": [0, 0], "tile": [0, 0], "node": [5, 4], "component": [5, 4]}
    rows |= {"checks": [x.tobytes() for x in signs], "bands": [k.tolist() for k in keys]}
    for band, wanted in ((900, [4, 5]), (901, [])):
        batch = pa.RecordBatch.from_pydict({"band": [band, band], **rows})
        found = [x["node"] for b in near_dups._with_partner(0.7)(iter([batch])) for x in b.to_pylist()]
        assert sorted(found) == wanted


def test_a_group_just_below_the_threshold(frame, monkeypatch):
    """300 texts mutually at 0.70 to 0.74, and one at 0.76 or more to one of them: what
    the second pass hands on grows with the rows, not with their 45,000 pairs."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(2000)]

    def changed(words, n, mark):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"{mark}x{at}"
        return words

    texts = [changed(base, 36, f"d{i}") for i in range(300)]
    texts.append(changed(texts[7], 50, "last"))
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    saved, save = [], near_dups.Scratch.save

    def counted(self, df):
        out = save(self, df)
        if df.columns == ["a", "b"] or df.columns[0] == "band":
            saved.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(near_dups.Scratch, "save", counted)
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(frame(rows)).collect()}
    assert got == brute_components(rows)
    assert got[300] == got[7]
    links = [n for columns, n in saved if columns == ["a", "b"]]
    assert links[-1] < 301  # the forest
    (kept,) = [n for columns, n in saved if columns[:3] == ["band", "low", "high"]]
    assert kept <= 64 * 301


def test_empty_tables(empty):
    assert near_dups.near_duplicates(empty).collect() == []
    assert substrings.remove_repeats(empty).collect() == []


def test_minmax_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1300, dtype=np.uint64)
    low, high = near_dups.minmax(np.concatenate([pool[:1000], pool[300:]]), np.array([0, 1000]))
    share = (np.concatenate([low, high])[:, 0] == np.concatenate([low, high])[:, 1]).mean()
    assert abs(share - 700 / 1300) < 0.1
    assert (low <= high).all()


def brute_removed(rows, window):
    first = {}
    order = [(substrings.NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, own in order:
        for s in range(len(own) - window + 1):
            key = tuple(own[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, own), (doc, _) in zip(order, rows, strict=True):
        gone = set()
        for s in range(len(own) - window + 1):
            if first[tuple(own[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = b" ".join(w for p, w in enumerate(own) if p not in gone)
        out.append((doc is None, doc or 0, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_equal_brute_force(frame, corpus):
    for window in (50, 7):
        got = substrings.remove_repeats(frame(corpus), window).collect()
        have = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got)
        assert have == brute_removed(corpus, window)
        for r in got:
            if r.n_removed:
                assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_carried_rows_keep_their_columns(frame):
    found = substrings.remove_repeats(frame([(1, "a b c d"), (2, "x a b c d")]), 4, carry=True)
    rows = {r.row.doc_id: r for r in found.collect()}
    assert rows[2].kept == "x" and rows[2].row.k == 2 and rows[2].row.row == "row"
    assert rows[1].kept == "a b c d" and rows[1].n_removed == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab A\t\né", max_size=12), min_size=1, max_size=6), st.integers(1, 4))
def test_word_and_window_hashes_tell_sequences_apart(texts, length):
    column = pa.array(texts)
    seen = {}
    for block in words.blocks(column, words.BLANK_SEPARATED):
        hashes = block.hashes(lower=True)
        found, good = words.window_hashes(hashes, length), words.window_starts(block.at, length)
        for i in range(block.texts()):
            own = re.findall(BLANK.encode(), texts[block.first + i].encode())
            assert len(own) == block.counts()[i]
            for s in range(len(own) - length + 1):
                assert good[block.at[i] + s]
                key = tuple(re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in own[s : s + length])
                assert seen.setdefault(key, found[block.at[i] + s]) == found[block.at[i] + s]
        assert good.sum() == sum(max(0, n - length + 1) for n in block.counts())
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_long_windows_have_their_own_hashes():
    for size in (512, 1024, 2048, 4096):
        one, two = thue_morse(size)
        (block,) = words.blocks(pa.array([f"{one} {two} {one.upper()}"]), words.BLANK_SEPARATED)
        a, b, c = block.hashes(lower=True)
        assert a != b and a == c
        spread = pa.array([" ".join(one), " ".join(two), " ".join(one)])
        found = [words.window_hashes(x.hashes()[i * size : (i + 1) * size], size)[0] for x in words.blocks(spread, words.BLANK_SEPARATED) for i in range(3)]
        assert found[0] == found[2] != found[1]


def test_choose_takes_the_first_smallest():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 9, 200, dtype=np.uint64)
    for span in (1, 2, 3, 26, 200, 201):
        want = [s + int(np.argmin(hashes[s : s + span])) for s in range(len(hashes) - span + 1)]
        assert substrings.choose(hashes, span).tolist() == want
