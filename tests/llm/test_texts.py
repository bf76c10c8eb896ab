"""Decontamination, language, byte-level BPE, licences, chat, outliers, LM and rollups."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import byte_bpe, chat, decontaminate, language, licenses, lm_score, outliers
from llm.queries import vocabulary_file
from llm.scratch import Scratch
from llm.token_counts import TokenTotals, counted
from tests.llm.conftest import thue_morse


def item_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower)


def test_benchmark_equals_brute_force(spark, frame, corpus):
    items = [(1, "No such Words"), (2, corpus[3][1]), (10, "ONE, two!"), (11, None), (12, " ... "), (None, corpus[8][1]), (13, corpus[8][1])]
    items.append((14, " ".join(corpus[77 - 10][1].split()[:5]) if corpus[67][1] else "x"))
    items.append((15, f"{thue_morse(1024)[0]} plain " * 5))
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, item int")
    want = []
    for doc, text in corpus:
        own, hit, names = item_words(text), set(), set()
        for item, passage in items:
            parts = item_words(passage)
            n = min(10, len(parts))
            for p in range(len(parts) - n + 1 if n else 0):
                for s in range(len(own) - n + 1):
                    if own[s : s + n] == parts[p : p + n]:
                        hit.update(range(s, s + n))
                        names |= {str(item)} - {"None"}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want.append((doc is None, doc or 0, len(own), len(hit), len(names), digest, bool(hit)))
    for block in (decontaminate.BLOCK_WINDOWS, 40):
        got = decontaminate.find_benchmark(frame(corpus), bench, block_windows=block).collect()
        have = [(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]
        assert sorted(have) == sorted(want)


def test_benchmark_with_empty_sides(spark, frame, empty):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.find_benchmark(empty, bench).collect() == []
    assert [r.n_hit for r in decontaminate.find_benchmark(frame([(1, "a b c")]), bench.limit(0)).collect()] == [0]


def test_language_on_held_out_rows(spark):
    rng = random.Random(4)
    parts = {"aa": "ka lo mi tu ra".split(), "bb": "sch ein ung ber keit".split(), "cc": "éau è tre oi çan".split()}
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(3, 40)))
        rows.append((i, text, lang if i % 10 else None, "en"))
    rows += [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "123 ... \n", "bb", "x"), (None, "kalomi turalo", "cc", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    out = [got[i] for i, _, lang, _ in rows[:300] if lang and got[i].held_out]
    assert len(out) > 50
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[None].lang_pred == "aa"
    assert not got[None].held_out
    carried = language.identify(docs, language.fit(docs), carry=True)
    assert carried.count() == len(rows) and carried.select("row.lang_pred").distinct().count() == 2
    nothing = language.identify(docs, language.fit(docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language.identify(docs.limit(0), language.fit(docs)).collect() == []


def test_presence_kernel_ignores_frequency_and_text_edges():
    code, good = language.ngram_codes(np.frombuffer(b"abAB", np.uint8), np.array([2, 4]), 2)
    assert good.tolist() == [True, False, True] and code[0] == code[2]


@pytest.fixture(scope="session")
def bpe():
    import tiktoken

    path, pattern = vocabulary_file()
    ours = byte_bpe.Vocabulary(path, pattern)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return ours, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab theinr'stAZ09  \n\t.é\x1c \x85字　"), st.characters(codec="utf-8")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoding_equals_the_library(bpe, text):
    ours, theirs = bpe
    tokens = ours.encode(text)
    assert tokens == theirs.encode_ordinary(text)
    assert ours.decode(tokens) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(0, 80), st.integers(0, 80), TEXT)
def test_edits_equal_encoding_anew(bpe, text, a, b, new):
    ours, theirs = bpe
    start, stop = sorted((min(a, len(text)), min(b, len(text))))
    assert byte_bpe._revised(ours, text, start, stop, new)[0] == theirs.encode_ordinary(text[:start] + new + text[stop:])


def test_prefix_table_appends_and_edits_locally(bpe):
    ours, _ = bpe
    data = b"therestationing" * 300
    table = byte_bpe.Prefixes(ours, data[:2000])
    table.append(data[2000:])
    assert table.tokens() == byte_bpe.Prefixes(ours, data).tokens()
    remade = table.replace(1500, 1503, b"xyzq")
    assert table.last == byte_bpe.Prefixes(ours, data[:1500] + b"xyzq" + data[1503:]).last
    assert remade < 4 + 4 * ours.longest


def test_byte_bpe_tables(spark, frame, corpus, empty, bpe):
    path, pattern = vocabulary_file()
    got = byte_bpe.digests(frame(corpus), path, pattern).collect()
    want = []
    for i, text in corpus:
        tokens = bpe[1].encode_ordinary(text or "")
        want.append((str(i), len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    encoded = byte_bpe.encode(frame(corpus), path, pattern)
    back = byte_bpe.decode(encoded, path, pattern)
    assert sorted((str(r.doc_id), bytes(r.data)) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t in corpus)
    assert byte_bpe.digests(empty, path, pattern).collect() == []
    edits = spark.createDataFrame(
        [(1, "the rest", None, None, "ing of it"), (2, "the rest", 0, 3, "a"), (3, None, None, None, None)],
        "doc_id long, text string, start int, stop int, new_text string",
    )
    made = {r.doc_id: r.ids for r in byte_bpe.revise(edits, path, pattern).collect()}
    assert made == {1: bpe[1].encode_ordinary("the resting of it"), 2: bpe[1].encode_ordinary("a rest"), 3: []}


def test_licences(frame, empty):
    mit = "The MIT License (MIT)\n\n" + licenses.SENTENCES["mit-grant"].replace(" to any person", "\nto any person") + "\n\n" + licenses.SENTENCES["mit-keep"]
    texts = [
        (1, mit), (2, "Some words.\nReleased under the MIT License.\nMore. licensed under CC  BY-NC 4.0!"), (3, None), (4, ""),
        (5, "nothing here"), (None, "Licensed under the Apache License, Version 2.0."), (6, licenses.SENTENCES["mit-keep"]),
        (7, licenses.SENTENCES["mit-keep"] + " " + licenses.SENTENCES["mit-grant"]),
    ]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(frame(texts)).collect()}
    assert got == {
        1: ("mit-title,mit-grant,mit-keep", "MIT-full", "MIT"),
        2: ("mit-notice,cc-by-nc-notice", "MIT-notice,CC-BY-NC-notice", "MIT,CC-BY-NC-4.0"),
        None: ("apache-notice", "Apache-notice", "Apache-2.0"),
        6: ("mit-keep", "", ""),
        7: ("mit-keep,mit-grant", "", ""),  # out of order
    }
    assert licenses.scan_licenses(empty).collect() == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_licence_headers_as_they_are_wrapped(frame):
    commented = "# Copyright 2020 X\n#\n" + "\n".join(f"# {line}".rstrip() for line in GPL.split("\n"))
    texts = [
        (1, APACHE), (2, GPL), (3, MIT_END), (4, commented), (5, "x\r\n\r\n" + APACHE.replace("\n", "\r\n")),
        (6, " ".join(APACHE.split())), (7, APACHE.replace("License, Version", "License,\nVersion")),
        (8, "Not licensed under CC BY 4.0."), (9, "it is\nlicensed under CC BY 4.0."), (10, "It is\nLicensed under CC BY 4.0"),
        (11, "Licensed under the\n\nApache License, Version 2.0."),
    ]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(frame(texts)).collect()}
    # the address stands between a sentence and an empty line, so only where that is one is apache-copy found
    apache = ("apache-header,apache-use,apache-copy,apache-terms,apache-details", "Apache-header", "Apache-2.0")
    gpl = ("gpl-free,gpl-hope,gpl-details", "GPL-header", "GPL-3.0-or-later")
    assert got == {
        1: apache, 2: gpl, 3: ("as-is-full,no-liability", "", ""), 4: gpl, 5: apache,
        6: ("apache-header,apache-use,apache-details", "Apache-header", "Apache-2.0"), 7: apache,
        10: ("cc-by-notice", "CC-BY-notice", "CC-BY-4.0"),
    }


PARTS = st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "\\", "\n", "l", "b", "n"]), st.text(max_size=5)), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), PARTS), PARTS), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    learned = "".join(chat.unescape(text[a:b]) for a, b in spans)
    assert learned == "".join(t for role, t in turns if role == "assistant")


def test_control_strings_are_not_in_escaped_texts():
    for control in chat.CONTROL:
        assert control not in chat.escape(f"x{control}y{control}")


def test_reply_trees(spark):
    rows = [
        ("a", 1, None, "user", "root", 0.0), ("a", 2, 1, "assistant", "good", 2.0), ("a", 3, 1, "assistant", "bad", 1.0),
        ("a", 4, 3, "user", "more", 0.5), ("a", 5, 2, "user", None, None), ("b", 1, 9, None, "orphan", 1.0),
        ("c", 1, 2, "user", "cycle", 1.0), ("c", 2, 1, "user", "cycle", 1.0), ("c", 3, 1, "user", "below a cycle", 1.0),
        (None, 1, None, "user", "x", 1.0), ("a", 3, 1, "assistant", "bad", 1.0),
    ]
    rows += [("d", i, i - 1, "user", f"t{i}", 1.0) for i in range(200)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in chat.format_trees(messages.withColumn("path", messages["node"]), best=2).collect()}
    assert set(got) == {("a", 5), ("a", 4), ("b", 1), ("d", 199)}
    assert chat.parse(got["a", 5].formatted) == [("user", "root"), ("assistant", "good"), ("user", "")]
    assert [t for _, t in chat.parse(got["d", 199].formatted)] == [f"t{i}" for i in range(200)]
    best = chat.format_trees(messages).collect()
    assert {(r.tree, r.leaf) for r in best} == {("a", 5), ("b", 1), ("d", 199)}
    assert chat.format_trees(messages.limit(0)).collect() == []


def test_reply_trees_by_brute_force(spark):
    """Random forests with missing parents, cycles and ties; rows made stay linear in a chain."""
    rng = np.random.default_rng(11)
    rows = []
    for tree in range(12):
        for node in range(40):
            parent = int(rng.integers(-3, 40)) if tree % 3 == 0 else int(rng.integers(-3, max(1, node)))
            rows.append((tree, node, parent if parent >= -1 else None, float(rng.integers(0, 3))))
    of = {(t, n): (p, s) for t, n, p, s in rows}
    want = {}
    for tree in range(12):
        parents = {p for (t, n), (p, _) in of.items() if t == tree}
        found = []
        for node in (n for (t, n) in of if t == tree and n not in parents):
            path, at, total = [], node, 0.0
            while at is not None and (tree, at) in of and at not in path:
                path.append(at)
                total += of[tree, at][1]
                at = of[tree, at][0]
            if at is None or (tree, at) not in of:
                found.append((-total, node, path[::-1]))
        want |= {(tree, leaf): [str(n) for n in path] for _, leaf, path in sorted(found)[:3]}
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    messages = messages.selectExpr("*", "'user' as role", "cast(node as string) as text")
    got = {(r.tree, r.leaf): [t for _, t in chat.parse(r.formatted)] for r in chat.format_trees(messages, best=3).collect()}
    assert got == want
    chain = spark.range(1500).selectExpr("0L as tree", "id as node", "id - 1 as parent", "1.0D as score")
    found = chat.paths(chain, scratch := Scratch(spark, "chain"))
    assert all(j.count() <= 1500 for j in found.jumps) and len(found.jumps) == 12
    way = chat.steps(found.leaves, found.jumps, scratch)
    assert sorted((r.node, r.above) for r in way.collect()) == [(i, 1499 - i) for i in range(1500)]


def brute_statistics(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, double = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\r\x0b\x0c"):
            double += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), double, len(hit)


def test_outliers(frame, corpus, empty, spark):
    rng = np.random.default_rng(7)
    short = [(i, t[:3000] if t else t) for i, t in corpus]
    words = ["abcdefgh"[: n + 1] + str(k) for n in range(8) for k in range(60)]
    rows = short + [(1000 + i, " ".join(rng.choice(words, rng.integers(60, 200)))) for i in range(400)]
    rows += [(5000 + i, " ".join("#|$%" + w for w in rng.choice(words, 100))) for i in range(40)]
    rows.append((6000, "same line\nsame line\n \n \nother <x>"))
    docs = frame(rows)
    got = outliers.judge(docs).collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == sorted((str(i), *brute_statistics(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and 1000 <= r.doc_id < 5000:
            assert r.kept
        if r.doc_id is not None and 5000 <= r.doc_id < 6000:
            assert not r.kept
    few = outliers.judge(frame(rows[80:90])).collect()
    assert all(r.distance is None and r.kept != r.base_failed for r in few)
    assert outliers.judge(empty).collect() == []


def test_each_statistic_rejects_alone(frame):
    rng = np.random.default_rng(9)
    words = ["abcdefgh"[: n + 1] + str(k) for n in range(8) for k in range(60)]
    some = lambda n: [str(w) for w in rng.choice(words, n)]
    lines = lambda own: "\n".join(" ".join(own[i : i + 10]) for i in range(0, len(own), 10))
    rows = [(i, lines(some(rng.integers(60, 200)))) for i in range(300)]
    passage = some(24)
    rows += [
        (1000, lines(some(5000))),
        (1001, lines([w * 5 for w in some(100)])),
        (1002, lines([w + "#" * (i % 10 < 4) for i, w in enumerate(some(100))])),
        (1003, "\nok\n".join(" ".join(some(5)) for _ in range(24))),
        (1004, " ".join([*some(26), *passage, *some(26), *passage])),
    ]
    got = {r.doc_id: r for r in outliers.judge(frame(rows)).collect()}
    assert [i for i in range(1000, 1005) if got[i].kept or got[i].base_failed] == []
    assert sum(got[i].kept for i in range(300)) >= 297


def test_distance_cut():
    assert abs(outliers.distance_cut(1e-4, 1e7) - outliers.chi_square_cut(1 - 1e-4, 5)) < 0.1
    rng = np.random.default_rng(1)
    far, cut = [], outliers.distance_cut(0.05, 40)
    for _ in range(400):
        own, new = rng.normal(size=(40, 5)), rng.normal(size=(50, 5))
        off = new - own.mean(axis=0)
        far.append((np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(own.T)), off) > cut).mean())
    assert abs(np.mean(far) - 0.05) < 0.01


def test_outliers_of_small_groups(spark):
    """Rows of a new source and of a rare language are judged by larger estimates."""
    rng = np.random.default_rng(8)
    words = ["abcdefgh"[: n + 1] + str(k) for n in range(8) for k in range(60)]
    clean = lambda: " ".join(rng.choice(words, rng.integers(60, 200)))
    odd = lambda: " ".join("#|$%" + w for w in rng.choice(words, 100))
    rows = [(i, clean(), "en", "s0") for i in range(100)]
    rows += [(200 + i, clean(), "en", None) for i in range(3)] + [(210, odd(), "en", None)]
    rows += [(220 + i, clean(), "xx", "s0") for i in range(3)] + [(230, odd(), "xx", "s0"), (240, odd(), None, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judge(docs).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {210, 230, 240}


def test_chi_square():
    assert abs(outliers.chi_square_cut(0.95, 5) - 11.0705) < 1e-3
    assert abs(outliers.chi_square_below(2.0, 2) - (1 - np.exp(-1))) < 1e-12


def test_lm_gradient_and_training(frame, corpus, empty):
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in lm_score.fresh_weights().items()}
    context, word = rng.integers(0, lm_score.WORDS + 1, (40, 4)), rng.integers(0, lm_score.WORDS, 40)
    g = lm_score.gradient(w, context, word)
    for name in lm_score.SHAPES:
        place = tuple(np.argwhere(np.abs(g[name]) > 0)[1])
        ends = []
        for step in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][place] += step
            ends.append(-lm_score.log_probabilities(moved, context, word).mean())
        assert abs((ends[0] - ends[1]) / 2e-5 - g[name][place]) < 1e-6
    # probabilities of all words add up to one
    all_words = np.arange(lm_score.WORDS)
    total = np.exp(lm_score.log_probabilities(w, np.repeat(context[:1], len(all_words), axis=0), all_words)).sum()
    assert abs(total - 1) < 1e-6
    before, after = (lm_score.score(frame(corpus), n).collect() for n in (0, 2))
    assert sum(r.log_likelihood for r in after) > sum(r.log_likelihood for r in before)
    assert sorted((str(r.doc_id), r.n_words) for r in after) == sorted((str(i), len((t or "").encode().split())) for i, t in corpus)
    assert all((r.mean_log_likelihood is None) == (r.n_words == 0) for r in after)
    assert lm_score.score(empty).collect() == []


def test_lm_gives_every_word_its_own_probability(spark):
    """Words beyond the network's vocabulary too: they add up to one, and go by their counts."""
    words = [f"w{i}" for i in range(1500)]
    rows = [(i, w) for i, w in enumerate(words) for _ in range(1 + (i < 1100) + 2 * (i == 1300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.log_likelihood for r in lm_score.score(docs, 0).distinct().collect()}
    assert len(got) == 1500
    assert abs(sum(np.exp(x) for x in got.values()) - 1) < 1e-5
    # of two words in one bucket that with more occurrences is likelier, by their ratio
    mixed = spark.createDataFrame([(1, "w1300 w1301"), (2, "W1301 w1301 w1300"), (3, None)], "doc_id long, text string")
    both = docs.unionByName(mixed)
    counts = {w: 0 for w in words}
    for r in both.where("text IS NOT NULL").collect():
        for w in r.text.lower().split():
            counts[w] += 1
    hashes = lm_score.blocks(pa.array(words), lm_score.BLANK_SEPARATED)
    of = dict(zip(words, np.concatenate([b.hashes(lower=True) for b in hashes]).tolist()))
    top = set(sorted(words, key=lambda w: (-counts[w], np.uint64(of[w]).view(np.int64)))[: lm_score.FREQUENT])
    bucket = {w: (of[w] >> 40) % lm_score.BUCKETS for w in words if w not in top}
    total = {b: sum(counts[w] for w in bucket if bucket[w] == b) for b in set(bucket.values())}
    got = {r.doc_id: r.log_likelihood for r in lm_score.score(both, 0).collect() if r.doc_id > 3 or r.n_words != 1}
    start, shared = lm_score.fresh_weights(), [w for w in bucket if int(w[1:]) > 3]
    pad = np.full((1, 4), lm_score.WORDS)
    for w in shared:
        alone = lm_score.log_probabilities(start, pad, np.array([lm_score.FREQUENT + bucket[w]]))[0]
        assert abs(got[int(w[1:])] - alone - np.log(counts[w] / total[bucket[w]])) < 1e-5


def test_token_totals(spark, tmp_path, frame, corpus, empty):
    totals = TokenTotals(spark, f"file://{tmp_path}/totals")
    assert totals.totals().collect() == []
    rows = [(i, t) for i, t in corpus if i is not None]
    totals.commit(1, counted(frame(corpus), "blank-1").unionByName(counted(frame(rows), "split-1")))

    def sums(df):
        return sorted(tuple(r) for r in df.select("source", "lang", "version", "documents", "tokens").collect())

    ids = {i: t for i, t in rows}
    want = sum(len((t or "").encode().split()) for t in ids.values())
    assert ("s0", "en", "blank-1", len(ids), want) in sums(totals.totals())
    assert sums(totals.totals()) == sums(totals.recount())
    change = spark.createDataFrame(
        [(1, "blank-1", "delete", None, None, None), (2, "blank-1", "revise", "s1", None, 7), (999, "blank-1", "delete", None, None, None),
         (998, "blank-1", "insert", None, "xx", 5), (998, "blank-1", "insert", None, "xx", 4), (None, "blank-1", "insert", "s", "l", 1),
         (3, "blank-1", "odd", "s", "l", 1)],
        "doc_id long, version string, op string, source string, lang string, tokens long",
    )
    totals.commit(2, change)
    once = sums(totals.totals().where("version = 'blank-1' and source is null")) , totals.totals().count()
    assert once[0] == [(None, "xx", "blank-1", 1, 5)]
    after = {tuple(r)[:3]: tuple(r)[3:] for r in totals.totals().collect()}
    assert after["s1", None, "blank-1"] == (1, 7)
    assert after["s0", "en", "blank-1"][0] == len(ids) - 2
    totals.commit(2, change)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in totals.totals().collect()} == after
    assert sums(totals.totals().na.fill("-")) == sums(totals.recount().na.fill("-"))
    totals.commit(3, counted(empty, "blank-1"))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in totals.totals().collect()} == after
    with pytest.raises(ValueError):
        totals.commit(1, change)
