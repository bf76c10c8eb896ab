"""Packing, structure, ordered scans: goldens, brute force, plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stackleaf.functions import text as tx
from stackleaf.operators import chunking, ordered, structure


def pack(spark, texts, cap, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, markdown string")
    rows = chunking.pack_documents(docs, keep=["d"], cap=cap, **options).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.d, r.chunk_index)):
        out.setdefault(r.d, []).append(r.text)
    return [out.get(i, []) for i in range(len(texts))]


def words(n, end=""):
    return " ".join(["w"] * n) + end


def sizes(chunks):
    return [len(c.split()) for c in chunks]


def test_golden_packing(spark):
    oversize = " ".join(words(n, ".") for n in (5, 4, 9, 2))
    texts = [
        "\n\n".join(words(n) for n in (3, 4, 5, 2)),
        "\n\n".join(words(n) for n in (4, 4, 1)),
        "\n\n".join([words(3), oversize, words(1)]),
        "",
        " \n\n \n",
    ]
    got = pack(spark, texts, cap=8)
    assert [sizes(c) for c in got] == [[7, 7], [8, 1], [3, 5, 4, 9, 2, 1], [], []]
    assert got[0][0] == words(3) + "\n\n" + words(4)


def units(text, cap, special=0):
    """Paragraphs, or sentences of those above the cap, as (run, joiner, text, size).
    Units may share a chunk only inside one run."""
    found, run = [], 0
    for para in filter(None, (p.strip() for p in re.split(r"\n\n+", text))):
        size = len(para.split()) + special
        if size <= cap:
            found.append((run, "\n\n", para, size))
            continue
        parts = filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+", para)))
        found += [(run + 1, " ", s, len(s.split()) + special) for s in parts]
        run += 2
    return found


def random_text(rng):
    paras = []
    for _ in range(rng.randint(0, 8)):
        ends = ["", ".", "!", "? "]
        paras.append(" ".join(words(rng.randint(1, 6), rng.choice(ends)) for _ in range(rng.randint(1, 5))))
    return rng.choice(["\n\n", "\n\n\n", "\n\n \n\n"]).join(paras)


@pytest.mark.parametrize("special", [0, 2])
def test_chunks_are_whole_runs_as_full_as_they_can_be(spark, special):
    rng = random.Random(special)
    texts = [random_text(rng) for _ in range(300)]
    for text, chunks in zip(texts, pack(spark, texts, cap=10, counter=tx.word_counter(special))):
        left = units(text, 10, special)
        for chunk in chunks:
            run, joiner = left[0][:2]
            n = next(n for n in range(1, len(left) + 1) if joiner.join(u[2] for u in left[:n]) == chunk)
            own, left = left[:n], left[n:]
            total = sum(u[3] for u in own)
            assert {u[0] for u in own} == {run}
            assert total <= 10 or n == 1
            assert not left or left[0][0] != run or total + left[0][3] > 10
        assert not left


def test_model_counter_gives_the_same(spark):
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(50)]
    counter = tx.model_counter(lambda: lambda s: len(s.split()))
    assert pack(spark, texts, cap=10, counter=counter) == pack(spark, texts, cap=10)


def test_packing_keeps_every_segment(spark):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(100)]
    for text, chunks in zip(texts, pack(spark, texts, cap=10)):
        assert " ".join(chunks).split() == text.split()
        for c in chunks:
            assert len(c.split()) <= 10 or not re.search(r"[.!?]\s", c)


def test_distinct_keeps_the_last(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n\na\n\nc"), (2, "")], "d int, markdown string")
    rows = chunking.pack_documents(docs, keep=["d"], cap=1, distinct=True).orderBy("chunk_index").collect()
    assert [(r.text, r.chunk_index, r.total_chunks) for r in rows] == [("b", 1, 4), ("a", 2, 4), ("c", 3, 4)]


def test_dedup_rows(spark):
    rows = [("h", "c", "x", i) for i in range(50)] + [("h", "c", "y", 3), ("g", "c", "x", 0)]
    df = spark.createDataFrame(rows, "content_hash string, pipeline_config_hash string, chunk_id string, chunk_index int")
    got = {(r.content_hash, r.chunk_id, r.chunk_index) for r in chunking.dedup_chunks(df).collect()}
    assert got == {("h", "x", 49), ("h", "y", 3), ("g", "x", 0)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunking_adds_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "d int, markdown string")
    assert "Exchange" not in plan(chunking.pack_documents(docs, keep=["d"], distinct=True))
    blocks = docs.select("d", structure.blocks_from_markdown(F.col("markdown")).alias("blocks"))
    assert "Exchange" not in plan(structure.chunk_blocks(blocks, keep=["d"], distinct=True))


# --- ordered scans -------------------------------------------------------------

GOLDEN = [
    ("Preface", "Preface"),
    ("1 Intro", "1 Intro"),
    ("1.2 Why", "1 Intro => 1.2 Why"),
    ("1.2.1 Now", "1 Intro => 1.2 Why => 1.2.1 Now"),
    ("", None),
    ("2.1 Jump", "2.1 Jump"),
    ("Contents", "Contents"),
    ("3. Dot", "3. Dot"),
]


@pytest.mark.parametrize("span", [1, 2, 3, 100])
def test_golden_heading_paths(spark, span):
    df = spark.createDataFrame([(1, i, h) for i, (h, _) in enumerate(GOLDEN)], "d int, i int, h string")
    got = {r.i: " => ".join(r.path) for r in ordered.heading_paths(df, ["d"], "i", "h", span=span).collect()}
    assert got == {i: p for i, (_, p) in enumerate(GOLDEN) if p}


def closed_form(headings):
    """Ancestor at prefix p: present if the last earlier heading that is not
    below p has number p."""
    number = lambda h: h.split()[0] if re.fullmatch(r"\d+(\.\d+)*", h.split()[0]) else ""
    out = []
    for i, h in enumerate(headings):
        parts, path = number(h).split("."), []
        for k in range(1, len(parts)):
            p = ".".join(parts[:k])
            for j in range(i - 1, -1, -1):
                if not number(headings[j]).startswith(p + "."):
                    if number(headings[j]) == p:
                        path.append(headings[j])
                    break
        out.append(path + [h])
    return out


def random_heading(rng):
    if rng.random() < 0.15:
        return rng.choice(["Preface", "Contents", "1. dot"])
    return ".".join(str(rng.randint(1, 2)) for _ in range(rng.randint(1, 4))) + f" h{rng.randint(0, 3)}"


@pytest.mark.parametrize("span", [1, 4, 1000])
def test_heading_paths_equal_closed_form(spark, span):
    rng = random.Random(span)
    outlines = [[random_heading(rng) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    rows = [(d, i, h) for d, hs in enumerate(outlines) for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "d int, i int, h string")
    got = {(r.d, r.i): r.path for r in ordered.heading_paths(df, ["d"], "i", "h", span=span).collect()}
    want = {(d, i): p for d, hs in enumerate(outlines) for i, p in enumerate(closed_form(hs))}
    assert got == want


def test_scans_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.choice([None, rng.randint(0, 9)])) for d in range(3) for i in rng.sample(range(60), 30)]
    df = spark.createDataFrame(rows, "d int, i int, v int")
    carry, before, total, at = {}, {}, {}, {}
    for d in range(3):
        last, prev, running = None, None, 0
        for n, (_, i, v) in enumerate(sorted(r for r in rows if r[0] == d)):
            last = v if v is not None else last
            running += v or 0
            carry[d, i], before[d, i], total[d, i], at[d, i] = last, prev, running, n
            prev = v
    args = (df, ["d"], "i")
    value = F.col("v")
    for want, got in (
        (carry, ordered.carry_forward(*args, value, "o", span=7)),
        (before, ordered.previous(*args, value, "o", span=7)),
        (total, ordered.running_sum(*args, F.coalesce(value, F.lit(0)), "o", span=7)),
        (at, ordered.row_number(*args, "o", span=7)),
    ):
        assert {(r.d, r.i): r.o for r in got.collect()} == want


def test_number_chunks(spark):
    df = spark.createDataFrame([("a", 5), ("a", 2), ("b", 9)], "doc string, pos int")
    got = {(r.doc, r.pos): (r.chunk_index, r.total_chunks) for r in chunking.number_chunks(df, ["doc"], "pos").collect()}
    assert got == {("a", 2): (0, 2), ("a", 5): (1, 2), ("b", 9): (0, 1)}


# --- structure -----------------------------------------------------------------

MARKDOWN = """intro words

# 1 One
alpha beta
- x
- y

| a | b |
| - | - |
## 1.1 Sub
gamma

# Contents
delta"""


def chunks_of(spark, markdown, **options):
    df = spark.createDataFrame([(1, markdown)], "d int, markdown string").select(
        "d", structure.blocks_from_markdown(F.col("markdown")).alias("blocks")
    )
    return structure.chunk_blocks(df, keep=["d"], **options).orderBy("chunk_index").collect()


def test_blocks_from_markdown(spark):
    df = spark.createDataFrame([(MARKDOWN,)], "m string")
    blocks = df.select(structure.blocks_from_markdown(F.col("m")).alias("b")).first().b
    assert [(b.kind, b.level, b.text) for b in blocks] == [
        ("paragraph", 0, "intro words"),
        ("heading", 1, "1 One"),
        ("paragraph", 0, "alpha beta"),
        ("list", 0, "x"),
        ("list", 0, "y"),
        ("table", 0, "| a | b |\n| - | - |"),
        ("heading", 2, "1.1 Sub"),
        ("paragraph", 0, "gamma"),
        ("heading", 1, "Contents"),
        ("paragraph", 0, "delta"),
    ]


def test_structure_chunks(spark):
    rows = chunks_of(spark, MARKDOWN)
    assert [(r.headings, r.parent_headings, r.text) for r in rows] == [
        ("", "", "intro words"),
        ("1 One", "", "alpha beta\n\nx\ny\n\n| a | b |\n| - | - |"),
        ("1 One => 1.1 Sub", "1 One", "gamma"),
        ("Contents", "", "delta"),
    ]
    assert [r.enriched_text for r in rows][2] == "1 One\n1.1 Sub\ngamma"
    assert {r.total_chunks for r in rows} == {4}


def test_structure_flags(spark):
    apart = chunks_of(spark, MARKDOWN, merge_peers=False)
    assert [r.text for r in apart if r.headings == "1 One"] == ["alpha beta", "x\ny", "| a | b |\n| - | - |"]
    items = chunks_of(spark, MARKDOWN, merge_peers=False, merge_list_items=False)
    assert [r.text for r in items if r.headings == "1 One"] == ["alpha beta", "x", "y", "| a | b |\n| - | - |"]
    small = chunks_of(spark, "# 1 A\n\none two. three four. five", cap=2)
    assert [r.text for r in small] == ["one two.", "three four.", "five"]


def test_page_span_and_empty(spark):
    df = spark.sql(
        "SELECT 1 AS d, array(named_struct('idx',0,'kind','paragraph','level',0,'text','a','page_no',3),"
        "named_struct('idx',1,'kind','paragraph','level',0,'text','b','page_no',1),"
        "named_struct('idx',2,'kind','paragraph','level',0,'text','c','page_no',3)) AS blocks"
    )
    rows = structure.chunk_blocks(df, keep=["d"]).collect()
    assert [r.page_numbers for r in rows] == [[1, 3]]
    assert chunks_of(spark, "") == []
    assert chunks_of(spark, "# 1 Only a heading") == []


def test_merge_list_rows_equals_in_row(spark):
    df = spark.createDataFrame([(1, MARKDOWN)], "d int, markdown string").select(
        "d", F.explode(structure.blocks_from_markdown(F.col("markdown"))).alias("b")
    ).select("d", "b.idx", "b.kind", "b.text")
    rows = structure.merge_list_rows(df, ["d"], "idx", "kind", "text").orderBy("unit").collect()
    assert [r.text for r in rows if r.kind == "list"] == ["x\ny"]
    assert len(rows) == 9
