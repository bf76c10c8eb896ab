"""Turn repair, the prefix trie and the order helpers against brute force."""

import hashlib
import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import ordering, prefix_trie, repair
from llm.scratch import Scratch

ROWS = "conv_id long, turn long, role string, text string, k long, at string, `a.b` int, line string"


@pytest.fixture(scope="session")
def turns(spark):
    """Turns with further columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(*row, 1, "x", 2, "y") for row in rows], ROWS)

    return make


def cheapest(kinds):
    """Least cost, then least letters, by best-first search over whole strings."""
    heap, done, ends = [(0, "", 0, repair.START)], set(), []
    while heap:
        cost, letters, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(kinds):
            ends.append((cost + repair.AT_END[state], letters + "I" * repair.FINISH[state]))
            continue
        for letter, more, after in repair.row_arcs(kinds[i], state):
            heapq.heappush(heap, (cost + more, letters + letter, i + 1, after))
        heapq.heappush(heap, (cost + 2, letters + "I", i, repair.MADE[state]))
    return min(ends)


def ordered(rows):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    plain = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], digest(r[2])))


def brute_repair(rows):
    rows, seen, kinds, counts = ordered(rows), set(), "", [0, 0, 0]
    for _, role, text in rows:
        blank = re.fullmatch(r"[\x20\x09-\x0D]*", text) is not None
        copied = not blank and (role, text) in seen
        cut = not blank and not copied and re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) is None
        seen.add((role, text))
        counts = [c + x for c, x in zip(counts, (blank, copied, cut))]
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        kinds += "x" if blank or copied else letter.upper() if cut else letter
    heads = [role[:1] or " " for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    cost, audit = cheapest(kinds)
    out, last, i = [], "a", 0
    for letter in audit:
        made = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append((made, ""))
        elif letter != "D":
            out.append((rows[i][1] if letter == "K" else made, rows[i][2]))
        i += letter != "I"
        if letter != "D":
            last = out[-1][0][:1]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return (gaps, *counts, illegal, cost, audit), out


def some_conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"]
    texts = ["Yes.", "No!", "so it goes", "  ", "", "Why?\n ", None, "a long one. " * 30, "a long one. " * 30 + "b"]
    found = {}
    for conv in range(60):
        n = rng.randrange(1, 9)
        found[conv] = [
            (rng.choice([None, i, i, i + 3, 0]), rng.choice(roles), rng.choice([*texts, f"own {conv} {i}.", f"own {i}"])) for i in range(n)
        ]
    found[60] = [(0, "user", "same.")] * 70  # repeated rows
    found[61] = [(i, rng.choice(["user", "assistant"]), f"{i}" + rng.choice([".", ""])) for i in range(1100)]
    found[62] = [(i, "system", " " if i < 40 else f"{i}.") for i in range(50)]
    found[None] = [(1, "user", "hi."), (2, "user", "hi."), (4, "assistant", "x")]
    return found


def test_auction_is_dijkstra():
    rng = random.Random(1)
    for _ in range(1500):
        kinds = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(12)))
        cost, letters, state = repair.solve(kinds, repair.AT_END, repair.START)
        assert (cost, letters + "I" * repair.FINISH[state]) == cheapest(kinds)


def test_prices_are_feasible_and_tight():
    rng = random.Random(2)
    for _ in range(100):
        kinds = "".join(rng.choice("xsuaoSUAO") for _ in range(10))
        lattice = repair.Lattice(kinds, repair.AT_END)
        lattice.auction(repair.START)
        for node, arcs in enumerate(lattice.arcs):
            assert all(lattice.price[node] <= cost + lattice.price[to] for _, cost, to in arcs)


def test_spans_compose():
    rng = random.Random(3)
    for _ in range(200):
        kinds = "".join(rng.choice("xsuaoSUAO") for _ in range(9))
        cut = rng.randrange(1, 9)
        end = np.array(repair.AT_END, dtype=np.int64).tobytes()
        whole = repair._joined_costs([repair.border_costs(kinds[:cut]), repair.border_costs(kinds[cut:])])
        assert np.frombuffer(repair._priced(end, whole), dtype=np.int64)[0] == cheapest(kinds)[0]


def test_repair_is_brute_force(turns):
    wanted = some_conversations()
    found = repair.repair(turns([(c, *row) for c, rows in wanted.items() for row in rows]))
    made = {}
    for row in found.turns.orderBy("conv_id", "k", "step").collect():
        made.setdefault(row["conv_id"], []).append((row["role"], row["text"]))
    counts = {row["conv_id"]: tuple(row)[1:] for row in found.conversations.collect()}
    assert counts.keys() == wanted.keys()
    for conv, rows in wanted.items():
        expected, texts = brute_repair(rows)
        assert counts[conv] == expected, conv
        assert made.get(conv, []) == texts, conv


def test_repair_of_nothing(turns):
    found = repair.repair(turns([(1, 1, "user", "x")]).limit(0))
    assert found.conversations.count() == 0 and found.turns.count() == 0


def brute_trie(conversations):
    nodes, members = {}, {}
    for conv, path in sorted(conversations.items()):
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
    for prefix, who in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len((p[-1][1] or "").encode()) for p in below if p)
        parent = members[prefix[:-1]][0] if prefix else None
        nodes[who[0], len(prefix)] = (parent, len(who), len(kids), len(leaves), saved)
    return nodes


def test_trie_is_brute_force(spark, turns):
    rng = random.Random(7)
    paths = {c: [(rng.choice("ua"), rng.choice(["x", "yé", ""])) for _ in range(rng.randrange(10))] for c in range(40)}
    paths |= {100 + c: list(paths[3]) for c in range(30)}  # copies
    paths |= {200: [("u", "1"), ("a", "2"), ("u", "3"), ("a", "4")], 201: [("u", "1"), ("a", "2"), ("u", "3"), ("a", "4"), ("u", "5")]}
    paths |= {300: [("u", str(i)) for i in range(270)], 301: [("u", str(i)) for i in range(266)] + [("a", "other")], 302: []}
    paths |= {303: [("u", "a"), ("ua", "")], 304: [("u", "a"), ("u", "a")], 305: [("u", str(i)) for i in range(256)]}
    rows = [(c, at, None if r == "" else r, None if t == "" else t) for c, path in paths.items() for at, (r, t) in enumerate(path)]
    frame = turns(rows + [(None, 0, "u", "lost")]).drop("at").withColumnRenamed("turn", "at")
    members = spark.createDataFrame([(c, 1) for c in [*paths, 3, None]], "conv_id long, depth int")
    trie = prefix_trie.prefix_trie(frame, members)
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in trie.nodes.collect()}
    assert found == brute_trie(paths)
    owner = {tuple(paths[c][:d]): c for c, d in found}
    ends = {r["conv_id"]: (r["owner"], r["depth"]) for r in trie.ends.collect()}
    assert ends == {c: (owner[tuple(p)], len(p)) for c, p in paths.items()}


def test_trie_of_nothing(spark, turns):
    frame = turns([(1, 1, "user", "x")]).drop("at").withColumnRenamed("turn", "at").limit(0)
    none = spark.createDataFrame([], "conv_id long")
    trie = prefix_trie.prefix_trie(frame, none)
    assert trie.nodes.count() == 0 and trie.ends.count() == 0
    alone = prefix_trie.prefix_trie(frame, spark.createDataFrame([(4,)], "conv_id long"))
    assert [tuple(r) for r in alone.nodes.collect()] == [(4, 0, None, 1, 0, 1, 0)]


def test_positions_of_a_key_in_many_parts(spark):
    rows = spark.range(0, 3000, numPartitions=5).select(F.lit(1).cast("long").alias("c"), (F.col("id") % 700).alias("t"))
    rows = rows.unionByName(spark.sql("select cast(id % 3 as long) + 2 c, cast(null as long) t from range(30)"))
    rows = rows.unionByName(spark.sql("select cast(null as long) c, id t from range(4)"))
    found = ordering.positions(rows, "c", [F.col("t")], Scratch(spark, "test")).collect()
    for key in (1, 2, 3, 4, None):
        mine = sorted((r["at"], r["t"] if r["t"] is not None else -1) for r in found if r["c"] == key)
        assert [at for at, _ in mine] == list(range(len(mine)))
        assert [t for _, t in mine] == sorted(t for _, t in mine)
    assert len(found) == 3034


def test_scan_by_levels(spark):
    pieces = spark.sql("select cast(1 as long) c, id k, unhex(lpad(hex(id % 251), 2, '0')) value from range(5000)")
    pieces = pieces.unionByName(spark.sql("select cast(null as long) c, id k, unhex('07') value from range(3)"))
    total = lambda values: sum(int.from_bytes(v, "big") for v in values).to_bytes(8, "big")
    step = lambda carry, value: (int.from_bytes(carry, "big") + int.from_bytes(value, "big")).to_bytes(8, "big")
    for backwards in (False, True):
        found = ordering.scan(pieces, "c", bytes(8), total, step, Scratch(spark, "test"), backwards)
        got = {(r["c"], r["k"]): int.from_bytes(r["carry"], "big") for r in found.collect()}
        values = [i % 251 for i in range(5000)]
        for i in (0, 1, 63, 64, 65, 4095, 4096, 4999):
            assert got[1, i] == sum(values[i + 1 :] if backwards else values[:i])
        assert [got[None, i] for i in range(3)] == ([14, 7, 0] if backwards else [0, 7, 14])


def test_lookups_of_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(ordering, "HEAVY", 10)
    rows = spark.sql("select id, if(id < 50, 1, id % 7) k from range(100)")
    table = spark.sql("select id k, id * 10 v, if(id = 1, 60L, 10L) n from range(7)")
    found = ordering.look_up(rows, table, ["k"], "n").collect()
    assert len(found) == 100 and all(r["v"] == r["k"] * 10 for r in found)


def test_digests_stream(spark):
    rows = spark.sql("select id % 3 a, id % 2 b, id o, cast(id as string) v from range(20000)").where("a > 0")
    found = {(r["a"], r["b"]): r["digest"] for r in ordering.sorted_digests(rows, ["a", "b"], ["o"], "v", ",").collect()}
    for a in (1, 2):
        for b in (0, 1):
            text = ",".join(str(i) for i in range(20000) if i % 3 == a and i % 2 == b)
            assert found[a, b] == hashlib.sha256(text.encode()).hexdigest()
    assert len(found) == 4
