"""Repair of turn structure: the cheapest edits that let a conversation read
``s?(ua)+``, an optional system turn and then user and assistant in turn.

The rows of a conversation and the four states of that pattern span a lattice
whose arcs are edits with whole-number costs. Its shortest path is found by an
auction: each node has a price, never above an arc's cost plus the price at its
end. A path starts at the origin; it grows along an arc that meets the price
of its last node, and where none does, that price rises to the least such sum
and the path gives the node up. When the path arrives, the nodes of all cheapest
paths have prices that are their distances, so the arcs that meet them exactly
are the arcs of cheapest paths. Of these the trace takes the least letter at
each node from which tight arcs still lead to the end.

A conversation is cut into spans of rows. One span is solved at once. For more,
auctions give the costs between the states at the span's borders; these compose,
and one scan by levels brings each border its prices, another one the state
that the trace enters with. So the rows of one conversation spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.ordering import positions, scan
from llm.scratch import Scratch, small

# Rows of a span.
SPAN = 16
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1

# States: nothing yet, after a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The turn that a rerole or an insert makes of each state.
MADE = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
# Inserts that finish a conversation from each state.
FINISH = (0, 2, 1, 0)
FAR = 1 << 40
AT_END = tuple(COST[INSERT] * n for n in FINISH)


def row_arcs(kind: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row: letter, cost, state after it. The kind of a row is ``x`` if
    it must go, else its role's initial (``o`` for others), as a capital if truncated."""
    arcs = [(DELETE, COST[DELETE], state)]
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        kept = NEXT.get((state, kind.lower()))
        if kept is not None:
            arcs.append((KEEP, COST[KEEP] + more, kept))
        arcs.append((REROLE, COST[REROLE] + more, MADE[state]))
    return arcs


class Lattice:
    """Nodes are ``4 * row + state``; the last node is the end, reached from the states
    after the last row at given prices. Prices start at a bound from below: the
    cheapest edit of every row still to come."""

    def __init__(self, kinds: str, exits: tuple[int, ...]) -> None:
        n = len(kinds)
        self.end = 4 * (n + 1)
        self.arcs: list[list[tuple[str, int, int]]] = []
        for i, kind in enumerate(kinds):
            for state in range(4):
                arcs = [(letter, cost, 4 * i + 4 + after) for letter, cost, after in row_arcs(kind, state)]
                self.arcs.append([*arcs, (INSERT, COST[INSERT], 4 * i + MADE[state])])
        self.arcs += [[("", exits[state], self.end)] if exits[state] < FAR else [] for state in range(4)]
        # no state makes an edit of a row cheaper than this
        least = [min(cost for state in range(4) for _, cost, _ in row_arcs(kind, state)) for kind in kinds]
        bound = np.concatenate([np.cumsum(least[::-1], dtype=np.int64)[::-1], [0]]) + min(exits)
        self.price = [int(x) for x in bound for _ in range(4)] + [0]
        if max(exits) >= FAR:
            reach = self._leads(tight=False)
            for node in range(self.end):
                if not reach[node]:
                    self.price[node] = FAR

    def _leads(self, tight: bool) -> list[bool]:
        """For each node, whether (tight) arcs lead from it to the end."""
        price, arcs = self.price, self.arcs
        found = [False] * self.end + [True]
        for first in range(self.end - 4, -1, -4):
            for node in range(first, first + 4):  # arcs that leave the layer
                found[node] = any(
                    found[to] and (not tight or price[node] == cost + price[to]) for _, cost, to in arcs[node] if to >= first + 4
                )
            for node in (first + USER, first + ASSISTANT, first + START, first + SYSTEM):  # inserts stay in it
                if not found[node]:
                    found[node] = any(
                        found[to] and (not tight or price[node] == cost + price[to]) for _, cost, to in arcs[node] if to < first + 4
                    )
        return found

    def auction(self, origin: int) -> int:
        """The cheapest cost from the origin to the end. Prices are kept, so that a
        further origin starts from them."""
        price, arcs, path = self.price, self.arcs, [origin]
        if price[origin] >= FAR:
            return FAR
        while path[-1] != self.end:
            node = path[-1]
            best, to = min((cost + price[to], to) for _, cost, to in arcs[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[origin]

    def trace(self, origin: int) -> tuple[str, int]:
        """The least letters of a cheapest path, and the state it leaves with."""
        alive = self._leads(tight=True)
        letters, node = [], origin
        while True:
            price = self.price[node]
            letter, to = min((a, to) for a, cost, to in self.arcs[node] if alive[to] and price == cost + self.price[to])
            if to == self.end:
                return "".join(letters), node % 4
            letters.append(letter)
            node = to


@lru_cache(maxsize=1 << 14)
def border_costs(kinds: str) -> bytes:
    """Costs between the states before and after a span, as 4 x 4 numbers."""
    costs = np.full((4, 4), FAR, dtype=np.int64)
    for after in range(4):
        lattice = Lattice(kinds, tuple(0 if s == after else FAR for s in range(4)))
        for before in range(4):
            costs[before, after] = lattice.auction(before)
    return costs.tobytes()


@lru_cache(maxsize=1 << 14)
def solve(kinds: str, exits: tuple[int, ...], state: int) -> tuple[int, str, int]:
    """Cost, letters and last state of the cheapest edits of a span that is entered in a state."""
    lattice = Lattice(kinds, exits)
    cost = lattice.auction(state)
    return (cost, *lattice.trace(state)) if cost < FAR else (FAR, "", state)


def _joined_costs(values: list[bytes]) -> bytes:
    whole = np.frombuffer(values[0], dtype=np.int64).reshape(4, 4)
    for value in values[1:]:
        whole = (whole[:, :, None] + np.frombuffer(value, dtype=np.int64).reshape(4, 4)[None]).min(axis=1)
    return np.minimum(whole, FAR).tobytes()


def _priced(prices: bytes, costs: bytes) -> bytes:
    sums = np.frombuffer(costs, dtype=np.int64).reshape(4, 4) + np.frombuffer(prices, dtype=np.int64)
    return np.minimum(sums.min(axis=1), FAR).tobytes()


def _joined_states(values: list[bytes]) -> bytes:
    states = bytes(range(4))
    for value in values:
        states = bytes(value[s] for s in states)
    return states


def _entered(state: bytes, states: bytes) -> bytes:
    return bytes([states[state[0]]])


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [border_costs(kinds) for kinds in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(costs, pa.binary())], names=["conv_id", "k", "value"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = []
        for kinds, prices in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            exits = tuple(np.frombuffer(prices, dtype=np.int64).tolist())
            values.append(bytes(solve(kinds, exits, s)[2] for s in range(4)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values, pa.binary())], names=["conv_id", "k", "value"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each span, with the inserts that finish the conversation in the
    last one, and the cost from the span's start to the end of the conversation."""
    for batch in batches:
        out = [[] for _ in range(3)]
        for kinds, prices, entered, last in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            exits = tuple(np.frombuffer(prices, dtype=np.int64).tolist())
            cost, letters, state = solve(kinds, exits, entered[0])
            for column, value in zip(out, (letters + (INSERT * FINISH[state] if last else ""), entered[0], cost), strict=True):
                column.append(value)
        arrays = [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=["conv_id", "k", "audit", "entered", "cost"])


EDITS = "conv_id long, k long, step long, at long, edit string, made string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each edit that leaves a turn: the row it is made of, if any, and its new role, if any."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    names = ["conv_id", "k", "step", "at", "edit", "made"]
    for batch in batches:
        out = [[] for _ in names]
        for conv, k, audit, state, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = 0
            for step, letter in enumerate(audit):
                if letter != DELETE:
                    made = MADE[state] if letter in (REROLE, INSERT) else None
                    place = None if letter == INSERT else k * SPAN + at
                    for column, value in zip(out, (conv, k, step, place, letter, ROLE.get(made)), strict=True):
                        column.append(value)
                    state = NEXT[state, rows[at].lower()] if made is None else made
                at += letter != INSERT
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=names)


@dataclass
class Repaired:
    """``conversations(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` and
    ``turns(conv_id, k, step, edit, role, text)``, the repaired turns by ``k, step``."""

    conversations: DataFrame
    turns: DataFrame


def repair(rows: DataFrame) -> Repaired:
    """Faults and cheapest edits of the conversations of ``rows(conv_id, turn, role, text)``.

    Rows go by turn, null first; rows of one turn by role, the first 64
    characters of their text and its digest. Null roles and texts count as one
    space. A row is blank (no character but blanks), else a duplicate (role and
    text of an earlier row), else truncated (its last character that is no blank
    is none of ``.!?``). ``gaps`` are missing turns between the smallest and the
    largest; ``illegal`` neighbours are other than system-user, user-assistant,
    assistant-user by the first letter of the role.

    Edits: keep 0, rerole to user or assistant 2, delete 3 (the only one for
    blank rows and duplicates), insert an empty turn 2, and 1 for each truncated
    row not deleted. ``audit`` has the initials of the cheapest edits that give
    roles ``(s?(ua)+)?``, of equally cheap ones the least string.

    A null ``conv_id`` is a conversation of its own. Other columns are ignored;
    an empty table gives empty tables.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "repair")
    blank = r"^[\x20\x09-\x0D]*$"
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    known = plain.select(
        "*", F.sha2("text", 256).alias("digest"), F.substring("role", 1, 1).alias("initial"),
        F.col("text").rlike(blank).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*$")).alias("open"),
    )
    order = [F.col("turn"), F.col("role"), F.substring("text", 1, 64), F.col("digest")]
    placed = positions(known, "conv_id", order, scratch)

    # the first row of each role and text; (conv_id, at) is a key without hot values
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("_at"))
    firsts = firsts.select(F.col("conv_id").alias("_conv"), "_at")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at"))
    marked = placed.select("conv_id", "at", "turn", "initial", "blank", "open").join(firsts, same, "left")
    marked = marked.withColumn("copied", ~F.col("blank") & F.col("_at").isNull())
    marked = marked.withColumn("cut", ~F.col("blank") & ~F.col("copied") & F.col("open"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    kind = F.when(F.col("blank") | F.col("copied"), "x").when(F.col("cut"), F.upper(letter)).otherwise(letter)
    # an empty role is a space among the initials
    initial = F.when(F.col("initial") == "", " ").otherwise(F.col("initial"))
    spans = marked.groupBy("conv_id", F.expr(f"at div {SPAN}").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("at", kind.alias("kind"), initial.alias("initial")))).alias("rows"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "copied", "cut")],
    )
    pairs = F.arrays_zip(F.expr("slice(initials, 1, size(initials) - 1)").alias("a"), F.expr("slice(initials, 2, size(initials))").alias("b"))
    wrong = F.size(F.filter(pairs, lambda p: ~F.concat(p["a"], p["b"]).isin("su", "ua", "au")))
    spans = scratch.save(
        spans.withColumn("initials", F.transform("rows", lambda r: r["initial"])).select(
            "conv_id", "k", F.array_join(F.transform("rows", lambda r: r["kind"]), "").alias("kinds"),
            F.col("initials")[0].alias("head"), F.element_at("initials", -1).alias("tail"), wrong.cast("long").alias("illegal"),
            "blank", "copied", "cut",
        )
    )

    many = scratch.save(spans.groupBy("conv_id").agg(F.count("*").alias("spans")).where("spans > 1"))
    many = small(many, 40).select(F.col("conv_id").alias("_conv"), "spans")
    of_many = F.col("conv_id").eqNullSafe(F.col("_conv"))
    alone = spans.join(many, of_many, "left_anti").select(
        "conv_id", "k", "kinds", F.lit(np.array(AT_END, dtype=np.int64).tobytes()).alias("prices"),
        F.lit(bytes([START])).alias("entered"), F.lit(True).alias("last"),
    )
    long = scratch.save(spans.join(many, of_many).select("conv_id", "k", "kinds", "spans"))
    pieces = alone.unionByName(_linked(long, scratch))
    audits = pieces.select("conv_id", "k", "kinds", "prices", "entered", "last").mapInArrow(
        _audits, "conv_id long, k long, audit string, entered long, cost long"
    )
    audits = scratch.save(audits)

    # neighbours across the borders of spans
    after = spans.where("k > 0").select(F.col("conv_id").alias("_conv"), (F.col("k") - 1).alias("_k"), F.col("head").alias("_head"))
    border = spans.join(after, of_many & (F.col("k") == F.col("_k")), "left").select(
        "conv_id", "k", "kinds", "blank", "copied", "cut",
        (F.col("illegal") + F.when(F.concat("tail", "_head").isin("su", "ua", "au") | F.col("_head").isNull(), 0).otherwise(1)).alias("illegal"),
    )
    letters = audits.select(F.col("conv_id").alias("_conv"), F.col("k").alias("_k"), "audit", "entered", "cost")
    whole = scratch.save(border.join(letters, of_many & (F.col("k") == F.col("_k"))).drop("_conv", "_k"))
    edits = whole.select("conv_id", "k", "audit", "entered", "kinds").mapInArrow(_edits, EDITS)
    found = whole.groupBy("conv_id").agg(
        *[F.sum(c).alias(name) for c, name in (("blank", "blank"), ("copied", "duplicate"), ("cut", "truncated"), ("illegal", "illegal"))],
        F.max(F.when(F.col("k") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "audit"))), lambda s: s["audit"]), "").alias("audit"),
    )
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    found = found.join(turns.withColumnRenamed("conv_id", "_conv"), of_many).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    source = placed.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), "role", "text")
    made = edits.where("at is not null").join(source, same).select(
        "conv_id", "k", "step", "edit", F.coalesce("made", "role").alias("role"), "text"
    )
    added = edits.where("at is null").select("conv_id", "k", "step", "edit", F.col("made").alias("role"), F.lit("").alias("text"))
    return Repaired(found, made.unionByName(added))


def _linked(long: DataFrame, scratch: Scratch) -> DataFrame:
    """The spans of conversations that have several, with the prices behind them and
    the state they are entered in."""
    schema = "conv_id long, k long, value binary"
    costs = long.select("conv_id", "k", "kinds").mapInArrow(_costs, schema)
    at_end = np.array(AT_END, dtype=np.int64).tobytes()
    prices = scan(costs, "conv_id", at_end, _joined_costs, _priced, scratch, backwards=True)

    def with_carry(left: DataFrame, carried: DataFrame, name: str) -> DataFrame:
        right = carried.select(F.col("conv_id").alias("_conv"), F.col("k").alias("_k"), F.col("carry").alias(name))
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("k") == F.col("_k"))).drop("_conv", "_k")

    priced = scratch.save(with_carry(long, prices, "prices"))
    states = priced.select("conv_id", "k", "kinds", "prices").mapInArrow(_states, schema)
    entered = scan(states, "conv_id", bytes([START]), _joined_states, _entered, scratch)
    return with_carry(priced, entered, "entered").select(
        "conv_id", "k", "kinds", "prices", "entered", (F.col("k") == F.col("spans") - 1).alias("last")
    )
