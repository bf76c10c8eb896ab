"""Prefix trie of conversations by block digests.

Conversations are cut into blocks of a fixed number of turns. A digest of all
blocks before one names the group of conversations that agree so far; inside a
group, rows with one block digest are one class, kept once with its counts. Where
a group has one class its turns need no look: every node has the same members.
Only where sibling blocks diverge are turn digests chained turn by turn, one
row for each class, to find the turn at which they part.

A node is named by its smallest member, its owner, and its depth. Once a
conversation owns a node it owns all deeper ones on its path. So what a subtree
holds is a sum over the members of its top: a leaf counts for its owner, and
the bytes of a turn are saved for each member that doesn't own it. No walk over
the trie is needed, and no join from nodes to their descendants.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.ordering import look_up, scan
from llm.scratch import Scratch

# Turns of a block.
BLOCK = 4
_NONE = hashlib.sha256(b"").digest()


def _joined(values: list[bytes]) -> bytes:
    """Block digests (32 bytes) with the bytes of their texts (8 bytes) as one."""
    digest = hashlib.sha256(b"".join(v[:32] for v in values)).digest()
    return digest + sum(int.from_bytes(v[32:], "big") for v in values).to_bytes(8, "big")


def _step(carry: bytes, value: bytes) -> bytes:
    size = int.from_bytes(carry[32:], "big") + int.from_bytes(value[32:], "big")
    return hashlib.sha256(carry[:32] + value[:32]).digest() + size.to_bytes(8, "big")


@dataclass
class Trie:
    """``nodes(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved)`` and
    ``ends(conv_id, owner, depth)``, the node at which each conversation ends."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(turns: DataFrame, members: DataFrame) -> Trie:
    """The trie of the conversations of ``turns(conv_id, at, role, text)``, ``at`` dense
    from 0, and of ``members(conv_id)``, which may have no turn.

    Each distinct sequence of first turns (role, text) is a node; ``conv_id`` of
    a node is its smallest member, ``parent_conv_id`` that of its parent (the
    root: null). ``n_leaves`` counts childless nodes of the subtree with its
    top, ``saved`` sums over them ``n_convs - 1`` times the UTF-8 bytes of their
    last text.

    Null roles and texts are empty ones; turns and members without ``conv_id``
    are left out, members named twice count once. No members give no nodes.
    """
    scratch = Scratch(members.sparkSession, "trie")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length in front of the role keeps different turns apart
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    plain = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("at").cast("long").alias("at"),
        digest.alias("d"), F.octet_length(text).cast("long").alias("n"),
    )
    filled = plain.groupBy("conv_id", F.expr(f"at div {BLOCK}").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("at", "d", "n"))).alias("rows")
    )
    filled = scratch.save(
        filled.select("conv_id", "k", F.transform("rows", lambda r: r["d"]).alias("ds"), F.transform("rows", lambda r: r["n"]).alias("ns"))
    )
    # a conversation ends in a block that isn't full, which may be empty
    long = F.sum(F.size("ds").cast("long"))
    full = filled.groupBy("conv_id").agg(long.alias("turns")).where(f"turns % {BLOCK} = 0")
    everyone = members.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    without = everyone.join(filled.where("k = 0").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("k"))
    empty = full.select("conv_id", F.expr(f"turns div {BLOCK}").alias("k")).unionByName(without)
    empty = empty.select("conv_id", "k", F.expr("cast(array() as array<binary>)").alias("ds"), F.expr("cast(array() as array<bigint>)").alias("ns"))
    joined = F.aggregate("ds", F.lit(b""), lambda whole, d: F.concat(whole, d))
    blocks = filled.unionByName(empty).select(
        "conv_id", "k", "ds", "ns", F.unhex(F.sha2(joined, 256)).alias("block"), F.aggregate("ns", F.lit(0).cast("long"), lambda s, n: s + n).alias("size")
    )
    blocks = scratch.save(blocks)
    value = F.concat("block", F.unhex(F.lpad(F.hex("size"), 16, "0")))
    carried = scan(blocks.select("conv_id", "k", value.alias("value")), "conv_id", _NONE + bytes(8), _joined, _step, scratch)
    before = F.conv(F.hex(F.substring("carry", 33, 8)), 16, 10).cast("long")
    carried = carried.select("conv_id", "k", F.substring("carry", 1, 32).alias("g"), before.alias("before"))
    rows = scratch.save(blocks.join(carried, ["conv_id", "k"]))

    kind = ["k", "g", "block"]
    classes = rows.groupBy(*kind).agg(
        F.min("conv_id").alias("first"), F.count("*").alias("n"), F.any_value("ds").alias("ds"), F.any_value("ns").alias("ns"),
        F.any_value("before").alias("before"),
    )
    classes = scratch.save(classes)
    alone = classes.groupBy("k", "g").agg(F.count("*").alias("kinds"), F.min("block").alias("block")).where("kinds = 1")
    alone = scratch.save(alone.select(*kind, F.lit(True).alias("alone")))
    classes = scratch.save(classes.join(alone, kind, "left").withColumn("alone", F.coalesce("alone", F.lit(False))))

    # the nodes in a block: those of diverging groups from a row for each class and turn
    apart = scratch.save(_turn_by_turn(classes.where("not alone")))
    place = ["k", "g", "i", "chain"]
    met = scratch.save(
        apart.groupBy(*place).agg(
            F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.any_value("up").alias("up"),
            F.any_value(_at("ns", "i")).alias("n_bytes"), F.any_value(_start("i")).alias("start"),
            F.max(F.when(_ends_at("i"), F.col("block"))).alias("end_block"),
        )
    )
    below = met.where("i > 0")
    kids = below.groupBy("k", "g", "i", "up").agg(F.count("*").alias("kids"))
    parents = met.select("k", "g", (F.col("i") + 1).alias("i"), F.col("chain").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    parents = scratch.save(parents.join(kids, ["k", "g", "i", "up"]))
    below = look_up(below, parents, ["k", "g", "i", "up"], "kids")
    straight = classes.where("alone").select("*", F.explode(F.expr("sequence(1, size(ds))")).alias("i")).where("size(ds) > 0")
    straight = straight.select(
        "k", "i", F.col("first").alias("conv_id"), F.col("n").alias("n_convs"), F.col("first").alias("parent_conv_id"),
        _at("ns", "i").alias("n_bytes"), _start("i").alias("start"),
    )
    columns = ["conv_id", (F.col("k") * BLOCK + F.col("i")).alias("depth"), "parent_conv_id", "n_convs", "n_bytes", "start"]
    root = everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("start"),
    )
    nodes = scratch.save(below.select(*columns).unionByName(straight.select(*columns)).unionByName(root))
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    kids = kids.agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = scratch.save(nodes)

    # the depth from which a member owns its nodes, the bytes of the turns before, and whether it ends at a leaf
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("owns"), F.min_by("start", "depth").alias("others"), F.max(F.col("n_children") == 0).alias("leaf")
    )
    totals = rows.groupBy("conv_id").agg(F.sum("size").alias("total"), F.count("*").alias("blocks"))
    owners = scratch.save(
        totals.join(owners, "conv_id", "left").select(
            "conv_id", "blocks", "owns", F.coalesce("others", "total").alias("others"),
            F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"),
        )
    )
    known = look_up(rows.select("conv_id", *kind, "before", "size"), owners.drop("owns"), ["conv_id"], "blocks")
    behind = F.greatest(F.col("others") - F.col("before") - F.col("size"), F.lit(0))
    sums = known.groupBy(*kind).agg(F.sum("leaf").alias("leaves"), F.sum(behind).alias("behind"))
    owns = owners.select(F.col("conv_id").alias("first"), "owns", "blocks")
    counted = scratch.save(look_up(classes.join(sums, kind), owns, ["first"], "blocks"))
    apart = _turn_by_turn(counted.where("not alone"), "leaves", "behind", "owns").where("i > 0").groupBy(*place)
    apart = apart.agg(F.min("first").alias("conv_id"), F.sum("leaves").alias("n_leaves"), F.sum(_saved("i")).alias("saved"))
    straight = counted.where("alone and size(ds) > 0").select("*", F.explode(F.expr("sequence(1, size(ds))")).alias("i"))
    straight = straight.select("k", "i", F.col("first").alias("conv_id"), F.col("leaves").alias("n_leaves"), _saved("i").alias("saved"))
    columns = ["conv_id", (F.col("k") * BLOCK + F.col("i")).alias("depth"), "n_leaves", "saved"]
    top = nodes.agg(
        F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves"), F.sum((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")
    )
    top = nodes.where("depth = 0").select("conv_id", "depth").crossJoin(F.broadcast(top))  # one row each
    sums = apart.select(*columns).unionByName(straight.select(*columns)).unionByName(top)
    found = nodes.join(sums, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"
    )

    last = met.where("end_block is not null").select("k", "g", F.col("end_block").alias("block"), F.col("conv_id").alias("owner"))
    last = last.unionByName(classes.where(f"alone and size(ds) < {BLOCK}").select(*kind, F.col("first").alias("owner")))
    last = scratch.save(last.join(classes.select(*kind, "n"), kind))
    ends = look_up(rows.where(f"size(ds) < {BLOCK}").select("conv_id", *kind, F.size("ds").alias("i")), last, kind, "n")
    return Trie(found, ends.select("conv_id", "owner", (F.col("k") * BLOCK + F.col("i")).alias("depth")))


def _turn_by_turn(classes: DataFrame, *more: str) -> DataFrame:
    """A row for each class and number ``i`` of its first turns, none included; ``chain``
    names these turns and ``up`` all but the last of them."""

    def chain(i):
        joined = F.aggregate(F.slice("ds", F.lit(1), F.greatest(i, F.lit(0))), F.lit(b""), lambda whole, d: F.concat(whole, d))
        return F.unhex(F.sha2(joined, 256))

    each = F.transform(F.sequence(F.lit(0), F.size("ds")), lambda i: F.struct(i.alias("i"), chain(i).alias("chain"), chain(i - 1).alias("up")))
    kept = ["k", "g", "block", "first", "n", "ds", "ns", "before", *more]
    return classes.select(*kept, F.explode(each).alias("x")).select(*kept, "x.*")


def _at(array: str, i: str) -> F.Column:
    return F.get(array, F.col(i) - 1)


def _start(i: str) -> F.Column:
    """Bytes of the turns before turn ``i``."""
    return F.expr(f"before + aggregate(slice(ns, 1, greatest({i} - 1, 0)), 0L, (s, n) -> s + n)")


def _ends_at(i: str) -> F.Column:
    return (F.col(i) == F.size("ds")) & (F.size("ds") < BLOCK)


def _saved(i: str) -> F.Column:
    """Bytes that the members of a class don't own, from turn ``i`` of the block on. In a
    class only its first member can own a turn."""
    rest = f"transform(slice(ns, {i}, size(ns)), (n, j) -> struct(n, {i} + j as e))"
    return F.expr(
        f"behind + aggregate({rest}, 0L, (s, x) -> s + x.n * (n - if(k * {BLOCK} + x.e >= owns, 1L, 0L)))"
    )
