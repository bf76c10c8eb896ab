"""Reply trees as conversations for training.

Messages name the message they reply to. Paths from a root to a leaf are found
by self-joins that double their reach: after k rounds a message knows its
ancestor 2**k replies up and the summed scores between, but no message between.
So a chain of n replies takes log2(n) joins of at most n short rows. Leaves are
ranked inside their tree by the summed scores of their path; only for the chosen ones the
messages of the path are then found, by the same joins backwards, and become one text.

The template frames each turn by control strings. Control strings inside a
text are escaped, so a formatted text can be read back exactly, and the
characters to learn from are known as spans of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.scratch import Scratch

# Control strings of the template. A turn opens with the mark and
# its role; the text follows on the next line and ends before the closing mark.
OPEN, ROLE_END, CLOSE, ESCAPE = "<|turn|>", "\n", "<|end|>", "\\"
LEARNED_ROLE = "assistant"
# Strings that mean something to common templates, kept apart as well.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
# What stands behind a backslash in place of a character that a control string
# could begin with; a line end is replaced in roles only.
_CODE = {ESCAPE: ESCAPE, "<": "l", "[": "b", "\n": "n"}
_MEANS = {code: char for char, code in _CODE.items()}


def escape(text: str, inside_role: bool = False) -> str:
    """The text without any character that could begin a control string."""
    for char, code in _CODE.items():
        if char != "\n" or inside_role:
            text = text.replace(char, ESCAPE + code)
    return text


def unescape(text: str) -> str:
    out, i = [], 0
    while True:
        j = text.find(ESCAPE, i)
        if j < 0:
            return "".join(out) + text[i:]
        out += [text[i:j], _MEANS[text[j + 1]]]
        i = j + 2


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of it to learn from: the assistant's texts."""
    out, spans, size = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role, True) + ROLE_END
        body = escape(text)
        out += [head, body, CLOSE]
        if role == LEARNED_ROLE:
            spans.append((size + len(head), size + len(head) + len(body)))
        size += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text. Escaped texts hold no control string, so the
    next closing mark is the one of the turn."""
    turns, i = [], 0
    while i < len(formatted):
        if not formatted.startswith(OPEN, i):
            raise ValueError(f"no turn begins at {i}")
        line = formatted.index(ROLE_END, i)
        end = formatted.index(CLOSE, line)
        turns.append((unescape(formatted[i + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        i = end + len(CLOSE)
    return turns


class Paths(NamedTuple):
    """``leaves`` has ``tree, leaf, score``; ``jumps[k]`` has ``tree, node, up``, the
    ancestor 2**k replies above each message that has one."""

    leaves: DataFrame
    jumps: list[DataFrame]


def paths(messages: DataFrame, scratch: Scratch) -> Paths:
    """The leaves of ``messages(tree, node, parent, score)`` with the summed scores of
    their paths.

    A message whose parent is null or not there is a root. Nodes are unique in a tree.
    A cycle has no root and gives no path.
    """
    known = messages.select("tree", F.col("node").alias("parent")).distinct()
    rooted = messages.join(known.withColumn("there", F.lit(True)), ["tree", "parent"], "left")
    # a stretch of path from a message up to before ``up``; without ``up`` it begins at a root
    level = scratch.save(
        rooted.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"))
    )
    parents = level.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    rooted_parts, jumps = [level.where("up is null")], [level.where("up is not null")]
    longest = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # what has no root after as many rounds as the largest tree could need leads into a cycle
    for _ in range(longest.bit_length()):
        if jumps[-1].isEmpty():
            break
        above = reduce(DataFrame.unionByName, rooted_parts, jumps[-1]).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more")
        )
        level = scratch.save(
            jumps[-1].join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"))
        )
        rooted_parts.append(level.where("up is null"))
        jumps.append(level.where("up is not null"))
    leaves = reduce(DataFrame.unionByName, rooted_parts).join(parents, ["tree", "node"], "left_anti")
    return Paths(leaves.select("tree", F.col("node").alias("leaf"), "score"), [x.select("tree", "node", "up") for x in jumps])


def steps(leaves: DataFrame, jumps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``tree, leaf, score, node, above`` for each message on the path of each of
    ``leaves(tree, leaf, score)``; ``above`` counts its replies up from the leaf.

    What is known below 2**k replies up is sent 2**k further, so each message of a
    path is made once."""
    parts = [leaves.select("tree", "leaf", "score", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))]
    for k, jump in enumerate(jumps):
        so_far = reduce(DataFrame.unionByName, parts)
        further = so_far.join(jump, ["tree", "node"])
        further = scratch.save(further.select("tree", "leaf", "score", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above")))
        if further.isEmpty():
            break
        parts.append(further)
    return reduce(DataFrame.unionByName, parts)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, masks = [], []
        for turns in batch.column(3).to_pylist():
            text, spans = render([(t["role"], t["text"]) for t in turns])
            texts.append(text)
            masks.append([{"start": a, "end": b} for a, b in spans])
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array(masks, pa.list_(span))],
            names=["tree", "leaf", "score", "formatted", "loss"],
        )


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """``tree, leaf, score, formatted, loss`` for the ``best`` paths of each tree of
    ``messages(tree, node, parent, role, text, score)``.

    Paths are ranked by the sum of their messages' scores (null counts as 0),
    ties by the smaller leaf. ``loss`` has the spans of ``formatted`` to learn from.

    Null roles and texts count as empty. Messages of a null tree or node are
    left out, as they can't be replied to; of several messages with one tree
    and node the smallest by role, text and parent counts. A message whose
    parent is missing begins a tree's path. Other columns are ignored; an empty
    table gives an empty table.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    named = messages.where("tree is not null and node is not null").select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.col("score").cast("double"),
    )
    one = named.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m"))
    one = scratch.save(one.select("tree", "node", "m.*"))
    found = paths(one.select("tree", "node", "parent", "score"), scratch)
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen = scratch.save(found.leaves.withColumn("place", place).where(F.col("place") <= best).drop("place"))
    way = steps(chosen, found.jumps, scratch).join(one.select("tree", "node", "role", "text"), ["tree", "node"])
    turn = F.struct((-F.col("above")).alias("at"), "role", "text")
    whole = way.groupBy("tree", "leaf").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    span = "array<struct<start:long,end:long>>"
    kind = dict(whole.dtypes)
    return whole.select("tree", "leaf", "score", "turns").mapInArrow(
        _format, f"tree {kind['tree']}, leaf {kind['leaf']}, score double, formatted string, loss {span}"
    )
