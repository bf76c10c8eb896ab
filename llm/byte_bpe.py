"""Byte-level BPE by dynamic programming over prefixes.

Merging by rank gives every byte string one encoding. Two facts make it local:
each prefix of a string has one last token, and a row of tokens is the encoding
of its bytes exactly if each two neighbours encode as themselves. So the last
token of a prefix is the one token ending there whose left neighbour, the last
token of the shorter prefix, goes together with it. The table of last tokens
takes exact appends, and after an edit only the entries near it are made anew.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.scratch import small_batches

# Entries of each memory of a Python worker; a full one starts anew.
REMEMBERED = 200_000
# Bytes of a piece up to which its prefixes are remembered beyond it.
SHORT = 64


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a file, read once by each Python worker, which keeps it
    and what it remembers for its later tasks."""
    kept = sys.modules.setdefault("_byte_bpe_of_worker", ModuleType("_byte_bpe_of_worker")).__dict__
    if (path, pattern) not in kept:
        kept[path, pattern] = Vocabulary(path, pattern)
    return kept[path, pattern]


class Vocabulary:
    """Ranks of byte strings, read from lines of base64 text and rank."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(text): int(rank) for text, rank in map(bytes.split, lines)}
        self.bytes_of = {rank: text for text, rank in self.rank.items()}
        self.name = {rank: str(rank) for rank in self.bytes_of}
        self.longest = max(map(len, self.rank))
        # every ending of a token: its rank, or -1 if it is no token itself
        self.endings = {text[i:]: -1 for text in self.rank for i in range(len(text))} | self.rank
        self.split = regex.compile(pattern).findall
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.ends: dict[bytes, int] = {b"": -1}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; none for a byte,
        and none for a token that merging never reaches."""
        if token not in self.made_of:
            parts = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))]
            while len(parts) > 2:
                ranks = [self.rank.get(a + b, token) for a, b in zip(parts, parts[1:], strict=False)]
                i = ranks.index(min(ranks))
                if ranks[i] == token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.made_of[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.made_of[token]

    def reached(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def together(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their bytes; -1 on the left
        stands for the beginning.

        While merging, the right end of the left token and the left end of the
        right one grow from single bytes. They stay apart if no two ends that
        are there at one time would be merged before one of them grows.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.reached(right) and (left < 0 or self._apart(left, right))
            if len(self.pairs) >= REMEMBERED // 2:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _apart(self, x: int, y: int) -> bool:
        rank, text = self.rank, self.bytes_of
        x_grows = y_grows = 1 << 62  # the ranks at which the ends grow further
        while True:
            joined = rank.get(text[x] + text[y])
            # of two equal ranks the one further left is merged first
            if joined is not None and joined < x_grows and joined <= y_grows:
                return False
            # back to the time before the later of the two was made
            if x > y:
                parts = self.halves(x)
                if parts is None:
                    return True
                x_grows, x = x, parts[1]
            else:
                parts = self.halves(y)
                if parts is None:
                    return True
                y_grows, y = y, parts[0]

    def end_of(self, prefix: bytes) -> int:
        """The last token of a prefix, remembered for all pieces that begin alike."""
        known = self.ends.get(prefix)
        if known is None:
            known = self._end_of(prefix)
            if len(self.ends) >= REMEMBERED // 2:
                self.ends.clear()
                self.ends[b""] = -1
            self.ends[prefix] = known
        return known

    def _end_of(self, prefix: bytes) -> int:
        endings, ends, pairs = self.endings, self.ends, self.pairs
        fits = []
        for start in range(len(prefix) - 1, -1, -1):
            token = endings.get(prefix[start:])
            if token is None:
                break
            if token >= 0:
                fits.append((start, token))
        while fits:
            start, token = fits.pop()
            before = ends.get(prefix[:start])
            if before is None:
                before = self.end_of(prefix[:start])
            good = pairs.get(before << 32 | token)
            if good or good is None and self.together(before, token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def piece(self, text: str) -> tuple[int, ...]:
        """The tokens of one match of the pattern."""
        known = self.pieces.get(text)
        if known is None:
            data = text.encode()
            whole = self.rank.get(data)
            if whole is not None:
                known = (whole,)
            elif len(data) > SHORT:
                return tuple(Prefixes(self, data).tokens())
            else:
                found = []
                while data:
                    found.append(self.end_of(data))
                    data = data[: -len(self.bytes_of[found[-1]])]
                known = tuple(found[::-1])
            if len(self.pieces) >= REMEMBERED // 2:
                self.pieces.clear()
            self.pieces[text] = known
        return known

    def pieces_of(self, text: str) -> tuple[int, ...]:
        found = self.split(text)
        return self.piece(found[0]) if len(found) == 1 else tuple(chain.from_iterable(map(self.piece, found)))

    def encode(self, text: str) -> list[int]:
        """The tokens of all matches of the pattern in a text.

        A space is in one match with what follows it, or in a run of blanks. So
        the matches in a part between spaces that neither begins nor ends with
        a blank depend on that part alone, and its tokens can be remembered.
        The pattern itself cuts the parts, and all runs of blanks.
        """
        parts = text.split(" ")
        known, n = self.parts, len(parts)
        found: list = [known.get(p) for p in parts]
        found[0], at = None, 0
        while True:
            try:
                at = found.index(None, at)
            except ValueError:
                return list(chain.from_iterable(found))
            part = parts[at]
            if at and _closed(part):
                # letters are one match with the space before them
                found[at] = self.piece(" " + part) if part.isalpha() else self.pieces_of(" " + part)
                if len(part) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = found[at]
                at += 1
                continue
            stop = at + 1
            while stop < n and not _closed(parts[stop]):
                stop += 1
            found[at] = self.pieces_of((" " if at else "") + " ".join(parts[at:stop]))
            found[at + 1 : stop] = [()] * (stop - at - 1)
            at = stop

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))


def _closed(part: str) -> bool:
    return part != "" and not part[0].isspace() and not part[-1].isspace()


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last = [-1]
        self.append(data)

    def _end_at(self, i: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        for start in range(i - 1, max(i - v.longest, 0) - 1, -1):
            token = v.endings.get(bytes(data[start:i]))
            if token is None:
                break
            if token >= 0 and v.together(last[start], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        self.data += data
        for i in range(begin + 1, len(self.data) + 1):
            self.last.append(self._end_at(i))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of the bytes from ``start`` to ``stop``; returns how
        many entries were made anew. Behind the edit they end when as many
        entries in a row as a token can be long are what they were before."""
        old, shift = self.last, len(data) - (stop - start)
        size = len(self.data) + shift
        self.data[start:stop] = data
        self.last = old[: start + 1]
        same, i = 0, start
        while i < size and same < self.vocabulary.longest:
            i += 1
            self.last.append(self._end_at(i))
            behind = i > start + len(data)
            same = same + 1 if behind and self.last[i] == old[i - shift] else 0
        self.last += old[i - shift + 1 :] if i < size else []
        return i - start

    def tokens(self) -> list[int]:
        found, i = [], len(self.data)
        while i:
            found.append(self.last[i])
            i -= len(self.vocabulary.bytes_of[found[-1]])
        return found[::-1]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            tokens = [v.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs(doc_id, text)``: the tokens of each
    match of ``pattern``, one after the other, without special tokens. A null
    text counts as empty and has no tokens. Ids may be null or repeated, other
    columns are ignored, an empty table gives an empty table."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data`` with the bytes that each row's ``ids`` stand for; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            data = [v.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ``encode`` and ``decode`` of each
    row in one pass, without shipping the tokens. Rows as in ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                tokens = v.encode(text.as_py() or "")
                n.append(len(tokens))
                ids.append(hashlib.sha256(" ".join(map(v.name.__getitem__, tokens)).encode()).hexdigest())
                decoded.append(hashlib.sha256(v.decode(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def revise(edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, n_remade`` for each row of ``edits(doc_id, text, start, stop, new_text)``:
    the encoding of the text once the characters from ``start`` to ``stop`` are
    replaced, made from the old one.

    The text is cut into pieces anew from the last piece that ends before the
    edit. A piece that is cut differently is edited in place in the prefix
    table of the piece where the edit begins; ``n_remade`` counts the table
    entries that were made anew. Null texts count as empty, a null ``start`` as
    the end of the text (an append), a null ``stop`` as ``start``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            ids, remade = [], []
            for text, start, stop, new in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                text, new = text or "", new or ""
                start = len(text) if start is None else start
                stop = start if stop is None else stop
                tokens, n = _revised(v, text, start, stop, new)
                ids.append(tokens)
                remade.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(remade, pa.int64())],
                names=["doc_id", "ids", "n_remade"],
            )

    small_batches(edits.sparkSession)
    rows = edits.select(
        F.col("doc_id").cast("long"), "text", F.col("start").cast("int"), F.col("stop").cast("int"), "new_text"
    )
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_remade long")


def _revised(v: Vocabulary, text: str, start: int, stop: int, new: str) -> tuple[list[int], int]:
    before, after = v.split(text), v.split(text[:start] + new + text[stop:])
    same = 0
    while same < min(len(before), len(after)) and before[same] == after[same]:
        same += 1
    tail = 0
    while tail < min(len(before), len(after)) - same and before[-1 - tail] == after[-1 - tail]:
        tail += 1
    tokens = [t for p in before[:same] for t in v.piece(p)]
    table, remade = Prefixes(v, before[same].encode() if same < len(before) - tail else b""), 0
    for piece in after[same : len(after) - tail]:
        old, data = bytes(table.data), piece.encode()
        head = next((i for i, (a, b) in enumerate(zip(old, data, strict=False)) if a != b), min(len(old), len(data)))
        most = min(len(old), len(data)) - head
        foot = next((i for i in range(most) if old[-1 - i] != data[-1 - i]), most)
        remade += table.replace(head, len(old) - foot, data[head : len(data) - foot])
        tokens += table.tokens()
    return tokens + [t for p in before[len(before) - tail :] for t in v.piece(p)], remade
