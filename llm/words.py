"""Words of Arrow text columns as numpy arrays: where they are and 64-bit hashes of them.

Tasks get their rows as Arrow batches, and the functions here work on the byte
buffers of the text column, without a Python object per text or word. All word
separators in use are ASCII, so UTF-8 bytes can be cut without decoding.

The hash of a word of up to 64 bytes is a polynomial in its bytes modulo 2**64,
finished by a bit mixer, and made with running sums. Polynomials of that modulus
are blind to some patterns of a thousand bytes (Thue-Morse words), so a longer
word is hashed by BLAKE2. Window hashes are made by doubling: the hash of a run of
2k words mixes those of its halves, and a run of any length is covered by two
runs of a power of two. The mixer between the levels leaves no sum of terms that
could cancel, whatever the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 18
# Longer words, in bytes, are hashed one by one.
LONG_WORD = 64

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)
_LEFT, _RIGHT = _U64(0xD1342543DE82EF95), _U64(0xAEF17502108EF2D9)
_random = np.random.default_rng(20240229)
_BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)

# ASCII letters lower-cased
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# [^\x20\x09-\x0D]
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

# [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = True
ALPHANUMERIC[0x61:0x7B] = True
ALPHANUMERIC[0x41:0x5B] = True
ALPHANUMERIC[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base = base
        self.inverse = _U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):
        return _Powers, (self.base,)  # the tables don't travel with a task

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 2)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_byte_powers = _Powers(_BASE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows in them.
    Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        at = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def is_null(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


@dataclass
class Block:
    """The words of the texts ``first`` to ``last`` of a batch.

    ``start`` and ``end`` are places in ``data``; the words of text ``first + i``
    are those from ``at[i]`` to ``at[i + 1]``.
    """

    first: int
    last: int
    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def texts(self) -> int:
        return self.last - self.first

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        """For each word, its text counted from ``first``."""
        return np.repeat(np.arange(self.texts()), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        up, down = _byte_powers.get(len(self.data) + 1)
        value = _BYTE_VALUE[LOWER] if lower else _BYTE_VALUE
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(value[self.data] * up[: len(self.data)], out=sums[1:])
        found = mix((sums[self.end] - sums[self.start]) * down[self.start])
        for i in np.flatnonzero(self.end - self.start > LONG_WORD):
            own = self.data[self.start[i] : self.end[i]]
            digest = hashlib.blake2b((LOWER[own] if lower else own).tobytes(), digest_size=8).digest()
            found[i] = int.from_bytes(digest, "little")
        return found


def cuts(at: np.ndarray, limit: int = BLOCK_BYTES, texts: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``texts`` rows with at most ``limit`` bytes, or one row."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + texts, n)
        yield first, last
        first = last


def blocks(column: pa.Array, word: np.ndarray) -> Iterator[Block]:
    """The words of a text column, some texts at a time. ``word`` tells which
    bytes belong to words."""
    raw, at = text_bytes(column)
    for first, last in cuts(at):
        yield _block(raw, at, first, last, word)


def _block(raw: np.ndarray, at: np.ndarray, first: int, last: int, word: np.ndarray) -> Block:
    low = int(at[first])
    data = raw[low : int(at[last])]
    text_at = at[first : last + 1] - low
    inside = word[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[text_at] = False  # a text starts and ends outside a word
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[text_at] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return Block(first, last, data, text_at, start, end, np.searchsorted(start, text_at))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, one per start."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    runs, width = words, 1
    while 2 * width <= length:
        runs = _joined(runs[: len(runs) - width], runs[width:], width)
        width *= 2
    return _joined(runs[:n], runs[length - width :][:n], length)


def _joined(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    return mix(mix(left * _LEFT + _U64(length)) + right * _RIGHT)


def window_starts(at: np.ndarray, length: int) -> np.ndarray:
    """Which starts of runs over all words of a block stay inside one text."""
    n = int(at[-1])
    good = np.zeros(max(n - length + 1, 0), dtype=bool)
    if len(good):
        size = np.diff(at)
        room = np.maximum(size - length + 1, 0)
        # +1 where a text's valid starts begin, -1 behind them
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, at[:-1], (room > 0).astype(np.int64))
        np.add.at(edge, at[:-1] + room, -(room > 0).astype(np.int64))
        good[:] = np.cumsum(edge)[: len(good)] > 0
    return good
