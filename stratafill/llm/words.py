"""Words of many texts at once, as arrays over the UTF-8 bytes of an Arrow column.

A word is a run of ASCII letters and digits and of non-ASCII bytes; A-Z count as a-z. Each word
gets a 64-bit hash of its bytes. Work goes in pieces of a bounded number of bytes, so memory
does not follow the number of rows; only a single text longer than that makes a larger piece.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
SMALL_PIECE = 1 << 20  # where a piece takes many times its bytes
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def _fold_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    keep = [*range(48, 58), *range(97, 123), *range(128, 256)]
    table[keep] = keep
    table[65:91] = np.arange(97, 123)
    return table


FOLD = _fold_table()


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (the finalizer of the splitmix generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    for out, base in ((up, _BASE), (down, inverse)):
        filled = 1
        while filled < n:
            step = min(filled, n - filled)
            out[filled:filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
    return up, down


class Words:
    """``hashes`` of all words in order; text i has the words ``bounds[i]:bounds[i + 1]``.

    ``starts`` and ``ends`` are byte positions in ``data``, ``offsets`` those of the texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        folded = FOLD[data]
        inside = folded != 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        self.ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        up, down = _powers(1 << max(12, int(n).bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self._sums, self._down = sums, down
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.hashes)

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash of its first ``size`` bytes) of the words that are longer."""
        at = np.flatnonzero(self.ends - self.starts > size)
        first = self.starts[at]
        value = (self._sums[first + size] - self._sums[first]) * self._down[first]
        return at, mix(value ^ np.uint64(size))

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def owner_at(self, word: int) -> int:
        return int(np.searchsorted(self.bounds, word, side="right")) - 1

    def bytes_of(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last - 1``, folded, with one space between."""
        return b" ".join(
            FOLD[self.data[a:b]].tobytes()
            for a, b in zip(self.starts[first:last], self.ends[first:last], strict=True))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes together."""
    _, offsets = buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def words_of(column: pa.Array) -> Words:
    return Words(*buffers(column))


def give_back() -> None:
    """Return freed memory to the system; a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def per_piece(function: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text",
              most: int = PIECE_BYTES):
    """A function for ``mapInArrow`` that sees bounded pieces."""
    def run(batches):
        try:
            for batch in batches:
                for piece in pieces(batch, column, most):
                    yield function(piece)
        finally:
            give_back()
    return run


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of ``size`` words; a shorter text has one run of all its words."""
    h, bounds = words.hashes, words.bounds
    owner = words.owner
    count = np.diff(bounds)
    last = bounds[1:][owner] if len(owner) else np.zeros(0, np.int64)
    at = np.flatnonzero(np.arange(len(h)) + size <= last)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + h[at + k]
    texts = owner[at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        more = []
        for i in short:
            value = int(count[i])
            for x in h[bounds[i]:bounds[i + 1]]:
                value = (value * _BASE + int(x)) & 0xFFFFFFFFFFFFFFFF
            more.append(value)
        texts = np.concatenate([texts, short])
        out = np.concatenate([out, np.array(more, np.uint64)])
        order = np.argsort(texts, kind="stable")
        texts, out = texts[order], out[order]
    return texts, mix(out)


def lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """A list column: row i gets the values whose ``owner`` (ascending) is i."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)
