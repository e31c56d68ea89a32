"""Words between white space of many texts at once, as arrays over an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from stratafill.llm.words import buffers

_SPACE = 0x20
#: ASCII space, tab, line feed, vertical tab, form feed, carriage return
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class SpacedWords:
    """All words in order, each with one space behind it in ``data``.

    Word i is ``data[starts[i]:starts[i + 1] - 1]``; text t has the words
    ``bounds[t]:bounds[t + 1]``. Null counts as empty. ``lower`` makes A-Z a-z.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, offsets = buffers(column)
        if lower:
            data = _LOWER[data]
        data = np.insert(data, offsets[1:], _SPACE)
        offsets = offsets + np.arange(len(offsets))
        gap = _GAPS[data]
        before = np.ones(len(data), bool)
        before[1:] = gap[:-1]
        first = np.flatnonzero(~gap & before)
        closing = np.flatnonzero(gap & ~before)
        data[closing] = _SPACE
        self.data = data[~(gap & before)]
        self.starts = np.zeros(len(first) + 1, np.int64)
        np.cumsum(closing - first + 1, out=self.starts[1:])
        self.bounds = np.searchsorted(first, offsets)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def array(self) -> pa.Array:
        """The words, each with its space, as a binary column."""
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self),
            [None, pa.py_buffer(self.starts), pa.py_buffer(self.data)])

    def numbers(self) -> np.ndarray:
        """A number per word; equal words, and only those, have equal numbers."""
        return self.array().dictionary_encode().indices.to_numpy().astype(np.int64)
