"""Token ids of many texts at once, by units that tokenizers never join.

A single space or line end between two characters that are no white space begins a token, so a
text can be cut there. Equal units of a piece are encoded once, and what was encoded is remembered
as plain numbers, up to a number of bytes and for as long as a task lives.
"""

from __future__ import annotations

import itertools
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from stratafill.llm.words import buffers

REMEMBERED_BYTES = 64 << 20


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a single space or line end stands between two characters that are no white space.

    U+2581, which some vocabularies write for a space, counts as white space.
    """
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1F))
    own = np.flatnonzero((data == 0x20) | (data == 0x0A))
    d = np.concatenate([data, np.zeros(2, np.uint8)])
    first, second, third = d[:-2], d[1:-1], d[2:]
    two = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
    # U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+2581 (a space to B), U+3000
    three = (((first == 0xE1) & (second == 0x9A) & (third == 0x80))
             | ((first == 0xE2) & (second == 0x80) & (
                 (third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)))
             | ((first == 0xE2) & (second == 0x81) & (third == 0x9F))
             | ((first == 0xE2) & (second == 0x96) & (third == 0x81))
             | ((first == 0xE3) & (second == 0x80) & (third == 0x80)))
    for at, size in ((np.flatnonzero(two), 2), (np.flatnonzero(three), 3)):
        for k in range(size):
            white[at + k] = True
    own = own[(own > 0) & (own < len(data) - 1)]
    return own[~white[own - 1] & ~white[own + 1]]


def units_of(data: np.ndarray, starts: np.ndarray, cut: bool = True
             ) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, number of unit) of all units in order, and the distinct units.

    ``starts`` are the first bytes of the texts in ``data``, none of which is empty. Without
    ``cut`` each text is a unit.
    """
    edges = distinct(np.concatenate([starts, cuts(data)])) if cut else starts
    text = np.searchsorted(starts, edges, side="right") - 1
    units = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(edges),
        [None, pa.py_buffer(np.append(edges, len(data)).astype(np.int64)), pa.py_buffer(data)])
    coded = units.dictionary_encode()
    return text, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return values[fresh]


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, n[i] of them, for each i."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class Lists:
    """Lists of numbers, end to end: list i is ``flat[edges[i]:edges[i + 1]]``."""

    def __init__(self, flat: np.ndarray | None = None, edges: np.ndarray | None = None):
        self.flat = np.zeros(0, np.int32) if flat is None else flat
        self.edges = np.zeros(1, np.int64) if edges is None else edges

    def extend(self, lists: list[list[int]]) -> None:
        more = np.fromiter(itertools.chain.from_iterable(lists), np.int32)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.flat = np.concatenate([self.flat, more])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(n)])

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.edges)

    def take(self, at: np.ndarray) -> Lists:
        n = self.sizes[at]
        return Lists(self.flat[ragged(self.edges[at], n)], np.append(0, np.cumsum(n)))


def cuttable(path: str) -> bool:
    """Whether the vocabulary file is a byte-level one, whose tokens no unit's edge can change."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    before = model.get("pre_tokenizer") or {}
    return (before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
            and before.get("use_regex", True) and not model.get("normalizer")
            and not any(set(t["content"]) & set(" \n") for t in model.get("added_tokens", [])))


def byte_of_character() -> dict[str, int]:
    """How byte-level vocabularies write bytes: those that do not print from character 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(other)}


def merger(path: str):
    """tiktoken over the vocabulary of a tokenizer file, or None if that would be another one."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    ids = model["model"].get("vocab", {})
    merges = [x if isinstance(x, str) else " ".join(x) for x in model["model"].get("merges", [])]
    in_order = [ids.get(x.replace(" ", "")) for x in merges] == list(range(256, 256 + len(merges)))
    if model["model"].get("type") != "BPE" or not cuttable(path) or not in_order:
        return None
    byte_of = byte_of_character()
    ranks = {bytes(byte_of[c] for c in x): i for x, i in ids.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("units", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


# The pattern that byte-level pre-tokenizers cut by.
_BYTE_LEVEL = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
               r"|\s+(?!\S)|\s+")


class Vocabulary:
    """A vocabulary file of ``tokenizers``; of a fixed size.

    If it is a byte-level one whose merges are in the order of their ids, texts without its
    special tokens are merged by tiktoken on the same vocabulary, which gives the same ids
    several times faster. ``ordinary``: special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, ordinary: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.special = [] if ordinary else [
            t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut, self.merger = cuttable(path), merger(path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.merger is None:
            return self._encode(texts)
        odd = [i for i, x in enumerate(texts) if any(s in x for s in self.special)]
        found = list(map(self.merger.encode_ordinary, texts))
        for i, ids in zip(odd, self._encode([texts[i] for i in odd]), strict=True):
            found[i] = ids
        return found

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str, ordinary: bool = False) -> Vocabulary:
    """Read once per process."""
    return Vocabulary(path, ordinary)


class UnitTokens:
    """Token ids of texts by a vocabulary file of ``tokenizers``, without special tokens added."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.held = Lists(), 0

    def __call__(self, column: pa.Array) -> tuple[Lists, np.ndarray]:
        """The ids of the units of all texts in order, and per text its first unit (and an end)."""
        data, offsets = buffers(column)
        some = np.flatnonzero(np.diff(offsets))
        text, unit, units = units_of(data, offsets[some], self.vocabulary.cut)
        if self.held > REMEMBERED_BYTES:
            self._forget()
        listed = units.to_pylist()
        new = [u for u in listed if u not in self.known]
        if new:
            found = self.vocabulary.encode([u.decode("utf-8", "replace") for u in new])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)),
                                  strict=True))
            before = len(self.ids.flat)
            self.ids.extend(found)
            self.held += sum(map(len, new)) + 150 * len(new) + 4 * (len(self.ids.flat) - before)
        at = np.array([self.known[u] for u in listed], np.int64)
        return self.ids.take(at[unit]), np.searchsorted(some[text], np.arange(len(column) + 1))
