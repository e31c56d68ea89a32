"""A minimal perfect hash of distinct 64-bit keys, in buckets that are built apart.

Each key belongs to a bucket by its remainder. In a bucket, keys are thrown on twice as many
places as there are keys; who is alone on a place has it, the others go to the next level. The
number of a key is the number of taken places before its own, counted over the levels and their
buckets, so n keys have the numbers 0 to n - 1. A key that was not among them also gets some
number; so the keys are kept in the order of their numbers, and a lookup compares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from stratafill.llm.words import mix

BUCKET_KEYS = 1 << 15
PLACED = "bucket bigint, level int, places bigint, taken binary, keys binary"
_STEP = 0x9E3779B97F4A7C15


def buckets_for(keys: int) -> int:
    """An odd number of buckets, so that remainders do not follow the low bits of the keys."""
    return (keys // BUCKET_KEYS) | 1


def _place(keys: np.ndarray, level: int, places: np.ndarray | int) -> np.ndarray:
    salt = np.uint64((level + 1) * _STEP & 0xFFFFFFFFFFFFFFFF)
    return (mix(keys.view(np.uint64) + salt) % np.asarray(places, np.uint64)).astype(np.int64)


def place_bucket(bucket: int, keys: np.ndarray) -> list[tuple[int, int, int, bytes, bytes]]:
    """Rows of ``PLACED`` for the distinct keys (int64) of one bucket, a row per level."""
    rows, level = [], 0
    while len(keys):
        places = 2 * len(keys) + 62
        at = _place(keys, level, places)
        alone = np.bincount(at, minlength=places)[at] == 1
        order = np.argsort(at[alone])
        taken = np.zeros(places, bool)
        taken[at[alone]] = True
        rows.append((bucket, level, places, np.packbits(taken).tobytes(),
                     keys[alone][order].tobytes()))
        keys, level = keys[~alone], level + 1
    return rows


def place_group(key: tuple, group: pa.Table) -> pa.Table:
    """``place_bucket`` for ``groupBy("bucket").applyInArrow``; the keys are in ``key``."""
    rows = place_bucket(key[0].as_py(), group.column("key").to_numpy().astype(np.int64))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)],
                    names=["bucket", "level", "places", "taken", "keys"])


class PerfectHash:
    """Numbers of keys, from all rows that ``place_bucket`` made with ``buckets`` buckets."""

    def __init__(self, placed: pa.Table, buckets: int):
        self.buckets = buckets
        rows = sorted(zip(*(placed.column(c).to_pylist() for c in
                            ("level", "bucket", "places", "taken", "keys")), strict=True))
        levels = max((r[0] for r in rows), default=-1) + 1
        self.places = np.zeros((levels, buckets), np.int64)
        self.first = np.zeros((levels, buckets), np.int64)
        taken, at = [], 0
        for level, bucket, places, bits, _ in rows:
            self.places[level, bucket], self.first[level, bucket] = places, at
            taken.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=places))
            at += places
        self.taken = np.concatenate([*taken, np.zeros(0, np.uint8)]).astype(bool)
        self.before = np.append(0, np.cumsum(self.taken, dtype=np.int32))[:-1].astype(np.int32)
        self.keys = np.concatenate(
            [*[np.frombuffer(r[4], np.int64) for r in rows], np.zeros(0, np.int64)])

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key (int64), -1 for keys that were not placed."""
        out = np.full(len(keys), -1, np.int64)
        bucket = keys % self.buckets
        left = np.arange(len(keys))
        for level in range(len(self.places)):
            left = left[self.places[level, bucket[left]] > 0]
            if not len(left):
                break
            b = bucket[left]
            at = self.first[level, b] + _place(keys[left], level, self.places[level, b])
            hit = self.taken[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        found = out >= 0
        found[found] = self.keys[out[found]] == keys[found]
        out[~found] = -1
        return out
