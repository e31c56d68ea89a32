"""Periodic runs of words, found with a dictionary of basic factors.

A basic factor is a stretch of 2**k words; equal ones of a text get one name, made from the names
of their two halves. Successive occurrences of a factor that are no more than half its length
apart form an arithmetic progression. In a run of period q, 2**k <= q < 2**(k + 1), the factor at
the start comes again q words on, in a later progression, since the root of a run is no power.
Then the first members or the last members of the two are q apart, or the two touch and the one
q words on is the first of its progression. So a progression proposes its distances, first to
first and last to last, to those of its successors that are within twice the length, which are
four at most, and each member its distance to the first of the next. Neighbouring positions with
one distance propose it once. A proposal is extended to both sides by comparing factors from long
to short, and proposals that end as the same run are one.

Only a factor whose halves both recur can recur, so the longer ones are few: a level sorts the
positions that are left, not the text. Texts are worked on in pieces of a bounded number of bytes;
a single longer text makes a piece of its own, with memory in proportion to its length (times the
logarithm of its longest repeat). Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafill.llm.spaced import SpacedWords
from stratafill.llm.words import per_piece

LEAST_WORDS = 12


def named_factors(words: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], list]:
    """Names per level and, per level, proposals (position, period) in two arrays.

    ``words`` are numbers of words, text i has ``bounds[i]:bounds[i + 1]``. In a level, equal
    factors of a text, and only those, have equal names of 0 or more; a factor that nothing in its
    text equals has a negative name of its own. Periods of level k are 2**k or more and under
    2**(k + 1).
    """
    n = len(words)
    own_name = -1 - np.arange(n, dtype=np.int64)
    end = np.repeat(bounds[1:], np.diff(bounds))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    names = [words.astype(np.int64)]
    same = np.flatnonzero((words[1:] == words[:-1]) & (text[1:] == text[:-1]))
    proposals = [(same, np.ones(len(same), np.int64))]
    at, width, texts = np.arange(n), 1, np.int64(len(bounds))
    while True:
        at = at[at + 2 * width <= end[at]]
        first, second = names[-1][at], names[-1][at + width]
        recur = (first >= 0) & (second >= 0)
        at, first, second = at[recur], first[recur], second[recur]
        if not len(at):
            return names, proposals
        # names beyond the first level belong to one text
        key = first * (max(int(names[-1].max()), 0) + 1) + second
        if width == 1:
            key = key * texts + text[at]
        order = np.argsort(key, kind="stable")
        key, place = key[order], at[order]
        equal = key[1:] == key[:-1]
        several = np.zeros(len(key), bool)
        several[1:] |= equal
        several[:-1] |= equal
        level = own_name.copy()
        start = np.ones(len(key), bool)
        start[1:] = ~equal
        level[place[several]] = (np.cumsum(start) - 1)[several]
        width *= 2
        names.append(level)
        proposals.append(_proposed(place, equal, width))
        at = np.sort(place[several])


def _proposed(place: np.ndarray, equal: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of progressions; ``equal``: the next place has the same factor."""
    joined = equal & (place[1:] - place[:-1] <= width // 2)
    first = place[np.append(True, ~joined)]
    last = place[np.append(~joined, True)]
    factor = np.append(0, np.cumsum(~equal))[np.append(True, ~joined)]
    nth = np.append(0, np.cumsum(~joined))  # the progression of a place
    followed = np.append(factor[1:] == factor[:-1], False)[nth]
    pairs = [(place[followed], first[nth[followed] + 1] - place[followed])]
    for step in range(1, 5):
        same = factor[step:] == factor[:-step]
        for side in (first, last):
            pairs.append((side[:-step][same], (side[step:] - side[:-step])[same]))
    at, gap = (np.concatenate(x) for x in zip(*pairs, strict=True))
    near = (gap >= width) & (gap < 2 * width)
    return at[near], gap[near]


def reach(names: list[np.ndarray], at: np.ndarray, gap: np.ndarray, low: np.ndarray,
          high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch around ``at`` where words ``gap`` apart agree: its first word and its end.

    ``low`` and ``high`` bound the texts of the positions.
    """
    left, right = at.copy(), at.copy()
    for k in range(len(names) - 1, -1, -1):
        width, name = 1 << k, names[k]
        more = np.arange(len(at))
        while len(more):
            x, y = right[more], right[more] + gap[more]
            more = more[y + width <= high[more]]
            x, y = right[more], right[more] + gap[more]
            more = more[name[x] == name[y]]
            right[more] += width
        more = np.arange(len(at))
        while len(more):
            more = more[left[more] - width >= low[more]]
            x = left[more] - width
            more = more[name[x] == name[x + gap[more]]]
            left[more] -= width
    return left, right + gap


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (text, start, end, period) of all runs, by text, start and period.

    A run is a stretch with smallest period q and ``max(least, 2 * q)`` words or more that no
    neighbouring word extends keeping the period. Starts and ends are positions in ``words``.
    """
    names, proposals = named_factors(words, bounds)
    at = np.concatenate([x for x, _ in proposals])
    gap = np.concatenate([x for _, x in proposals])
    order = np.lexsort((at, gap))
    at, gap = at[order], gap[order]
    head = np.ones(len(at), bool)  # neighbours with one distance belong to one run
    head[1:] = (gap[1:] != gap[:-1]) | (at[1:] > at[:-1] + 1)
    at, gap = at[head], gap[head]
    text = np.searchsorted(bounds, at, side="right") - 1
    start, end = reach(names, at, gap, bounds[text], bounds[text + 1])
    long = end - start >= np.maximum(least, 2 * gap)
    found = np.stack([text[long], start[long], end[long], gap[long]], axis=1)
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1]))]
    keep = np.ones(len(found), bool)  # of one stretch, the smallest period
    keep[1:] = (found[1:, 1:3] != found[:-1, 1:3]).any(axis=1)
    found = found[keep]
    return found[np.lexsort((found[:, 3], found[:, 1]))]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapsed(words: SpacedWords, runs: np.ndarray) -> pa.Array:
    """Each text's words with one space between, without those after the first period of a run."""
    n, bounds = len(words), words.bounds
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 2], -1)
    kept = np.cumsum(change)[:-1] == 0
    if kept.all():
        data, starts = words.data, words.starts
    else:
        left = words.array().take(pa.array(np.flatnonzero(kept)))
        starts = np.frombuffer(left.buffers()[1], np.int64)[left.offset:left.offset + len(left) + 1]
        data = np.frombuffer(left.buffers()[2] or b"", np.uint8)
    before = np.append(0, np.cumsum(kept))
    edges = starts[before[bounds]]
    # the space behind the last word of a text goes
    full = np.diff(edges) > 0
    inside = np.ones(len(data), bool)
    inside[edges[1:][full] - 1] = False
    edges = edges - np.append(0, np.cumsum(full))
    return pa.LargeStringArray.from_buffers(
        len(bounds) - 1, pa.py_buffer(edges.astype(np.int64)),
        pa.py_buffer(data[inside])).cast(pa.string())


def _found(least: int):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = SpacedWords(piece.column("text"))
        bounds = words.bounds
        runs = runs_of(words.numbers(), bounds, least)
        text, start, end, period = runs.T
        listed = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(text, np.arange(len(bounds))), pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(start - bounds[text]), pa.array(end - start), pa.array(period)],
                fields=list(_RUN)))
        return pa.RecordBatch.from_arrays(
            [piece.column("_id"), pa.array(np.diff(bounds)), listed, _collapsed(words, runs)],
            names=["_id", "n_words", "runs", "collapsed"])
    return per_piece(run)


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS,
) -> DataFrame:
    """Per row of ``docs``: _id, n_words, runs (by start, then period) and the collapsed text.

    Words are what stands between ASCII white space and are numbered from 0. ``runs`` has every
    run of ``least`` words or more (see ``runs_of``). ``collapsed`` is the words, with one space
    between, without those that some run contains after its first period. A null or empty text
    has no words, no runs and an empty ``collapsed``. Rows are independent: null and repeated ids
    and repeated rows each give their own row. Other columns play no part. A very long text is
    one task's work, in memory that is in proportion to it.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        _found(least), f"_id bigint, n_words bigint, runs {RUNS}, collapsed string")
