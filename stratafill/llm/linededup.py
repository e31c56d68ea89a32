"""Line dedup by an exact set-similarity join.

A line is the set of its words. Two lines match if their sets have a Jaccard similarity of 0.8 or
more, and a line that matches an earlier one is removed. The order of lines is document id (null
first), hash of the document's text, line number.

Equal sets are one class, found by hash, and only classes are joined. The words of a class are
ordered by rarity. Two sets can reach the threshold only if they share a word among the first
``n - ceil(t n) + 1`` of both: classes are listed by the words of their prefixes. A pair of a
list goes on only if the sizes allow the threshold, if the places of the shared word leave room
for the overlap, and if the sets' tallies differ by no more than words may differ. A tally counts
the words in each of 32 parts of the hashes, modulo 16; parity bits alone tell short lines apart,
but in a line of 150 words they are all as good as random, and long lines that share one rare word
would go on. Exact overlap decides in the end.

A line needs one earlier match to go, not all of them. So each list gives a class only the
earlier ones that look nearest, which keeps large groups of near copies from making all their
pairs. Classes whose nearest candidates fail, though there are more, are joined again with all.
Where the links themselves are asked for, every class is joined with all its candidates, and each
pair of classes that matches counts; their number grows with the square of such a group.

Rarity comes from a count of every word of the corpus in a table of fixed size. Words that share
an entry only share a rank, so the order is the same everywhere and results do not depend on it;
a word whose entry counts a single occurrence cannot be shared and is not looked up. The list of
a frequent word is cut into parts, and each two parts meet on their own. Lists are dealt to
buckets, whose number follows the number of entries, and a bucket's entries are shuffled as packed
columns, not as a row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafill.llm.common import KEY, document_key, same
from stratafill.llm.decontaminate import bloom_filter, in_filter
from stratafill.llm.words import SMALL_PIECE, Words, buffers, lists, mix, per_piece, words_of
from stratafill.sources.staging import drop_shuffles, release, stage

SIMILARITY = 0.8
RARITY_SLOTS = 1 << 22  # 16 MB of counts, whatever the corpus
LIST_ROWS = 1 << 15     # a part of a word's list has about so many rows at most
BUCKET_ROWS = 1 << 16   # entries of a bucket of lists, about
PACKED_ROWS = 256       # entries of a bucket that a task hands on at once, about
NEAREST = 2             # candidates that a list gives a class at first
SEEN_SETS = 1 << 20     # hashes of sets that a task remembers to give each once
TRIED = 3               # of those, the nearest are compared before all are asked for
TALLIES = 32            # parts of the hashes whose words are counted, in four bits each
_NIBBLE_1, _NIBBLE_8 = np.uint64(0x1111111111111111), np.uint64(0x8888888888888888)
_LOW_HALVES, _BYTE_1 = np.uint64(0x0F0F0F0F0F0F0F0F), np.uint64(0x0101010101010101)


class Lines:
    """The distinct words of each line with words in it: text, line number and word hashes.

    Line i has ``words[bounds[i]:bounds[i + 1]]``, ascending by ``rank`` (a number per word) and
    then by hash.
    """

    def __init__(self, column: pa.Array, rank: Callable[[np.ndarray], np.ndarray] | None = None):
        data, offsets = buffers(column)
        newline = np.flatnonzero(data == 10)
        begins = np.unique(np.concatenate([offsets[:-1], newline + 1]))
        edges = np.append(begins[begins < len(data)], len(data))
        found = Words(data, edges)
        line = found.owner
        text_of = np.searchsorted(offsets, edges[:-1], side="right") - 1
        first_line = np.searchsorted(edges, offsets)
        number = np.arange(len(edges) - 1) - first_line[text_of] if len(edges) > 1 else edges[:0]
        keys = [found.hashes, line] if rank is None else [
            found.hashes, rank(found.hashes), line]
        order = np.lexsort(keys)
        line, words = line[order], found.hashes[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
        line, self.words = line[new], words[new]
        held, at = np.unique(line, return_index=True)
        self.text, self.number = text_of[held], number[held]
        self.bounds = np.append(at, len(line)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.text)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def summed(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.bounds[:-1]) if len(self) else values[:0]


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(20)).astype(np.int64) & (RARITY_SLOTS - 1)


def _count_words(batches):
    """Words per slot of the table, summed over the partition."""
    counts = np.zeros(RARITY_SLOTS, np.int64)
    slots: list[np.ndarray] = []
    for piece in per_piece(lambda piece: piece, most=SMALL_PIECE)(batches):
        slots.append(_slot(words_of(piece.column("text")).hashes).astype(np.int32))
        if sum(map(len, slots)) > 1 << 20:
            counts += np.bincount(np.concatenate(slots), minlength=RARITY_SLOTS)
            slots = []
    if slots:
        counts += np.bincount(np.concatenate(slots), minlength=RARITY_SLOTS)
    some = np.flatnonzero(counts)
    for i in range(0, len(some), 1 << 16):
        part = some[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["slot", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """How often the words of each slot occur in all of ``docs`` (column text)."""
    found = docs.select("text").mapInArrow(_count_words, "slot int, n bigint")
    rows = found.groupBy("slot").agg(
        F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(RARITY_SLOTS, np.int32)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _tallies(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Per line how many of its words are in each part of the hashes, 16 parts to a number."""
    made = np.zeros((len(lines), 2), np.uint64)
    shift = np.arange(0, 64, 4, dtype=np.uint64)
    for i in range(0, len(lines), 4096):
        edges = lines.bounds[i:i + 4097]
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        part = (lines.words[edges[0]:edges[-1]] >> np.uint64(59)).astype(np.int64)
        n = np.bincount(owner * TALLIES + part, minlength=(len(edges) - 1) * TALLIES) & 15
        made[i:i + 4096] = (n.reshape(-1, 2, 16).astype(np.uint64) << shift).sum(axis=2)
    return made[:, 0], made[:, 1]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum over the 16 tallies of how far they are apart, modulo 16: 8 at most each.

    Two sets that differ in d words (one way or the other) are d apart at most.
    """
    less = ((a | _NIBBLE_8) - (b & ~_NIBBLE_8)) ^ ((a ^ ~b) & _NIBBLE_8)  # a - b in each tally
    below = (less & _NIBBLE_8) >> np.uint64(3)
    size = (less ^ (below * np.uint64(15))) + below
    pairs = (size & _LOW_HALVES) + ((size >> np.uint64(4)) & _LOW_HALVES)
    return ((pairs * _BYTE_1) >> np.uint64(56)).astype(np.int64)


PROFILED = ("_id bigint, _th bigint, line array<int>, h1 array<bigint>, h2 array<bigint>, "
            "n array<int>, low array<bigint>, high array<bigint>, prefixes array<binary>")
# an entry of a prefix: half a word's hash finds candidates, exact overlap takes whole ones
_ENTRY = np.dtype([("word", "<u4"), ("place", "<u2"), ("parts", "<u2")])


def _profile(counts, threshold: float, list_rows: int):
    """Per document its lines: set hashes, sizes, tallies, and the prefixes by rarity."""
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        # the rarest first
        lines = Lines(piece.column("text"), lambda words: counts.value[_slot(words)])
        words, sizes, rows = lines.words, lines.sizes, piece.num_rows
        owner = np.repeat(np.arange(len(lines)), sizes)
        h1, h2 = _set_hashes(lines)
        low, high = _tallies(lines)
        held = counts.value[_slot(words)]
        place = np.arange(len(words)) - np.repeat(lines.bounds[:-1], sizes)
        prefix = (sizes - _ceil(threshold * sizes) + 1)[owner]
        use = (place < prefix) & (held > 1)
        mine = owner[use]
        entries = np.zeros(len(mine), _ENTRY)
        entries["word"] = words[use] >> np.uint64(32)
        entries["place"] = np.minimum(place[use], 0xFFFF)
        entries["parts"] = np.clip(-(-held[use] // list_rows), 1, 0xFFFF)
        cut = np.searchsorted(mine, np.arange(len(lines) + 1))
        packed = pa.array([entries[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)],
                          pa.binary())
        flat = [pa.array(lines.number.astype(np.int32)), pa.array(h1.view(np.int64)),
                pa.array(h2.view(np.int64)), pa.array(sizes.astype(np.int32)),
                pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), packed]
        return pa.RecordBatch.from_arrays(
            [piece.column("_id"), piece.column("_th"),
             *[lists(lines.text, x, rows) for x in flat]],
            names=["_id", "_th", "line", "h1", "h2", "n", "low", "high", "prefixes"])
    return per_piece(run, most=SMALL_PIECE)


# an entry of a list; entries are shuffled as packed columns, a row per bucket of lists
_LISTED = {"word": np.dtype("<u4"), "part": np.dtype("<u4"), "cid": np.dtype("<i8"),
           "n": np.dtype("<i4"), "low": np.dtype("<u8"), "high": np.dtype("<u8"),
           "place": np.dtype("<u2"), "asks": np.dtype("?")}
LISTED = "bucket int, " + ", ".join(f"{c} binary" for c in _LISTED)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of all rows, and the row of each entry."""
    raw = batch.column("prefixes").to_pylist()
    return np.frombuffer(b"".join(raw), _ENTRY), np.repeat(
        np.arange(batch.num_rows), [len(x) // _ENTRY.itemsize for x in raw])


def _word_hashes(batches):
    for batch in batches:
        entries, _ = _entries(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array(mix(entries["word"]).view(np.int64))], names=["hash"])


def _count_listed(batches):
    """How many entries :func:`_list_words` makes of all words."""
    for batch in batches:
        entries, _ = _entries(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(entries["parts"].sum(dtype=np.int64))])], names=["rows"])


def _list_words(asked, buckets: int):
    """An entry per looked-up word of a class, and per meeting of the parts of a long list.

    With ``asked``, a filter of words, only those. The lists are dealt to ``buckets``.
    """
    at_once = min(max(buckets * PACKED_ROWS, 1 << 15), 1 << 19)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(_listed(batch, asked))
            n += len(held[-1]["word"])
            if n >= at_once:
                yield _packed(held, buckets)
                held, n = [], 0
        if n:
            yield _packed(held, buckets)
    return run


def _listed(batch: pa.RecordBatch, asked) -> dict[str, np.ndarray]:
    entries, row = _entries(batch)
    if asked is not None:
        use = in_filter(asked.value, mix(entries["word"]))
        entries, row = entries[use], row[use]
    parts = entries["parts"].astype(np.int64)
    cid = batch.column("cid").to_numpy()[row]
    own = (mix(cid.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
    again = np.repeat(np.arange(len(row)), parts)
    other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
    mine = own[again]
    part = np.minimum(mine, other) * 0x10000 + np.maximum(mine, other)
    rows = {"word": entries["word"][again], "part": part, "place": entries["place"][again],
            **{c: batch.column(c).to_numpy(zero_copy_only=False)[row[again]]
               for c in ("cid", "n", "low", "high", "asks")}}
    return {c: rows[c].astype(kind) for c, kind in _LISTED.items()}


def _packed(held: list[dict[str, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """A row per bucket, whose cells are columns of its entries, number after number."""
    rows = {c: np.concatenate([x[c] for x in held]) for c in _LISTED}
    name = (rows["word"].astype(np.uint64) << np.uint64(32)) | rows["part"]
    bucket = (mix(name) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket)
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    edges = np.append(first, len(bucket))
    cells = [pa.Array.from_buffers(pa.binary(), len(first), [
        None, pa.py_buffer((edges * kind.itemsize).astype(np.int32)),
        pa.py_buffer(rows[c][order])]) for c, kind in _LISTED.items()]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *cells], names=["bucket", *_LISTED])


def _unpacked(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(x for batch in held for x in batch.column(c).to_pylist()), kind)
            for c, kind in _LISTED.items()}


class _Pairs:
    """Candidates (later, earlier, bits apart), and per later class how many there were."""

    def __init__(self, keep: int | None):
        self.keep, self.held, self.size = keep, [], 0

    def add(self, later, earlier, apart) -> None:
        self.held.append((later, earlier, apart, np.ones(len(later), np.int64)))
        self.size += len(later)
        if self.keep and self.size > 1 << 20:
            self.cut()

    def cut(self) -> tuple:
        later, earlier, apart, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((earlier, apart, later))
        later, earlier, apart, n = later[order], earlier[order], apart[order], n[order]
        first = np.ones(len(later), bool)
        first[1:] = later[1:] != later[:-1]
        group = np.cumsum(first) - 1
        total = np.bincount(group, weights=n).astype(np.int64) if len(n) else n
        if self.keep:
            nth = np.arange(len(later)) - np.flatnonzero(first)[group] if len(n) else n
            use = nth < self.keep
            # what is left out counts at the first one
            kept = np.bincount(group[use], minlength=len(total))
            n = np.where(first, total[group] - kept[group] + 1, 1)[use] if len(n) else n
            later, earlier, apart = later[use], earlier[use], apart[use]
        self.held, self.size = [(later, earlier, apart, n)], len(later)
        return self.held[0]

    def batch(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int64)) for x in self.cut()], names=["x", "y", "apart", "n"])


def _meet(rows: dict[str, np.ndarray], threshold: float) -> Iterator[tuple]:
    """Candidates in whole lists; ``rows`` are columns in any order."""
    if not len(rows["word"]):
        return
    name = (rows["word"].astype(np.uint64) << np.uint64(32)) | rows["part"]
    order = np.lexsort((rows["n"], name))
    name = name[order]
    own = np.cumsum(np.append(True, name[1:] != name[:-1]))
    n, place = (rows[c][order].astype(np.int64) for c in ("n", "place"))
    cid, asks = rows["cid"][order], rows["asks"][order]
    low_tallies, high_tallies = rows["low"][order], rows["high"][order]
    # the smaller set of a pair has the word in a shorter prefix, and is not much smaller
    short = np.flatnonzero(place < n - _ceil(2 * threshold / (1 + threshold) * n) + 1)
    low = np.searchsorted((own[short] << 32) + n[short], (own << 32) + _ceil(threshold * n))
    many = np.maximum(np.searchsorted(short, np.arange(len(n))) - low, 0)
    upto = np.cumsum(many)
    first = 0
    while first < len(n):
        before = upto[first] - many[first]
        last = max(int(np.searchsorted(upto, before + (1 << 20), side="right")), first + 1)
        i = np.repeat(np.arange(first, last), many[first:last])
        j = short[low[i] + np.arange(len(i)) - (upto - many)[i] + before]
        both = n[i] + n[j]
        need = _ceil(both * (threshold / (1 + threshold)))
        ok = np.minimum(n[i] - place[i], n[j] - place[j]) >= need  # with the shared word
        i, j, most = i[ok], j[ok], (both - 2 * need)[ok]
        apart = _apart(low_tallies[i], low_tallies[j])
        ok = apart <= most
        i, j, most, apart = i[ok], j[ok], most[ok], apart[ok]
        apart = apart + _apart(high_tallies[i], high_tallies[j])
        x, y = np.maximum(cid[i], cid[j]), np.minimum(cid[i], cid[j])
        ok = (apart <= most) & (x != y) & np.where(cid[i] == x, asks[i], asks[j])
        yield x[ok], y[ok], apart[ok]
        first = last


def _meet_in_lists(threshold: float, keep: int | None):
    """Rows come ordered by bucket; a bucket may go on in the next batch."""
    def found(rows) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs(keep)
        for some in _meet(rows, threshold):
            pairs.add(*some)
            if not keep and pairs.size > 1 << 20:  # all are handed on, so none need be held
                yield pairs.batch()
                pairs = _Pairs(keep)
        if (made := pairs.batch()) is not None:
            yield made

    def run(batches):
        held, n, open_bucket = [], 0, None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
            for i, j in zip(edges, [*edges[1:], len(bucket)], strict=True):
                # whole buckets, several of which are met at once if they are small
                if n >= 1 << 16 and bucket[i] != open_bucket:
                    yield from found(_unpacked(held))
                    held, n = [], 0
                open_bucket = bucket[i]
                held.append(batch.slice(i, j - i))
                n += sum(map(len, held[-1].column("asks").to_pylist()))  # a byte each
        if held:
            yield from found(_unpacked(held))
    return run


SETS = "n int, h1 bigint, h2 bigint, words array<bigint>"


def _set_hashes(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    return (lines.summed(mix(lines.words)),
            lines.summed(mix(lines.words ^ np.uint64(0x5851F42D4C957F2D))))


def _word_sets(asked):
    """The whole word sets of lines whose hash is in the filter, each about once per task."""
    def run(batches):
        seen = np.zeros(0, np.uint64)
        for piece in per_piece(lambda piece: piece, most=SMALL_PIECE)(batches):
            lines = Lines(piece.column("text"))
            h1, h2 = _set_hashes(lines)
            key = h1 ^ mix(h2)
            at = np.flatnonzero(in_filter(asked.value, h1) & ~np.isin(key, seen))
            _, first = np.unique(key[at], return_index=True)
            at = np.sort(at[first])
            seen = np.union1d(seen, key[at]) if len(seen) < SEEN_SETS else key[at]
            n = lines.sizes[at]
            flat = np.arange(n.sum()) + np.repeat(lines.bounds[at] - (np.cumsum(n) - n), n)
            edges = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int32()), pa.array(h1[at].view(np.int64)),
                 pa.array(h2[at].view(np.int64)),
                 pa.ListArray.from_arrays(edges, pa.array(lines.words[flat].view(np.int64)))],
                names=["n", "h1", "h2", "words"])
    return run


def _candidates(
    classes: DataFrame, asks: Column, threshold: float, keep: int | None, asked=None
) -> DataFrame:
    """Per class x that ``asks``, earlier candidates y of its lists (``keep`` of each, or all).

    ``asked`` is a filter of the words whose lists are needed.
    """
    total = classes.select("prefixes").mapInArrow(_count_listed, "rows bigint").agg(
        F.sum("rows")).first()[0] or 0
    listed = classes.select("cid", "n", "low", "high", "prefixes", asks.alias("asks")).mapInArrow(
        _list_words(asked, total // BUCKET_ROWS + 1), LISTED)
    ordered = listed.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(
        _meet_in_lists(threshold, keep), "x bigint, y bigint, apart bigint, n bigint")


def _matches(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) of classes whose word sets reach the threshold.

    The sets are taken from the texts once more, where these are read: only the sets of classes
    in a pair go through a shuffle, not the texts.
    """
    whole = ["n", "h1", "h2"]
    ends = pairs.select(F.explode(F.array("x", "y")).alias("cid")).distinct()
    wanted = stage(classes.select("cid", *whole).join(ends, "cid"), "line_wanted")
    asked = docs.sparkSession.sparkContext.broadcast(  # of a fixed size
        bloom_filter(wanted.select(F.col("h1").alias("hash"))))
    sets = docs.select("text").mapInArrow(_word_sets(asked), SETS)
    # written, so that a class of many pairs is split
    one = stage(sets.join(wanted, whole).dropDuplicates(whole).select("cid", "words"), "line_sets")
    drop_shuffles(docs.sparkSession)
    both = (pairs.join(one.select(F.col("cid").alias("x"), F.col("words").alias("u")), "x")
            .join(one.select(F.col("cid").alias("y"), F.col("words").alias("v")), "y"))
    common = F.size(F.array_intersect("u", "v"))
    union = F.size("u") + F.size("v") - common
    matched = stage(
        both.where(common >= F.lit(threshold) * union - 1e-9).select("x", "y"), "line_matches")
    release(one, wanted)
    return matched


def earlier_matches(classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(x, y): for each class of lines that matches an earlier class, one that it matches.

    ``cid`` numbers the classes in the order of their first lines.
    """
    # of at most NEAREST candidates per looked-up word
    nearest = F.array_sort(F.collect_set(F.struct("apart", "y")))
    near = stage(
        _candidates(classes, F.lit(True), threshold, NEAREST).groupBy("x").agg(
            nearest.alias("all"), F.sum(F.col("n") - 1).alias("more"))
        .select("x", F.transform(F.slice("all", 1, TRIED), lambda c: c["y"]).alias("ys"),
                ((F.col("more") > 0) | (F.size("all") > TRIED)).alias("more")),
        "line_candidates")
    drop_shuffles(docs.sparkSession)
    tried = near.select("x", F.explode("ys").alias("y"))
    first = _matches(tried, classes, docs, threshold)
    first = first.groupBy("x").agg(F.min("y").alias("y"))
    left = near.where("more").join(first, "x", "left_anti").select(F.col("x").alias("cid"))
    left = stage(left, "line_rest")
    if left.isEmpty():
        release(near, left)
        return first
    asking = classes.join(left.withColumn("asks", F.lit(True)), "cid", "left")
    wanted = classes.join(left, "cid", "left_semi").select("prefixes")
    asked = docs.sparkSession.sparkContext.broadcast(  # of a fixed size
        bloom_filter(wanted.mapInArrow(_word_hashes, "hash bigint")))
    rest = stage(
        _candidates(asking, F.coalesce("asks", F.lit(False)), threshold, None, asked)
        .select("x", "y").distinct().join(tried, ["x", "y"], "left_anti"),
        "line_pairs")
    second = _matches(rest, classes, docs, threshold)
    release(near, left, rest)
    return first.unionByName(second.groupBy("x").agg(F.min("y").alias("y")))


def all_matches(
    classes: DataFrame, docs: DataFrame, threshold: float
) -> tuple[DataFrame, DataFrame]:
    """(x, y): every pair of classes of lines that match, x the later one; and the classes.

    These are written again without their prefixes, and ``classes``, which is staged, is removed.
    """
    pairs = stage(_candidates(classes, F.lit(True), threshold, None).select("x", "y").distinct(),
                  "line_pairs")
    named = stage(classes.drop("low", "high", "prefixes"), "line_classes")
    release(classes)
    drop_shuffles(docs.sparkSession)
    matched = _matches(pairs, named, docs, threshold)
    release(pairs)
    drop_shuffles(docs.sparkSession)
    return matched, named


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = SIMILARITY, list_rows: int = LIST_ROWS, all_links: bool = False,
) -> DataFrame:
    """``docs`` without the lines that match an earlier line, and with counts.

    The text column loses those lines with their line ends; the columns _lines (lines with
    words), _removed and _links (lines that match an earlier line with other words) are added as
    long, in place of columns of these names. Lines without words always stay, so an
    empty text stays empty, a null stays null. Rows that repeat a document (id and text) give the
    same result each. All other columns are handed through.

    With ``all_links`` every link is found, not one per line that has some, and three more columns
    are added: _classes, per line with words, in order, the id of its class (a hash of its set of
    words); _class_matches (longs), to how many other classes each of these is linked, earlier or
    later ones; and _matches (long), their sum. A very long line is one set of words, a very long
    text one task's work, in memory that is in proportion to it.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.struct("*").alias("row"), *[
        c.alias(n) for n, c in document_key(docs, id_col, text_col).items()])
    texts = keyed.select(*KEY, F.col("row")[text_col].cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(rarity(texts))  # of a fixed size
    profiled = stage(texts.mapInArrow(_profile(counts, threshold, list_rows), PROFILED), "line_profiles")

    def lines(*fields: str) -> DataFrame:
        return profiled.select(*KEY, F.explode(F.arrays_zip(*fields)).alias("l")).select(*KEY, "l.*")

    whole = ["n", "h1", "h2"]
    spot = [*KEY, "line"]
    # numbered in the order of their first lines: by range, then inside
    classes = stage(
        lines("line", *whole, "low", "high", "prefixes").groupBy(*whole).agg(
            F.min(F.struct(*spot)).alias("at"), F.first("low").alias("low"),
            F.first("high").alias("high"), F.first("prefixes").alias("prefixes"))
        .select(*whole, "at.*", "low", "high", "prefixes")
        .repartitionByRange(*spot).sortWithinPartitions(*spot)
        .withColumn("cid", F.monotonically_increasing_id()), "line_classes")
    # the classes have the prefixes now
    full, profiled = profiled, stage(profiled.select(*KEY, "line", *whole), "line_profiles")
    release(full)
    drop_shuffles(spark)
    if all_links:
        ends = F.array(F.struct(F.col("x").alias("cid"), F.lit(True).alias("linked")),
                       F.struct(F.col("y").alias("cid"), F.lit(None).cast("boolean").alias("linked")))
        matched, classes = all_matches(classes, texts, threshold)
        linked = (matched.select(F.inline(ends)).groupBy("cid")
                  .agg(F.max("linked").alias("linked"), F.count(F.lit(1)).alias("matches")))
    else:
        linked = earlier_matches(classes, texts, threshold).select(
            F.col("x").alias("cid"), F.lit(True).alias("linked"))
    verdicts = classes.select(
        *whole, "cid", F.struct(*spot).alias("first")).join(linked, "cid", "left").drop("cid")
    judged = lines("line", *whole).join(verdicts, whole)
    times = profiled.groupBy(*KEY).agg(F.count(F.lit(1)).alias("times"))
    gone = F.col("linked").isNotNull() | (F.col("first") != F.struct(*spot))
    per_doc = judged.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("lines"), F.count("linked").alias("links"),
        F.collect_set(F.when(gone, F.col("line"))).alias("gone"),
        *([F.sum("matches").alias("matches"),
           F.array_sort(F.collect_set(F.struct(
               "line", "h1", "h2", F.coalesce("matches", F.lit(0)).alias("matches")))).alias("held")]
          if all_links else []))
    # a document that is there twice has been counted twice
    counted = per_doc.join(times, same(per_doc, times, KEY)).select(
        *[per_doc[c] for c in KEY], (F.col("lines") / F.col("times")).cast("bigint").alias("_lines"),
        (F.col("links") / F.col("times")).cast("bigint").alias("_links"), "gone",
        *([(F.col("matches") / F.col("times")).cast("bigint").alias("matches"), "held"]
          if all_links else []))
    counted = stage(counted, "line_counts")  # so that rows that repeat a document are split
    joined = keyed.join(counted, same(keyed, counted, KEY), "left")
    text = F.col("row")[text_col]
    left = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.col("gone"), i))
    zero = F.lit(0).cast("bigint")
    added = {"_lines": F.coalesce("_lines", zero),
             "_removed": F.coalesce(F.size("gone").cast("bigint"), zero),
             "_links": F.coalesce("_links", zero)}
    if all_links:
        ids = F.transform("held", lambda x: F.format_string("%016x%016x", x["h1"], x["h2"]))
        added |= {"_class_matches": F.coalesce(
                      F.transform("held", lambda x: x["matches"].cast("bigint")),
                      F.array().cast("array<bigint>")),
                  "_matches": F.coalesce("matches", zero),
                  "_classes": F.coalesce(ids, F.array().cast("array<string>"))}
    shown = [F.when(F.size("gone") > 0, F.array_join(left, "\n")).otherwise(text).alias(c)
             if c == text_col else F.col("row")[c].alias(c)
             for c in docs.columns if c not in added]
    return joined.select(*shown, *[c.alias(n) for n, c in added.items()])
