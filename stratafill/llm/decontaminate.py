"""Benchmark decontamination by winnowing.

Texts are words (ASCII letters and digits and non-ASCII characters; A-Z as a-z). A window is
``window`` consecutive words of a benchmark item; an item of fewer words is one window. A word of
a document is hit if it lies inside an occurrence of a window.

Winnowing: of every ``w`` consecutive k-gram hashes of a text the least is kept (the last of
equal ones). With k + w - 1 = ``window``, each window holds exactly one choice, which depends on
its words alone; so a document that holds a window keeps the same fingerprint at the same place
of it as the item does. Fingerprints of documents and items are joined, each match is extended
word by word to both sides, and runs of ``window`` equal words are hits. Items shorter than a
window keep the hash of the whole item, and documents the runs of those lengths.

The fingerprints of the items also go into a Bloom filter of fixed size that is broadcast, so
that document fingerprints which no item has are not shuffled. The words around a fingerprint
travel with it, so the extension needs no second look at the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafill.llm.common import KEY, document_key, same
from stratafill.llm.words import Words, lists, mix, per_piece, words_of
from stratafill.sources.staging import release, stage

WINDOW = 10
GRAM = 5
FILTER_BITS = 1 << 24  # 2 MB, whatever the benchmark
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LENGTHS = [np.uint64(0x2545F4914F6CDD1D * n & 0xFFFFFFFFFFFFFFFF) for n in range(4096)]


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each run of ``size`` words inside one text; places count over all texts."""
    last = words.bounds[1:][words.owner]
    at = np.flatnonzero(np.arange(len(words)) + size <= last)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * _BASE + words.hashes[at + k]
    return at, mix(out + _LENGTHS[size])


def winnow(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The (place, hash) that winnowing keeps in texts of at least ``window`` words."""
    places, hashes = grams(words, gram)
    w = window - gram + 1
    if len(places) < w:
        return places[:0], hashes[:0]
    first = np.flatnonzero(places[:len(places) - w + 1] + w - 1 == places[w - 1:])
    owner = words.owner
    first = first[owner[places[first]] == owner[places[first + w - 1]]]
    best, at = hashes[first], first.copy()
    for k in range(1, w):
        other = hashes[first + k]
        less = other <= best
        best, at = np.where(less, other, best), np.where(less, first + k, at)
    at = np.unique(at)
    return places[at], hashes[at]


def fingerprints(words: Words, gram: int, window: int, shorts: list[int], item: bool):
    """(place, length, hash): winnowed grams (length 0) and runs of the short lengths.

    Of an item, only the run that is the whole item.
    """
    place, value = winnow(words, gram, window)
    found = [(place, np.zeros(len(place), np.int64), value)]
    count = np.diff(words.bounds)[words.owner]
    for n in shorts:
        place, value = grams(words, n)
        if item:
            own = count[place] == n
            place, value = place[own], value[own]
        found.append((place, np.full(len(place), n), mix(value + np.uint64(1))))
    place, length, value = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place, kind="stable")
    return place[order], length[order], value[order]


def _context(words: Words, place: int, length: int, gram: int, window: int):
    """The words around a fingerprint: its place among them, and the words with spaces between."""
    i = words.owner_at(place)
    low, high = int(words.bounds[i]), int(words.bounds[i + 1])
    reach = 0 if length else window - gram
    first = max(low, place - reach)
    last = min(high, place + (length or gram) + reach)
    return place - first, words.bytes_of(first, last)


PRINTED = ("n_words bigint, hits array<struct<place: int, length: int, hash: bigint, "
           "shift: int, words: binary>>")
_HIT = pa.struct([("place", pa.int32()), ("length", pa.int32()), ("hash", pa.int64()),
                  ("shift", pa.int32()), ("words", pa.binary())])


def _print(gram: int, window: int, shorts: list[int], item: bool, bloom, keys: list[str]):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(piece.column("text"))
        place, length, value = fingerprints(words, gram, window, shorts, item)
        if bloom is not None:
            seen = in_filter(bloom.value, value)
            place, length, value = place[seen], length[seen], value[seen]
        owner = words.owner[place]
        own = place - words.bounds[owner]
        context = [_context(words, p, n, gram, window)
                   for p, n in zip(place.tolist(), length.tolist(), strict=True)]
        fields = [pa.array(own.astype(np.int32)), pa.array(length.astype(np.int32)),
                  pa.array(value.view(np.int64)), pa.array([c[0] for c in context], pa.int32()),
                  pa.array([c[1] for c in context], pa.binary())]
        hits = pa.StructArray.from_arrays(fields, fields=list(_HIT))
        return pa.RecordBatch.from_arrays(
            [*[piece.column(k) for k in keys], pa.array(np.diff(words.bounds)),
             lists(owner, hits, piece.num_rows)], names=[*keys, "n_words", "hits"])
    return per_piece(run)


def _filter_places(values: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return [(values >> np.uint64(s)) & mask for s in (0, 20, 40)]


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for p in _filter_places(values):
        out &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _build_filter(batches):
    """The bits that a partition's fingerprints set, in pieces of 64 KB that have any."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        values = batch.column("hash").to_numpy().view(np.uint64)
        for p in _filter_places(values):
            np.bitwise_or.at(bits, p >> np.uint64(3),
                             np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    words = bits.view(np.int64)
    some = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some])], names=["at", "bits"])


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """The filter over a column ``hash``; what reaches the driver is at most its size."""
    parts = hashes.mapInArrow(_build_filter, "at bigint, bits bigint")
    rows = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint8)


def _extend(window: int):
    """Per match the run of equal words around it, as a range of words of the document."""
    def run(batches):
        for batch in batches:
            out, kept = [], []
            rows = zip(*[batch.column(c).to_pylist() for c in (
                "place", "length", "shift", "words", "item_shift", "item_words")], strict=True)
            for i, (place, length, shift, mine, item_shift, theirs) in enumerate(rows):
                a, b = mine.split(b" "), theirs.split(b" ")
                if length:
                    if a == b:
                        out.append((place, place + length))
                        kept.append(i)
                    continue
                low = high = 0
                while low < min(shift, item_shift) and a[shift - low - 1] == b[item_shift - low - 1]:
                    low += 1
                most = min(len(a) - shift, len(b) - item_shift)
                while high < most and a[shift + high] == b[item_shift + high]:
                    high += 1
                if low + high >= window:
                    out.append((place - low, place + high))
                    kept.append(i)
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(take), batch.column("_th").take(take),
                 batch.column("item_id").take(take), pa.array([x[0] for x in out], pa.int64()),
                 pa.array([x[1] for x in out], pa.int64())],
                names=["_id", "_th", "item_id", "first", "last"])
    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """Per document (_id, _th; see ``document_key``): n_words, n_hit, items (sorted array), spans.

    ``items`` are the ids, as text, of items with a window in the document; ``spans`` the hit
    words as disjoint ranges [first, last) in order. A null text has no words and no hits. Rows
    that repeat a document give one row; items without words take no part, items with equal ids
    count as one. Columns other than the named ones play no part.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"),
                             F.col(item_text).cast("string").alias("text"))
    items = items.where("item_id is not null")
    sized = items.mapInArrow(_count_words, "n bigint").where(f"n > 0 and n < {window}")
    shorts = sorted(r.n for r in sized.distinct().collect())  # fewer than ``window`` numbers
    printed = items.mapInArrow(
        _print(gram, window, shorts, True, None, ["item_id"]), f"item_id string, {PRINTED}")
    prints = stage(
        printed.select("item_id", F.explode("hits").alias("h")).select(
            F.col("h.hash").alias("hash"), F.col("h.length").alias("length"), "item_id",
            F.col("h.shift").alias("item_shift"), F.col("h.words").alias("item_words")).distinct(),
        "item_prints")
    bloom = spark.sparkContext.broadcast(bloom_filter(prints.select("hash")))

    texts = docs.select(F.col(text_col).cast("string").alias("text"),
                        *[c.alias(n) for n, c in document_key(docs, id_col, text_col).items()])
    seen = stage(texts.mapInArrow(
        _print(gram, window, shorts, False, bloom, KEY), f"_id bigint, _th bigint, {PRINTED}"),
        "document_prints")
    hits = seen.select(*KEY, F.explode("hits").alias("h")).select(*KEY, "h.*")
    matched = hits.join(prints, ["hash", "length"])
    spans = stage(matched.mapInArrow(
        _extend(window), "_id bigint, _th bigint, item_id string, first bigint, last bigint"),
        "spans")
    release(prints)
    ranges = F.array_sort(F.collect_set(F.struct("first", "last")))
    merged = F.aggregate(
        F.col("ranges"), F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda got, x: F.when(
            (F.size(got) > 0) & (F.element_at(got, -1)["last"] >= x["first"]),
            F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(
                F.element_at(got, -1)["first"].alias("first"),
                F.greatest(F.element_at(got, -1)["last"], x["last"]).alias("last")))))
        .otherwise(F.concat(got, F.array(x))))
    per_doc = spans.groupBy(*KEY).agg(
        ranges.alias("ranges"), F.array_sort(F.collect_set("item_id")).alias("items"))
    per_doc = per_doc.select(*KEY, "items", merged.alias("spans"))
    counted = seen.groupBy(*KEY).agg(F.first("n_words").alias("n_words"))
    both = counted.join(per_doc, same(counted, per_doc, KEY), "left")
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"])
    return both.select(
        *[counted[c] for c in KEY], "n_words",
        F.coalesce(total, F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint>>"))
        .alias("spans"))


def _count_words(batches):
    for batch in per_piece(lambda piece: piece)(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.diff(words_of(batch.column("text")).bounds))], names=["n"])
