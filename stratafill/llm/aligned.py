"""Alignment of two tokenizers over the bytes of texts, with corpus-wide counts of id pairs.

Both tokenizers end a token wherever a single space or line end between two other characters
begins the next one, so a text is cut there into units, and no group of aligned tokens crosses a
unit. Equal units are aligned once; what a text needs is summed over its units.

The first pass gathers pairs: each task gives the distinct pairs of its documents with the number
of documents that hold them. The distinct pairs of all tasks get numbers by a minimal perfect
hash, and the counts become dense vectors by number, which are summed in two steps of a tree. The
second pass aligns the documents again and looks the counts up; a lookup compares the key.

Pairs are cut into slices by their first id, so that a slice has about ``SLICE_PAIRS`` pairs: what
is broadcast has that bound at any size of the corpus. Documents are aligned once per slice.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafill.llm.common import KEY, document_key, same
from stratafill.llm.perfecthash import PLACED, PerfectHash, buckets_for, place_group
from stratafill.llm.tokens import (
    Lists, Vocabulary, byte_of_character, distinct, ragged, units_of)
from stratafill.llm.words import buffers, pieces
from stratafill.sources.staging import release, stage

SLICE_PAIRS = 4_000_000
PIECE = 2 << 20
REMEMBERED_BYTES = 64 << 20
CHUNK = 1 << 16  # slots of a vector that is sent
COUNTERS, BRANCHES = 64, 8  # tasks that count, sums per step of the tree


def byte_level_tokens(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    byte_of = byte_of_character()
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        if all(c in byte_of for c in token):
            out[i] = bytes(byte_of[c] for c in token)
    return out


def piece_tokens(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary with byte fallback."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]


class Vocabularies:
    """Both tokenizers and tables of their ids; of a fixed size."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Vocabulary(a_path, ordinary=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_bytes, b_bytes = byte_level_tokens(self.a.tokenizer), piece_tokens(self.b)
        self.a_tokens, self.b_tokens = (pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes))
        self.b_size = len(b_bytes)
        names = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.space = self.b.piece_to_id("▁")
        self.cuts = self.a.cut and not any(
            "▁" in x.lstrip("▁") or "\n" in x for x in names)
        #: ids as they are written: of A before , and |, of B before , and ;
        self.written = pa.array(
            [f"{i}{c}" for n, end in ((len(a_bytes), "|"), (self.b_size, ";"))
             for i in range(n) for c in (",", end)], pa.large_binary())
        self.b_written = 2 * len(a_bytes)


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


class Aligner:
    """Token ids of units. Lives as long as a task; remembers units up to a number of bytes."""

    def __init__(self, a_path: str, b_path: str):
        self.vocabulary = vocabularies(a_path, b_path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids = [Lists(), Lists()]

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(text, number of unit) of all units in order, and the distinct units.

        Each text has a space before it; a null or empty one has no units.
        """
        data, offsets = buffers(column)
        some = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[some], 0x20)
        starts = offsets[some] + np.arange(len(some))
        at, unit, units = units_of(data, starts, self.vocabulary.cuts)
        return some[at], unit, units

    def encode(self, units: list[bytes]) -> tuple[Lists, Lists]:
        """The ids of A and of B of each unit."""
        if self.held > REMEMBERED_BYTES:
            self._forget()
        new = [u for u in units if u not in self.known]
        if new:
            texts = [u.decode("utf-8", "replace") for u in new]
            in_a = self.vocabulary.a.encode(texts)
            in_b = self.vocabulary.b.encode([x[1:] if x[0] == " " else x for x in texts], num_threads=1)
            for k, unit in enumerate(new):
                if unit[0] != 0x20:  # it is inside a text, so the space that B adds goes
                    in_b[k] = in_b[k][1:] if in_b[k][:1] == [self.vocabulary.space] else [0]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)),
                                  strict=True))
            for held, more in zip(self.ids, (in_a, in_b), strict=True):
                held.extend(more)
            self.held += sum(map(len, new)) + 150 * len(new) + 4 * sum(
                len(x) for both in (in_a, in_b) for x in both)
        at = np.array([self.known[u] for u in units], np.int64)
        return self.ids[0].take(at), self.ids[1].take(at)


class AlignedPiece:
    """One piece of texts: per unit occurrence its text and number, per distinct unit the rest.

    ``a`` and ``b`` are the ids of the distinct units, ``links`` their linked pairs as
    ``a * size of B + b``, repeats included. Texts with a unit that the bytes of either
    tokenization do not give back have no units.
    """

    def __init__(self, aligner: Aligner, column: pa.Array):
        self.tables, self.n = aligner.vocabulary, len(column)
        self.text, self.unit, units = aligner.units(column)
        self.a, self.b = aligner.encode(units.to_pylist())
        bad = self._differs(units, self.a, self.tables.a_tokens)
        bad |= self._differs(units, self.b, self.tables.b_tokens)
        if bad.any():
            good = np.ones(self.n, bool)
            good[self.text[bad[self.unit]]] = False
            own = good[self.text]
            self.text, self.unit = self.text[own], self.unit[own]
            keep = np.flatnonzero(~bad)  # the others have no occurrence any more
            place = np.zeros(len(bad), np.int64)
            place[keep] = np.arange(len(keep))
            self.unit = place[self.unit]
            self.a, self.b = self.a.take(keep), self.b.take(keep)
        self._align()

    @staticmethod
    def _differs(units: pa.Array, ids: Lists, tokens: pa.Array) -> np.ndarray:
        """Units whose tokens are not their bytes."""
        n = np.diff(np.frombuffer(tokens.buffers()[1], np.int64))
        sizes = np.diff(np.append(0, np.cumsum(n[ids.flat]))[ids.edges])
        data, offsets = units.buffers()[2], np.frombuffer(units.buffers()[1], np.int64)
        want = np.diff(offsets[:len(units) + 1])
        bad = sizes != want
        own = np.flatnonzero(~bad)
        joined = tokens.take(pa.array(ids.take(own).flat)).buffers()[2] or b""
        whole = np.frombuffer(data, np.uint8)[ragged(offsets[own], want[own])] if data else []
        off = np.flatnonzero(np.frombuffer(joined, np.uint8)[:len(whole)] != whole)
        bad[own[np.searchsorted(np.cumsum(want[own]), off, side="right")]] = True
        return bad

    def _align(self) -> None:
        tokens = (self.tables.a_tokens, self.tables.b_tokens)
        ends = [np.cumsum(np.diff(np.frombuffer(t.buffers()[1], np.int64))[x.flat])
                for t, x in zip(tokens, (self.a, self.b), strict=True)]
        self.closes = [np.isin(x, y, assume_unique=True) for x, y in (ends, ends[::-1])]
        # the group of each token, and the tokens of each group
        self.group = [np.cumsum(x) - x for x in self.closes]
        groups = int(self.closes[0].sum())
        self.in_group = [np.bincount(g, minlength=groups) for g in self.group]
        n_a, n_b = self.in_group
        per_a = n_b[self.group[0]]
        first_b = np.cumsum(n_b) - n_b
        right = self.b.flat[ragged(first_b[self.group[0]], per_a)]
        self.links = np.repeat(self.a.flat.astype(np.int64), per_a) * self.tables.b_size + right
        #: links of distinct unit u are ``links[first[u]:first[u + 1]]``
        self.first = np.append(0, np.cumsum(per_a))[self.a.edges]

    def sizes(self) -> list[np.ndarray]:
        """Per distinct unit: tokens of A, of B, groups, links."""
        groups = np.diff(np.append(0, np.cumsum(self.closes[0]))[self.a.edges])
        return [self.a.sizes, self.b.sizes, groups, np.diff(self.first)]

    def total(self, per_unit: np.ndarray) -> np.ndarray:
        """Sums per text of a whole number per distinct unit."""
        sums = np.append(0, np.cumsum(per_unit[self.unit]))
        edges = np.searchsorted(self.text, np.arange(self.n + 1))
        return sums[edges[1:]] - sums[edges[:-1]]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs, and in how many texts of the piece each is linked."""
        pairs = distinct(self.links)
        number = np.searchsorted(pairs, self.links)
        size = np.diff(self.first)
        text, unit = np.divmod(
            distinct(self.text * np.int64(max(len(size), 1)) + self.unit), max(len(size), 1))
        held = number[ragged(self.first[unit], size[unit])]
        once = distinct(np.repeat(text, size[unit]) * np.int64(max(len(pairs), 1)) + held)
        docs = np.bincount(once % max(len(pairs), 1), minlength=len(pairs))
        return pairs[docs > 0], docs[docs > 0]

    def groups(self) -> pa.Array:
        """The groups of each text, written ``a1,a2|b1;a3|b2``."""
        before_a = np.arange(len(self.a.flat)) + (np.cumsum(self.in_group[1]) - self.in_group[1])[
            self.group[0]]
        before_b = np.arange(len(self.b.flat)) + np.cumsum(self.in_group[0])[self.group[1]]
        codes = np.zeros(len(before_a) + len(before_b), np.int64)
        codes[before_a] = 2 * self.a.flat + self.closes[0]
        codes[before_b] = self.tables.b_written + 2 * self.b.flat + self.closes[1]
        own = Lists(codes, self.a.edges + self.b.edges).take(self.unit)
        held = self.tables.written.take(pa.array(own.flat))
        at = np.frombuffer(held.buffers()[1], np.int64)[:len(held) + 1] if len(held) \
            else np.zeros(1, np.int64)
        data = memoryview(held.buffers()[2]) if len(held) else b""
        edges = at[own.edges[np.searchsorted(self.text, np.arange(self.n + 1))]].tolist()
        return pa.array([bytes(data[x:max(x, y - 1)]) for x, y in itertools.pairwise(edges)],
                        pa.binary()).cast(pa.string())


def _pair_counts(a_path: str, b_path: str):
    """Distinct pairs of a task's documents with the documents that hold them, in parts."""
    def parts(keys, docs):
        for k in range(0, len(keys), CHUNK):
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[k:k + CHUNK]]), pa.array([docs[k:k + CHUNK]])],
                names=["keys", "docs"])

    def run(batches):
        aligner = Aligner(a_path, b_path)
        keys, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                more = AlignedPiece(aligner, piece.column("text")).counts()
                both, number = np.unique(np.concatenate([keys, more[0]]), return_inverse=True)
                docs = np.bincount(number, weights=np.concatenate([docs, more[1]])).astype(np.int64)
                keys = both
                if len(keys) > SLICE_PAIRS:
                    yield from parts(keys, docs)
                    keys, docs = keys[:0], docs[:0]
        yield from parts(keys, docs)
    return run


VECTOR = "chunk bigint, part int, counts binary"


def _vector_rows(chunks, part: int, vectors) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(chunks, pa.int64()), pa.array([part] * len(chunks), pa.int32()),
         pa.array([v.astype("<i8").tobytes() for v in vectors], pa.binary())],
        names=["chunk", "part", "counts"])


def _dense(hashed):
    """The counts of a task's rows as one vector by number, in chunks that are not all zero."""
    def run(batches):
        numbering = hashed.value
        vector = np.zeros(-(-len(numbering) // CHUNK) * CHUNK, np.int64)
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy()
            docs = batch.column("docs").flatten().to_numpy()
            number = numbering.numbers(keys)
            np.add.at(vector, number[number >= 0], docs[number >= 0])
        part = TaskContext.get().partitionId() % BRANCHES
        for k in range(len(vector) // CHUNK):
            own = vector[k * CHUNK:(k + 1) * CHUNK]
            if own.any():
                yield _vector_rows([k], part, [own])
    return run


def _summed(key: tuple, group: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for x in group.column("counts"):
        total += np.frombuffer(x.as_buffer(), "<i8")
    part = key[1].as_py() if len(key) > 1 else 0
    return pa.Table.from_batches([_vector_rows([key[0].as_py()], part, [total])])


class PairCounts:
    """Documents per pair, looked up by the numbers of a perfect hash, and the highest per A id."""

    def __init__(self, numbering: PerfectHash, counts: np.ndarray, b_size: int):
        self.numbering, self.counts = numbering, counts
        first = numbering.keys // b_size
        self.b_size = b_size
        self.best = np.zeros(int(first.max(initial=0)) + 1, np.int64)
        np.maximum.at(self.best, first, counts)

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each pair, and whether it is the highest of its A id; else 0, False."""
        number = self.numbering.numbers(pairs)
        known = number >= 0
        count = np.zeros(len(pairs), np.int64)
        count[known] = self.counts[number[known]]
        best = np.zeros(len(pairs), bool)
        best[known] = count[known] == self.best[pairs[known] // self.b_size]
        return count, best


ALIGNED = ("_id bigint, _th bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "n_best bigint, count_sum bigint, groups string")


def _looked_up(a_path: str, b_path: str, sent, with_groups: bool):
    def run(batches):
        aligner = Aligner(a_path, b_path)
        known = sent.value
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                held = AlignedPiece(aligner, piece.column("text"))
                count, best = known.of(held.links)
                sums = [np.append(0, np.cumsum(x))[held.first] for x in (best, count)]
                per_unit = [*held.sizes(), *map(np.diff, sums)]
                groups = held.groups() if with_groups else pa.nulls(held.n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in KEY], *[pa.array(held.total(x)) for x in per_unit],
                     groups],
                    names=[*KEY, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                           "groups"])
    return run


def _pair_counts_of(keys: DataFrame, parts: DataFrame, buckets: int, b_size: int) -> PairCounts:
    """The counts of ``keys``, a slice of the distinct pairs, from the counts per task."""
    spark = keys.sparkSession
    placed = (keys.select((F.col("key") % buckets).alias("bucket"), "key")
              .groupBy("bucket").applyInArrow(place_group, PLACED))
    numbering = PerfectHash(placed.toArrow(), buckets)
    hashed = spark.sparkContext.broadcast(numbering)
    vectors = parts.coalesce(COUNTERS).mapInArrow(_dense(hashed), VECTOR)
    summed = (vectors.groupBy("chunk", "part").applyInArrow(_summed, VECTOR)
              .groupBy("chunk").applyInArrow(_summed, VECTOR)).toArrow()
    hashed.unpersist()
    counts = np.zeros(-(-len(numbering) // CHUNK) * CHUNK, np.int64)
    for chunk, vector in zip(summed.column("chunk").to_pylist(), summed.column("counts"),
                             strict=True):
        counts[chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(vector.as_buffer(), "<i8")
    return PairCounts(numbering, counts[:len(numbering)], b_size)


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text",
    slice_pairs: int = SLICE_PAIRS, with_groups: bool = True,
) -> DataFrame:
    """Per row of ``docs``: _id, _th (see ``document_key``) and how its two tokenizations align.

    A is a byte-level vocabulary file of ``tokenizers``, B a ``sentencepiece`` model with byte
    fallback that adds a space; A reads the text with a space before it. n_a and n_b count tokens,
    n_groups the groups between byte offsets at which tokens of both end, n_links the pairs of an
    A and a B token in one group. The count of an id pair is the number of rows of ``docs`` that
    have it linked; count_sum adds it up over the links, n_best counts the links whose count is
    the highest that their A id has with any B id. ``groups`` writes the groups in order (null
    without ``with_groups``).

    A text that is null, empty, or not given back by the bytes of either tokenization (one with
    U+2581, say) has zeros and empty groups, and counts nowhere. Each row counts, repeated rows
    and rows without id too. Other columns play no part. A very long text is one task's work.
    """
    import sentencepiece

    spark = docs.sparkSession
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = docs.select(F.col(text_col).cast("string").alias("text"),
                       *[c.alias(n) for n, c in document_key(docs, id_col, text_col).items()])
    parts = stage(rows.select("text").mapInArrow(
        _pair_counts(a_path, b_path), "keys array<bigint>, docs array<bigint>"), "pair_counts")
    keys = stage(parts.select(F.explode("keys").alias("key")).distinct(), "pairs")
    total = keys.count()
    slices = max(1, -(-total // slice_pairs))
    # all pairs of an A id are in one slice, so that it knows the highest count
    own = F.pmod(F.xxhash64(F.expr(f"key div {b_size}")), F.lit(slices))
    out = None
    for k in range(slices):
        held = _pair_counts_of(keys.where(own == k), parts, buckets_for(total // slices), b_size)
        sent = spark.sparkContext.broadcast(held)
        found = rows.mapInArrow(_looked_up(a_path, b_path, sent, with_groups and k == 0), ALIGNED)
        if slices == 1:
            release(parts, keys)
            return found
        if k == 0:
            out = stage(found, "aligned")
        else:
            # rows that agree in the key have the same sums
            more = stage(found.select(*KEY, F.col("n_best").alias("_b"), F.col("count_sum").alias("_c"))
                         .dropDuplicates(KEY), "aligned_more")
            out = stage(out.join(more, same(out, more, KEY)).select(
                *[out[c] for c in out.columns if c not in ("n_best", "count_sum")],
                (out["n_best"] + more["_b"]).alias("n_best"),
                (out["count_sum"] + more["_c"]).alias("count_sum")), "aligned")
            release(more)
        sent.unpersist()
    release(parts, keys)
    return out
