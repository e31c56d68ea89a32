"""Best-fit packing of documents into training sequences, planned on counts.

Documents become token ids and an end id; one longer than a sequence is cut, its last pieces
whole sequences. The plan needs only how many pieces have each length: at most ``capacity``
numbers. Lengths are placed from long to short, each into the sequences with the least room that
still fits; sequences with equal room are one entry with a range of numbers, so a step places
thousands of pieces at once, and the plan has a size that does not follow the documents. A piece
then takes its place by its rank among the pieces of its length. A whole sequence needs no plan:
it is numbered where it was made and never shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafill.llm.common import KEY, document_key
from stratafill.llm.tokens import UnitTokens
from stratafill.llm.words import per_piece
from stratafill.sources.staging import stage

CAPACITY = 2048
END_ID = 0
RANK_ROWS = 50_000
PIECE = 2 << 20  # of more text, more units are equal


PIECES = ("_id bigint, _th bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
          "ids binary, _task int, _nth bigint")


def _cut(path: str, capacity: int, with_ids: bool, narrow: bool):
    kind = "<u2" if narrow else "<u4"

    def pieces_of(piece: pa.RecordBatch, encode: UnitTokens) -> pa.RecordBatch:
        n, (units, first) = piece.num_rows, encode(piece.column("text"))
        ends = units.edges[first[1:]]
        # the end id follows the ids of each text
        flat = np.insert(units.flat, ends, END_ID).astype("<u4")
        size = np.diff(np.append(0, ends)) + 1
        edge = np.append(0, np.cumsum(size))
        many = -(-size // capacity)
        row = np.repeat(np.arange(n), many)
        number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        # the first piece takes what is over
        over = (size - 1) % capacity + 1
        start = np.where(number == 0, 0, over[row] + (number - 1) * capacity)
        length = np.where(number == 0, over[row], capacity)
        begin = (edge[row] + start).tolist()
        parts = [flat[i:i + k] for i, k in zip(begin, length.tolist(), strict=True)]
        take = pa.array(row)
        ids = [x.astype(kind).tobytes() if with_ids else None for x in parts]
        return pa.RecordBatch.from_arrays(
            [*[piece.column(c).take(take) for c in KEY], pa.array(number, pa.int32()),
             pa.array(start), pa.array(length),
             pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(ids, pa.binary())],
            names=[*KEY, "piece", "start", "length", "ids_crc32", "ids"])

    def run(batches):
        encode = UnitTokens(path)  # for this task
        task, full = TaskContext.get().partitionId(), 0
        for some in per_piece(
                lambda piece: pieces_of(piece, encode), most=PIECE)(batches):
            whole = some.column("length").to_numpy() == capacity
            nth = np.where(whole, full + np.cumsum(whole) - 1, -1)
            full += int(whole.sum())
            yield some.append_column("_task", pa.array([task] * some.num_rows, pa.int32())
                                     ).append_column("_nth", pa.array(nth))
    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, with_ids: bool = True, narrow: bool = False,
) -> DataFrame:
    """Per piece: _id, _th, piece, start, length, ids_crc32 and ids (null without ``with_ids``).

    ``ids`` are little-endian 32-bit numbers, 16-bit ones with ``narrow``; the digest is of the
    32-bit ones. _task and _nth number the pieces of ``capacity`` in the task that made them.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"),
                        *[c.alias(n) for n, c in document_key(docs, id_col, text_col).items()])
    return texts.mapInArrow(_cut(tokenizer, capacity, with_ids, narrow), PIECES)


def _widen(batches):
    for batch in batches:
        column = batch.column("ids").cast(pa.large_binary())
        _, places, data = column.buffers()
        offsets = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
        if len(offsets) and data is not None:
            ids = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view("<u2").astype("<u4")
            edges = ((offsets - offsets[0]) * 2).astype(np.int32)
        else:
            ids, edges = np.zeros(0, "<u4"), np.zeros(batch.num_rows + 1, np.int32)
        wide = pa.Array.from_buffers(
            pa.binary(), batch.num_rows, [None, pa.py_buffer(edges), pa.py_buffer(ids)])
        yield batch.set_column(batch.schema.get_field_index("ids"), "ids", wide)


def widened(packed: DataFrame) -> DataFrame:
    """``packed`` with its ids, 16-bit numbers end to end and never null, as 32-bit ones."""
    return packed.mapInArrow(_widen, packed.schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: (length, first rank, last rank, sequence, offset, per sequence).

    Ranks [first, last) of a length go to sequences from ``sequence`` on, ``per sequence`` each,
    side by side from ``offset``.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences
    rooms: list[int] = []
    made = 0

    def put(left: int, first: int, last: int) -> None:
        if first < last and left > 0:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, last))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                first, last = room[left].pop()
                if not room[left]:
                    del room[left], rooms[k]
            else:  # new sequences, as many as the rest needs
                left, each = capacity, capacity // length
                first, last = made, made + -(-(total - rank) // each)
                made = last
            each = left // length
            full = min(last - first, (total - rank) // each)
            if full:
                steps.append((length, rank, rank + full * each, first, capacity - left, each))
                rank += full * each
                put(left - each * length, first, first + full)
                first += full
            if first < last and rank < total:  # the last sequence of this length is not full
                some = total - rank
                steps.append((length, rank, total, first, capacity - left, some))
                rank = total
                put(left - some * length, first, first + 1)
                first += 1
            put(left, first, last)
    return steps


def _places(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` of less than ``capacity`` with sequence_id and offset, by rank within length."""
    spark = pieces.sparkSession
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    steps = spark.createDataFrame(
        plan(counts, capacity), "length bigint, low bigint, high bigint, sequence bigint, "
                                "at bigint, each bigint")
    # rank within length: parts of a length are counted, then numbered inside; a part has about
    # RANK_ROWS pieces, however many a length has
    parts = spark.createDataFrame(
        [(k, n // RANK_ROWS + 1) for k, n in counts.items()], "length bigint, _parts bigint")
    part = F.pmod(F.xxhash64("_id", "_th", "piece"), F.col("_parts")).cast("int")
    parted = pieces.join(F.broadcast(parts), "length").withColumn("_part", part).drop("_parts")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (parted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("length", "_part",
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("length", "_part").orderBy("_id", "_th", "piece")
    ranked = (parted.withColumn("_rank", F.row_number().over(inside) - 1)
              .join(offsets, ["length", "_part"])
              .withColumn("_rank", F.col("_rank") + F.col("_before")))
    placed = ranked.join(
        F.broadcast(steps.withColumnRenamed("length", "_length")),  # bounded by ``capacity``
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("low"))
        & (F.col("_rank") < F.col("high")))
    nth = F.col("_rank") - F.col("low")
    return placed.select(
        *pieces.columns,
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("bigint").alias("offset"))


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of :func:`token_pieces` with sequence_id and offset (long).

    No sequence holds more than ``capacity``; its pieces lie side by side from 0. A piece of
    ``capacity`` fills a sequence alone: it gets a negative number, by its place in its task after
    the pieces of the tasks before, and is not shuffled. The others are planned and get numbers
    from 0. ``pieces`` is read four times, so pass a written table. Equal rows get places of
    their own.
    """
    own = ["_task", "_nth"]
    parts = _places(pieces.where(F.col("length") < capacity), capacity).drop(*own)
    full = pieces.where(F.col("length") == capacity)
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = full.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_task").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = full.join(F.broadcast(tasks), F.col("_task") == F.col("_of"))  # a row per task
    alone = numbered.select(
        *[c for c in pieces.columns if c not in own],
        (-1 - F.col("_before") - F.col("_nth")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    return parts.unionByName(alone)


def _is_narrow(tokenizer: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, with_ids: bool = True,
) -> DataFrame:
    """Tokenize and pack ``docs``: a row per piece, with its sequence and its offset there.

    ``ids`` are little-endian 32-bit numbers; they are written and shuffled as 16-bit ones if the
    vocabulary allows. A null text counts as empty and is the end id alone. Each row of ``docs``
    is packed, repeated rows too. Other columns play no part. A very long text is tokenized by
    one task, in memory in proportion to it. The tokenized pieces are written to the shared
    folder.
    """
    narrow = with_ids and _is_narrow(tokenizer)
    pieces = stage(token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col,
                                capacity=capacity, with_ids=with_ids, narrow=narrow), "pieces")
    packed = pack(pieces, capacity=capacity)
    return widened(packed) if narrow else packed
