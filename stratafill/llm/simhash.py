"""Near duplicates by SimHash, linked within a Hamming radius by BK-trees of shards.

A fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of the text's word
shingles. Only distinct fingerprints are compared. They are dealt to shards so that any two within
the radius meet: the bits are cut into blocks, and for each choice of ``radius`` blocks a shard
holds the fingerprints that agree in all other bits. The number of blocks follows the number of
fingerprints, which keeps the usual shard at a few of them; the links are the same for any.

Where a shard has few fingerprints, its tree is built and asked in the task where they meet. The
trees of a larger shard are cut to ``TREE_PRINTS`` each and broadcast, about ``ROUND_PRINTS``
fingerprints a round, and its fingerprints ask them from all tasks. A task reduces the links that
it finds to stars, so a dense group of near copies does not send all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafill.llm.bktree import Forest, star_links
from stratafill.llm.components import connected_components
from stratafill.llm.spaced import SpacedWords
from stratafill.llm.words import per_piece
from stratafill.sources.staging import release, stage

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BITS = 64
TREE_PRINTS = 4096
ROUND_PRINTS = 1_000_000
SHARD_MEAN = 8
_TOGETHER = 1 << 16


def shingle_hashes(words: SpacedWords, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, XXH64) of each run of ``size`` words; a shorter text has one run of all its words."""
    bounds, starts = words.bounds, words.starts
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, (n > 0).astype(np.int64)))
    per_text = np.bincount(text, minlength=len(n))
    within = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = bounds[:-1][text] + within
    last = np.minimum(first + size, bounds[1:][text])
    data, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(data[a:b], SEED) for a, b in
              zip(starts[first].tolist(), (starts[last] - 1).tolist(), strict=True)]
    return text, np.array(hashes, np.uint64)


def majority_bits(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Per text (0 to n - 1, ascending) the bits that over half of its hashes have; none: 0."""
    out = np.zeros((n, BITS), bool)
    edges = np.searchsorted(text, np.arange(n + 1))
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edges[some], axis=0, dtype=np.int64)
        out[some] = 2 * ones > np.diff(edges)[some][:, None]
    return np.packbits(out, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def _printed(size: int):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = SpacedWords(piece.column("text"), lower=True)
        made = majority_bits(*shingle_hashes(words, size), piece.num_rows)
        return pa.RecordBatch.from_arrays(
            [piece.column("_id"), pa.array(made.view(np.int64))], names=["_id", "print"])
    return per_piece(run)


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
) -> DataFrame:
    """Per row of ``docs``: _id and print, the 64 bits as a long; 0 for a text without words."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_printed(shingle_words), "_id bigint, print bigint")


def shard_masks(prints: int, radius: int) -> list[int]:
    """Bits that agree, per choice of ``radius`` blocks that may differ (as signed longs).

    Any two fingerprints within the radius agree under one of the masks at least.
    """
    blocks = radius + 1
    while blocks < BITS and prints >> (BITS * (blocks - radius) // blocks) > SHARD_MEAN:
        blocks += 1
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(x) for x in combinations(parts, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


LINK = "a bigint, b bigint"


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Stars of links between fingerprints, as longs."""
    x, y = star_links(a.view(np.int64), b.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def _shard_links(radius: int):
    """Links inside shards whose rows come one shard after another."""
    def linked(mask, value, prints):
        fresh = np.ones(len(prints), bool)
        fresh[1:] = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
        tree = np.cumsum(fresh) - 1
        forest = Forest(prints, tree)
        query, node = forest.near(prints, forest.roots[tree], radius)
        pairs = query < node
        return _links(prints[query[pairs]], prints[node[pairs]])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in
                    zip(held, ("mask", "value", "print"), strict=True)]
            if len(held[0]) < _TOGETHER:
                continue
            # the last shard may go on
            last = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1]) + 1
            yield linked(held[0][:last], held[1][:last], held[2][:last].view(np.uint64))
            held = [x[last:] for x in held]
        if len(held[0]):
            yield linked(held[0], held[1], held[2].view(np.uint64))
    return run


class ShardTrees:
    """Trees of several shards; a shard may have more than one."""

    def __init__(self, rows: pa.Table):
        columns = [rows.column(c).to_numpy() for c in ("mask", "value", "tree", "print")]
        order = np.lexsort(columns[2::-1])
        mask, value, tree, prints = (x[order] for x in columns)
        fresh = np.ones(len(prints), bool)
        for x in (mask, value, tree):
            fresh[1:] &= x[1:] == x[:-1]
        fresh[1:] = ~fresh[1:]
        self.forest = Forest(prints.view(np.uint64), np.cumsum(fresh) - 1)
        self.shards: dict[tuple[int, int], list[int]] = {}
        at = np.flatnonzero(fresh)
        for root, m, v in zip(self.forest.roots.tolist(), mask[at].tolist(), value[at].tolist(),
                              strict=True):
            self.shards.setdefault((m, v), []).append(root)

    def links(self, mask, value, prints, radius: int) -> pa.RecordBatch:
        roots = [self.shards.get(x, ()) for x in zip(mask.tolist(), value.tolist(), strict=True)]
        asks = np.repeat(np.arange(len(prints)), [len(x) for x in roots])
        found, node = self.forest.near(
            prints[asks], np.array([r for x in roots for r in x], np.int64), radius)
        return _links(prints[asks[found]], self.forest.prints[node])


def _tree_links(sent, radius: int):
    def run(batches):
        trees = sent.value
        for batch in batches:
            mask, value, prints = (batch.column(c).to_numpy() for c in ("mask", "value", "print"))
            yield trees.links(mask, value, prints.view(np.uint64), radius)
    return run


def _rounds(large: DataFrame, total: int) -> tuple[Column, int]:
    """A round per tree, such that none is over twice ``ROUND_PRINTS`` (or a single tree)."""
    rounds = -(-total // ROUND_PRINTS)
    while True:
        own = F.pmod(F.xxhash64("mask", "value", "tree"), F.lit(rounds))
        most = large.groupBy(own.alias("round")).agg(F.count(F.lit(1)).alias("n")).agg(
            F.max("n")).first()[0]
        if most <= 2 * ROUND_PRINTS or rounds >= total:
            return own, rounds
        rounds *= 2


def near_prints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose connected components are those of the distinct ``print`` values.

    Two are linked if they differ in ``radius`` bits or fewer; of the links found in one task
    those of a spanning star forest are returned. ``prints`` is read more than once.
    """
    spark = prints.sparkSession
    masks = shard_masks(prints.count(), radius)
    dealt = F.explode(F.array(*[F.struct(
        F.lit(i).cast("bigint").alias("mask"),
        F.col("print").bitwiseAND(F.lit(m).cast("bigint")).alias("value"))
        for i, m in enumerate(masks)]))
    entries = prints.select("print", dealt.alias("shard")).select("shard.*", "print")
    shard = ["mask", "value"]
    # written, so that the join below has two plain shuffles and a large shard can be split
    sizes = stage(entries.groupBy(*shard).agg(F.count(F.lit(1)).alias("size"))
                  .where("size > 1"), "shard_sizes")
    joined = entries.join(sizes, shard)
    small = (joined.where(F.col("size") <= TREE_PRINTS).select(*shard, "print")
             .repartition(*shard).sortWithinPartitions(*shard))
    links = [stage(small.mapInArrow(_shard_links(radius), LINK), "print_links")]
    if not sizes.where(F.col("size") > TREE_PRINTS).isEmpty():
        trees = F.ceil(F.col("size") / TREE_PRINTS)
        large = stage(joined.where(F.col("size") > TREE_PRINTS).select(
            *shard, "print", F.pmod(F.xxhash64("print"), trees).alias("tree")), "large_shards")
        own, rounds = _rounds(large, large.count())
        for k in range(rounds):
            sent = spark.sparkContext.broadcast(ShardTrees(large.where(own == k).toArrow()))
            links.append(stage(large.select(*shard, "print").mapInArrow(
                _tree_links(sent, radius), LINK), "tree_links"))
            sent.unpersist()
        release(large)
    release(sizes)
    found = stage(_union(links).distinct(), "print_links")
    release(*links)
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for x in rest:
        first = first.unionByName(x)
    return first


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
    shingle_words: int = SHINGLE_WORDS,
) -> DataFrame:
    """Per row of ``docs``: _id, print (long) and component_id.

    ``component_id`` is the least id that a chain of links reaches, the own id included; null ids
    do not count, and a component without any id has null. Texts that are null or have no word
    have the fingerprint 0, which is linked like any other. Words are what stands between ASCII
    white space, with A-Z as a-z; shingles repeat as they occur, and a text of fewer words is one
    shingle. Each row gives a row, repeated rows too. Other columns play no part.
    """
    printed = stage(fingerprints(docs, id_col=id_col, text_col=text_col,
                                 shingle_words=shingle_words), "prints")
    classes = stage(printed.groupBy("print").agg(F.min("_id").alias("least")), "print_classes")
    links = near_prints(classes.select("print"), radius)
    parts = connected_components(links).withColumnRenamed("node", "print")
    named = classes.join(parts, "print", "left").withColumn(
        "component", F.coalesce("component", "print"))
    least = stage(named.groupBy("component").agg(F.min("least").alias("component_id")), "least_ids")
    named = stage(named.select("print", "component").join(least, "component")
                  .select("print", "component_id"), "print_components")
    release(links, classes, least)
    # two written tables: a fingerprint that many rows share is split
    return printed.join(named, "print").select("_id", "print", "component_id")
