"""Near duplicates by weighted minhashes (BagMinHash) of the bag of word shingles.

A text is a bag of five-word shingles. In a BagMinHash, every unit of weight of every shingle is
a Poisson process in time, with a rate of one point per signature component; a component keeps
the earliest point that falls on it. Weights are cut at 1, 2, 4, 8, ...: a shingle of weight w
runs the blocks [0,1), [1,2), [2,4), ... below w, one process per block at the rate of its width,
and a point's place in the block comes from halving it, so that equal shingles of different
weights share the points below the smaller weight. Two components are then equal with exactly
the weighted Jaccard similarity as probability. Points later than the last component's are never
made: a time limit is set from the bag's weight and raised for the few texts that need it.

Bands of components give candidates, and exact bag overlap decides. Texts with one bag are one
class, and only classes are compared. Inside a bucket, members are first compared with a few
heads, the classes that meet most others in buckets, which are the middle of a group of copies.
What is then still apart in a bucket is settled by an exact set-similarity join: bags are ordered
by rarity, and two of them are compared only if a rare element is early enough in both. So the
pairs of a large group are not made, and similar classes of a bucket end in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafill.llm.common import KEY, document_key, same
from stratafill.llm.components import connected_components
from stratafill.llm.words import lists, mix, per_piece, shingle_hashes, words_of
from stratafill.sources.staging import release, stage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
HEADS = 3
BANDS, ROWS = 32, 5  # misses a pair of similarity 0.8 with probability (1 - 0.8**5)**32 = 3e-6
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1 << 12, dtype=np.uint64) * _GOLDEN


def bags(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), ordered by text and shingle."""
    texts, hashes = shingle_hashes(words_of(column), size)
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    first = np.ones(len(texts), bool)
    first[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return texts[at], hashes[at], np.diff(np.append(at, len(texts)))


def bag_minhash(
    texts: np.ndarray, items: np.ndarray, weights: np.ndarray, n_texts: int, size: int
) -> np.ndarray:
    """Signatures (n_texts, size): the earliest time per component, infinite for an empty bag.

    ``items`` are 64-bit hashes with whole weights; ``texts`` says whose they are.
    """
    times = np.full(n_texts * size, np.inf)
    total = np.bincount(texts, weights=weights, minlength=n_texts)
    pending = np.flatnonzero(total > 0)
    reach = np.log(size) + 4  # leaves a component empty in about one text of fifty
    while len(pending):
        limit = np.zeros(n_texts)
        limit[pending] = reach / total[pending]
        block = 0
        own = np.flatnonzero(limit[texts] > 0)
        while len(own):
            low, width = (0, 1) if block == 0 else (1 << (block - 1), 1 << (block - 1))
            own = own[weights[own] > low]
            _block_points(times, texts[own], items[own], weights[own], limit, block, low, width, size)
            block += 1
        empty = np.isinf(times.reshape(n_texts, size)[pending]).any(axis=1)
        pending = pending[empty]
        reach *= 2
    return times.reshape(n_texts, size)


def _block_points(times, texts, items, weights, limit, block, low, width, size) -> None:
    """Lower ``times`` by the points of one block of weight that come before the limit."""
    state = mix(items + _STEPS[block + 1])
    now, step = np.zeros(len(items)), 0
    while len(items):
        step += 1
        draw = mix(state + _STEPS[step & 0xFFF] ^ np.uint64(step >> 12))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        now = now - np.log(uniform) / (size * width)
        alive = np.flatnonzero(now <= limit[texts])
        texts, items, weights, state, now = (
            x[alive] for x in (texts, items, weights, state, now))
        other = mix(draw[alive] ^ np.uint64(0xD1B54A32D192ED03))
        component = ((other >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        # each low bit halves what is left of the block
        place = low + (other & np.uint64(width - 1)).astype(np.int64)
        hit = place < weights
        np.minimum.at(times, texts[hit] * size + component[hit], now[hit])


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = mix(signatures.view(np.uint64)).reshape(len(signatures), bands, rows)
    out = np.zeros(bits.shape[:2], np.uint64)
    for k in range(rows):
        out = mix(out + bits[:, :, k])
    return out


SIGNED = "_id bigint, _th bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>"


def _signed(size: int, bands: int, rows: int):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        n = piece.num_rows
        texts, items, counts = bags(piece.column("text"), size)
        signature = bag_minhash(texts, items, counts, n, bands * rows)
        both = items + counts.astype(np.uint64) * _GOLDEN
        h = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
        np.add.at(h[0], texts, mix(both))
        np.add.at(h[1], texts, mix(both ^ np.uint64(0x5851F42D4C957F2D)))
        held = np.bincount(texts, weights=counts, minlength=n).astype(np.int64)
        flat = band_hashes(signature, bands, rows).reshape(-1).view(np.int64)
        listed = pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(flat))
        return pa.RecordBatch.from_arrays(
            [piece.column("_id"), piece.column("_th"), pa.array(held),
             pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), listed],
            names=["_id", "_th", "n", "h1", "h2", "bands"])
    return per_piece(run)


def _sets(size: int):
    """Bags as sets: the k-th copy of a shingle is an element of its own."""
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts, items, counts = bags(piece.column("text"), size)
        owner = np.repeat(texts, counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        copy = np.arange(len(owner)) - first
        element = mix(np.repeat(items, counts) + copy.astype(np.uint64) * _GOLDEN)
        return pa.RecordBatch.from_arrays(
            [piece.column("cid"), lists(owner, pa.array(element.view(np.int64)), piece.num_rows)],
            names=["cid", "bag"])
    return per_piece(run)


def similar_pairs(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, size: int
) -> DataFrame:
    """Of the candidate ``pairs`` (a, b) those of weighted Jaccard ``threshold`` or more."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    texts = wanted.join(classes.select("cid", *KEY), "cid")
    found = docs.join(texts, same(docs, texts, KEY)).select("cid", "text")
    # a document may be there twice; written after that, so that a class of many pairs is split
    one = stage(found.mapInArrow(_sets(size), "cid bigint, bag array<bigint>")
                .dropDuplicates(["cid"]), "bags")
    joined = (pairs.join(one.select(F.col("cid").alias("a"), F.col("bag").alias("x")), "a")
              .join(one.select(F.col("cid").alias("b"), F.col("bag").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    linked = stage(joined.select(
        "a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity"))
        .where(F.col("similarity") >= threshold), "links")
    release(one)
    return linked


def _apart(
    shared: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame,
    threshold: float, size: int,
) -> DataFrame:
    """Candidate pairs (a, b) across components that meet in a bucket of ``shared``.

    Of two such classes, one is not in the largest component of the bucket. Those are looked up
    among all classes of such buckets: two bags reach the threshold only if a shared element has
    few rarer ones before it in both.
    """
    # tables with a row per key are written before they are joined: a large group is then split
    sizes = stage(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "part_sizes")
    own = parts.join(sizes, "component").withColumnRenamed("node", "cid")
    member = shared.select("band", "hash", "cid").join(own, "cid", "left").select(
        "band", "hash", "cid", F.coalesce("component", "cid").alias("component"),
        F.coalesce("size", F.lit(1)).alias("size"))
    rank = F.struct("size", "component")
    tops = stage(member.groupBy("band", "hash").agg(
        F.max(rank).alias("top"), F.min(rank).alias("low")).where("top != low")
        .select("band", "hash", "top"), "tops")
    apart = member.join(tops, ["band", "hash"])
    asked = stage(apart.groupBy("cid", "component", "size").agg(
        F.max(F.col("component") != F.col("top.component")).alias("asks")), "apart")

    texts = classes.select("cid", *KEY).join(asked, "cid")
    found = docs.join(texts, same(docs, texts, KEY)).select("cid", "text")
    bags_ = found.mapInArrow(_sets(size), "cid bigint, bag array<bigint>").dropDuplicates(["cid"])
    held = stage(bags_, "open_bags")
    elements = held.select("cid", F.size("bag").alias("n"), F.explode("bag").alias("element"))
    often = stage(elements.groupBy("element").agg(F.count(F.lit(1)).alias("often"))
                  .where("often > 1"), "often")
    # of an element that no other bag has, only the number before the shared ones matters
    listed = elements.join(often, "element").select("cid", "n", "element", "often")
    order = Window.partitionBy("cid").orderBy("often", "element")
    shared_ones = F.count(F.lit(1)).over(Window.partitionBy("cid"))
    placed = listed.withColumn(
        "place", F.col("n") - shared_ones + F.row_number().over(order) - 1)
    placed = stage(placed.where(
        F.col("place") < F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
        .select("cid", "n", "element", "place").join(asked, "cid"), "open_prefixes")
    x = placed.where("asks").select("element", *[
        F.col(c).alias(f"x_{c}") for c in ("cid", "n", "place", "size", "component")])
    y = placed.select("element", *[
        F.col(c).alias(f"y_{c}") for c in ("cid", "n", "place", "size", "component")])
    need = F.ceil((F.col("x_n") + F.col("y_n")) * (threshold / (1 + threshold)) - 1e-9)
    room = 1 + F.least(F.col("x_n") - F.col("x_place") - 1, F.col("y_n") - F.col("y_place") - 1)
    pairs = x.join(y, "element").where(
        (F.struct("x_size", "x_component") < F.struct("y_size", "y_component")) & (room >= need)
        & (F.least("x_n", "y_n") >= threshold * F.greatest("x_n", "y_n") - 1e-9))
    found = stage(pairs.select(F.greatest("x_cid", "y_cid").alias("a"),
                               F.least("x_cid", "y_cid").alias("b")).distinct(), "apart_pairs")
    release(sizes, tops, asked, held, often, placed)
    return found


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """Per document (_id, _th; see ``document_key``) its class and its group of near duplicates.

    Returns _id, _th, class_id and group_id (long), copies (documents of the class), and
    keep: true for the least document (_id, then _th; null first) of each group. Two documents
    are in one group if a chain of pairs of similarity ``threshold`` or more joins them. Texts
    that are null or have no word are alone, each with its own negative ids. Repeated rows of a
    document give one row. Other columns of ``docs`` play no part.
    """
    docs = docs.select(F.col(text_col).cast("string").alias("text"),
                       *[c.alias(n) for n, c in document_key(docs, id_col, text_col).items()])
    signed = stage(docs.mapInArrow(_signed(shingle_words, bands, rows), SIGNED), "signed")
    documents = signed.groupBy(*KEY, "n", "h1", "h2").agg(F.first("bands").alias("bands"))
    classes = stage(
        documents.where("n > 0").groupBy("n", "h1", "h2")
        .agg(F.min(F.struct(*KEY)).alias("least"), F.count(F.lit(1)).alias("copies"),
             F.first("bands").alias("bands"))
        .select("n", "h1", "h2", "copies", "bands", "least.*",
                F.monotonically_increasing_id().alias("cid")), "classes")

    buckets = classes.select("cid", "n", F.posexplode("bands").alias("band", "hash"))
    bucket = ["band", "hash"]
    several = stage(buckets.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members"))
                    .where("members > 1"), "several")
    shared = stage(buckets.join(several, bucket), "buckets")
    met = shared.groupBy("cid").agg(F.sum(F.col("members") - 1).alias("met"))
    heads = stage(
        shared.join(met, "cid")
        .groupBy(*bucket, F.pmod(F.xxhash64("cid"), F.lit(HEADS)).alias("part"))
        .agg(F.max(F.struct("met", "cid", "n")).alias("head")), "heads")
    near = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9
    tried = stage(
        shared.join(heads, bucket).select(
            "cid", "n", F.col("head.cid").alias("other"), F.col("head.n").alias("m"))
        .where((F.col("cid") != F.col("other")) & near)
        .select(F.greatest("cid", "other").alias("a"), F.least("cid", "other").alias("b"))
        .distinct(), "tried")
    links = similar_pairs(tried, classes, docs, threshold, shingle_words)
    parts = stage(connected_components(links.select("a", "b")), "parts")

    rest = _apart(shared, parts, classes, docs, threshold, shingle_words)
    more = similar_pairs(
        rest.join(tried, ["a", "b"], "left_anti"), classes, docs, threshold, shingle_words)
    groups = stage(connected_components(
        links.select("a", "b").unionByName(more.select("a", "b"))), "groups")
    release(several, shared, heads, tried, links, parts, rest, more)

    named = classes.select("cid", "n", "h1", "h2", "copies", *KEY).join(
        groups.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("group_id", F.coalesce("component", "cid"))
    least = stage(named.groupBy("group_id").agg(F.min(F.struct(*KEY)).alias("kept")), "least")
    named = named.join(least, "group_id").select(
        "n", "h1", "h2", "copies", "group_id", F.col("cid").alias("class_id"), "kept")
    rows_ = documents.drop("bands")
    alone = rows_.where("n = 0").select(
        *KEY, (-1 - F.monotonically_increasing_id()).alias("class_id")).select(
        *KEY, "class_id", F.col("class_id").alias("group_id"), F.lit(1).cast("bigint").alias("copies"),
        F.lit(True).alias("keep"))
    named = stage(named, "named")
    return rows_.where("n > 0").join(named, ["n", "h1", "h2"]).select(
        *KEY, "class_id", "group_id", "copies",
        (F.col("_id").eqNullSafe(F.col("kept._id")) & F.col("_th").eqNullSafe(F.col("kept._th")))
        .alias("keep")).unionByName(alone)
