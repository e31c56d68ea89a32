"""Sharding by fixed virtual slots.

A record's slot is a hash of its id and text among a fixed number of slots. Bytes are summed per
slot, and a small versioned table maps slots to shards. Only that table is edited when shards
are added: the records of a slot move together, and no other record is touched.

Everything is DataFrame functions. Tables of slots have SLOTS rows, so they may be folded in one
row and broadcast; records are only ever joined with such a table, or numbered in fine cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
CELLS = 64  # parts of a slot, so that numbering records sorts few of them together


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def place_hash(id_: Column, text: Column) -> Column:
    """Null ids and null texts hash like any other value."""
    return F.xxhash64(id_, id_.isNull(), F.crc32(text.cast("binary")), F.octet_length(text))


def slot_of(hash_: Column, slots: int = SLOTS) -> Column:
    return F.pmod(hash_, F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame, slot: str = "slot", size: str = "size", slots: int = SLOTS
               ) -> DataFrame:
    """(slot, bytes, records) of every slot, empty ones too."""
    sums = records.groupBy(F.col(slot).alias("slot")).agg(
        F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("records"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(sums, "slot", "left").fillna(0, ["bytes", "records"])


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map (version, slot, shard): the heaviest slot to the lightest shard."""
    return _deal(sizes, F.array_repeat(F.lit(0).cast("bigint"), shards)).select(
        F.lit(1).alias("version"), "slot", "shard")


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version for more shards: slots move into the new shards only.

    Each old shard gives away slots, lightest bits of a hash first, as long as it stays at its
    share or above; those are dealt to the new shards, the heaviest to the lightest.
    """
    now = slot_map.select("version", "slot", "shard").join(sizes, "slot")
    every = Window.partitionBy(F.lit(0))  # SLOTS rows
    order = Window.partitionBy("shard").orderBy(F.xxhash64("slot"), "slot")
    own = Window.partitionBy("shard")
    now = now.withColumns({
        "_old": F.max("shard").over(every) + 1,
        "_spare": F.sum("bytes").over(own) - F.sum("bytes").over(every) / shards,
        "_given": F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    moves = F.col("_given") <= F.col("_spare")
    old = now.agg(F.max("_old").alias("_old"), F.max("version").alias("version"))
    dealt = _deal(now.where(moves).select("slot", "bytes"), None, (old, shards))
    kept = now.where(~moves).select((F.col("version") + 1).alias("version"), "slot", "shard")
    return kept.unionByName(dealt.select("version", "slot", "shard"))


def _deal(sizes: DataFrame, empty: Column | None, grown: tuple[DataFrame, int] | None = None
          ) -> DataFrame:
    """Deal slots from heavy to light, each to the shard with the fewest bytes so far."""
    one = sizes.agg(F.array_sort(F.collect_list(
        F.struct((-F.col("bytes")).alias("minus"), "slot"))).alias("slots"))
    first, extra = F.lit(0), []
    if grown:
        old, shards = grown
        one = one.join(F.broadcast(old))  # a row each
        first, extra = F.col("_old"), [(F.col("version") + 1).alias("version")]
        empty = F.array_repeat(F.lit(0).cast("bigint"), (F.lit(shards) - F.col("_old")).cast("int"))

    def give(state: Column, slot: Column) -> Column:
        light = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        loads = F.transform(
            state["loads"], lambda x, i: F.when(i + 1 == light, x - slot["minus"]).otherwise(x))
        return F.struct(loads.alias("loads"),
                        F.concat(state["shards"], F.array(light - 1)).alias("shards"))

    start = F.struct(empty.alias("loads"), F.array().cast("array<int>").alias("shards"))
    dealt = one.select(*extra, first.cast("int").alias("_first"), "slots", F.aggregate(
        "slots", start, give, lambda s: s["shards"]).alias("shards"))
    return dealt.select(*[c for c in dealt.columns if c == "version"], "_first",
                        F.explode(F.arrays_zip("slots", "shards")).alias("s")).select(
        *[c for c in dealt.columns if c == "version"], F.col("s.slots.slot").alias("slot"),
        (F.col("s.shards") + F.col("_first")).alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; older versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("version", "slot", "shard")


def shard_of(records: DataFrame, slot_map: DataFrame, slot: str = "slot") -> DataFrame:
    """``records`` with the column shard by their slot; no shuffle, the map has SLOTS rows."""
    return records.join(F.broadcast(
        slot_map.select(F.col("slot").alias(slot), "shard")), slot)


def places(records: DataFrame, hash_: str, order: list[str]) -> DataFrame:
    """``records`` (with slot and shard) and ``place``: 0, 1, 2, ... within the shard.

    Places go by slot, then by cell of the slot, then by ``order``; so only the records of a
    cell are sorted together. Rows that are equal in ``order`` get places in any order.
    """
    cell = F.pmod(F.shiftright(F.col(hash_), 20), F.lit(CELLS)).cast("int")
    parted = records.withColumn("_cell", cell)
    counts = parted.groupBy("shard", "slot", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before_cell = Window.partitionBy("shard", "slot").orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, -1)
    before_slot = Window.partitionBy("shard").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1)  # of SLOTS rows in all
    slots = (counts.groupBy("shard", "slot").agg(F.sum("_n").alias("_n"))
             .select("slot", F.coalesce(F.sum("_n").over(before_slot), F.lit(0)).alias("_slots")))
    cells = counts.select("slot", "_cell", F.coalesce(
        F.sum("_n").over(before_cell), F.lit(0)).alias("_cells"))
    offsets = cells.join(F.broadcast(slots), "slot").select(
        "slot", "_cell", (F.col("_slots") + F.col("_cells")).alias("_before"))
    inside = Window.partitionBy("slot", "_cell").orderBy(*order)
    return (parted.withColumn("_nth", F.row_number().over(inside) - 1)
            .join(offsets, ["slot", "_cell"])
            .select(*records.columns, (F.col("_before") + F.col("_nth")).alias("place")))
