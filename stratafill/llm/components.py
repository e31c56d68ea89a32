"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafill.sources.staging import release, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is its least node.

    Each round links every node to the least node near it: first the larger neighbours, then the
    smaller ones. Rounds are logarithmic in the longest path. The hub of a large star is one key
    in the joins, which adaptive execution splits, since the least neighbours are written before
    they are joined; minima are combined before the shuffle. The edges of each round are written
    to the shared folder. Null nodes and loops are left out.
    """
    now = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a != b").distinct(), "edges")
    seen = None
    while True:
        larger, first = _star(
            now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), keep="b > a")
        smaller, second = _star(larger, keep="true")
        after = stage(smaller, "edges")
        release(now, first, second)
        now = after
        # the edges settle when their number and their sum of hashes do
        state = tuple(now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen:
            break
        seen = state
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


def _star(links: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """Link a node a and those of its neighbours b that ``keep`` to the least of them all.

    Also the staged table of least neighbours that the links read.
    """
    least = stage(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    moved = links.join(least, "a").where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a != b").distinct(), least
