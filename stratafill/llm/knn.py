"""Exact top-k inner products by a Voronoi join.

Vectors are whole numbers, floor(256 x). One more coordinate, sqrt(M^2 - |v|^2) for candidates
and 0 for queries, with M the longest candidate, makes the largest inner product the smallest
distance. Pivots, a bounded sample, cut candidates and queries into Voronoi cells. Counts of
candidates per cell and ring of distance give each query cell a radius that surely holds k
candidates; by the triangle inequality only certain rings of each cell can hold anything nearer,
and only their blocks are sent to the query group. Blocks are solved locally with exact
arithmetic, and the best k of all blocks stay.

Cells that hold much are dealt into blocks of a bounded number of vectors, so a vector that
occurs very often is spread too. Tables of pivots, rings and bounds have a size that does not
follow the vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafill.sources.staging import stage

PIVOTS = 64
RINGS = 64
BLOCK = 1024   # candidates of a block, about
GROUP = 1024   # queries of a block, about
RUN = 32768    # candidates that one task solves against a block of queries, about
STEP = 4096    # candidates whose scores are held at once
SCALE = 256.0


def whole_vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """floor(256 x) as float64 rows of ``dim`` numbers; what a shorter vector lacks is 0."""
    column = batch.column("vector")
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((batch.num_rows, dim))
    row = np.repeat(np.arange(batch.num_rows), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = np.floor(flat * SCALE)
    return out


@dataclass
class Space:
    """Pivots with their extra coordinate, and how vectors are stored."""

    dim: int
    longest: float
    kind: str
    pivots: np.ndarray

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0.0)
        return np.column_stack([vectors, np.sqrt(rest)])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        squares = ((points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)
                   - 2 * points @ self.pivots.T)
        cell = squares.argmin(axis=1)
        return cell, np.sqrt(np.maximum(squares[np.arange(len(cell)), cell], 0.0))

    @property
    def ring(self) -> float:
        return max(2.0 * self.longest, 1e-9) / RINGS


def _measure(batches):
    """Of a partition: the largest dimension, component and squared length."""
    for batch in batches:
        dim = max(batch.column("vector").value_lengths().to_pylist(), default=0)
        if batch.num_rows:
            v = whole_vectors(batch, dim)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int64()), pa.array([float(np.abs(v).max(initial=0.0))]),
                 pa.array([float((v**2).sum(axis=1).max())])], names=["dim", "most", "square"])


def _assign(space, every: int):
    """Cell and ring of each vector; of a query, also its cell as a query and its distance."""
    def run(batches):
        own: Space = space.value
        for batch in batches:
            v = whole_vectors(batch, own.dim)
            cell, distance = own.nearest(own.lifted(v))
            ask, away = own.nearest(np.column_stack([v, np.zeros(len(v))]))
            ids = batch.column("id").to_numpy()
            queries = ids % every == 0
            packed = v.astype(own.kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cell.astype(np.int32)),
                 pa.array(np.minimum(distance / own.ring, RINGS + 1).astype(np.int32)),
                 pa.array([int(c) if q else None for c, q in zip(ask, queries, strict=True)],
                          pa.int32()),
                 pa.array(away), pa.array([x.tobytes() for x in packed], pa.binary())],
                names=["id", "cell", "ring", "ask", "away", "vector"])
    return run


ASSIGNED = "id bigint, cell int, ring int, ask int, away double, vector binary"


def bounds(space: Space, rings: list, asking: list, k: int):
    """Per query cell and candidate cell, the rings [low, high] that can hold a neighbour.

    ``rings``: (cell, ring, count); ``asking``: (query cell, largest distance, count).
    """
    slack = 1e-6 * max(space.longest, 1.0)
    width, gaps = space.ring, {}
    out = {}
    by_cell: dict[int, list[tuple[int, int]]] = {}
    for cell, ring, n in rings:
        by_cell.setdefault(cell, []).append((ring, n))
    for ask, reach, _ in asking:
        gaps = np.sqrt(((space.pivots - space.pivots[ask])**2).sum(axis=1))
        # farthest that a ring's candidates can be from a query of the cell
        far = sorted((gaps[c] + (r + 1) * width, n) for c, r, n in rings)
        radius, seen = np.inf, 0
        for distance, n in far:
            seen += n
            if seen >= k + 1:  # one of them may be the query itself
                radius = reach + distance + slack
                break
        for cell, held in by_cell.items():
            low = (gaps[cell] - reach - radius - slack) / width
            high = (gaps[cell] + reach + radius + slack) / width
            some = [r for r, _ in held if r + 1 >= low and r <= high]
            if some:
                out[ask, cell] = (min(some), max(some))
    return out


def groups_of_cells(space: Space, asking: list) -> dict[int, int]:
    """Query cells that lie together, in groups of about GROUP queries."""
    left = {c: n for c, _, n in asking}
    groups: dict[int, int] = {}
    g = 0
    while left:
        seed = min(left)
        gaps = ((space.pivots - space.pivots[seed])**2).sum(axis=1)
        held = 0
        for c in sorted(left, key=lambda c: (gaps[c], c)):
            if held and held + left[c] > GROUP:
                break
            held += left[c]
            groups[c] = g
        for c in [c for c, own in groups.items() if own == g]:
            del left[c]
        g += 1
    return groups


def _pack(table: pa.Table) -> pa.Table:
    """A block of vectors as one row."""
    keys = [c for c in table.column_names if c not in ("id", "vector")]
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    vectors = table.column("vector").to_pylist()
    return pa.table({
        **{c: table.column(c).slice(0, 1) for c in keys},
        "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
        "vectors": pa.array([b"".join(vectors[i] for i in order)], pa.binary())})


def _read(ids: bytes, vectors: bytes, space: Space) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(ids, "<i8"),
            np.frombuffer(vectors, space.kind).reshape(-1, space.dim))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; beyond its range, its end."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    a, b = a.astype(np.float64), b.astype(np.float64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    top = 2**63 - 1
    return np.array([[max(-top - 1, min(top, sum(x * y for x, y in zip(p, q, strict=True))))
                      for q in whole[1]] for p in whole[0]], np.int64)


def _steps(blocks: pa.Table, space: Space):
    """The candidates of some blocks, about STEP at once."""
    ids, vectors, held = [], [], 0
    for block in blocks.select(["ids", "vectors"]).to_pylist():
        i, v = _read(block["ids"], block["vectors"], space)
        ids.append(i)
        vectors.append(v)
        held += len(i)
        if held >= STEP:
            yield np.concatenate(ids), np.concatenate(vectors)
            ids, vectors, held = [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(vectors)


def _solve(space, k: int):
    """The best k of a run of blocks for the queries of a block."""
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        own: Space = space.value
        found = [[], [], []]
        for asked in queries.select(["ids", "vectors"]).to_pylist():
            q_ids, q = _read(asked["ids"], asked["vectors"], own)
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
            for ids, vectors in _steps(blocks, own):
                scores = products(q, vectors)
                for i, me in enumerate(q_ids):
                    row, keep = scores[i], ids != me
                    if len(row) > 4 * k:  # only what reaches the k-th score beside the query's own
                        keep &= row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                    s = np.concatenate([best[i][0], row[keep]])
                    d = np.concatenate([best[i][1], ids[keep]])
                    order = np.lexsort((d, -s))[:k]
                    best[i] = s[order], d[order]
            for me, (s, d) in zip(q_ids, best, strict=True):
                found[0].append(np.full(len(s), me))
                found[1].append(d)
                found[2].append(s)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(
            ("query_id", "vec_id", "score"), flat, strict=True)})
    return run


def top_k(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
    every: int = 50, k: int = 5,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best candidates of each query.

    Queries are the rows whose id ``every`` divides, candidates all rows with another id than the
    query's. Ties go to the smaller vec_id. Rows whose id or vector is null, or whose vector
    holds a null, a NaN or an infinity, take no part. Missing components of shorter vectors
    count as 0. Of several rows with a query's id the least vector asks. Other columns of
    ``vectors`` play no part.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).cast("bigint").alias("id"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    good = good.where("id is not null and vector is not null").where(F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dim, most, square = good.mapInArrow(_measure, "dim bigint, most double, square double").agg(
        F.max("dim"), F.max("most"), F.max("square")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if dim is None:
        return spark.createDataFrame([], schema)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    dim = max(dim, 1)
    drawn = good.orderBy(F.xxhash64("id"), "id", "vector").limit(PIVOTS).toArrow().to_batches()
    pivots = np.concatenate([whole_vectors(b, dim) for b in drawn])
    space = Space(dim, float(np.sqrt(square)), kind, np.zeros((0, dim + 1)))
    space.pivots = np.unique(space.lifted(pivots), axis=0)
    shared = spark.sparkContext.broadcast(space)  # PIVOTS vectors

    assigned = stage(good.mapInArrow(_assign(shared, every), ASSIGNED), "vectors")
    rings = [tuple(r) for r in assigned.groupBy("cell", "ring").agg(
        F.count(F.lit(1))).orderBy("cell", "ring").collect()]  # PIVOTS * RINGS rows at most
    queries = (assigned.where("ask is not null").groupBy("id")
               .agg(F.min(F.struct("vector", "ask", "away")).alias("q")).select("id", "q.*"))
    asking = [tuple(r) for r in queries.groupBy("ask").agg(
        F.max("away"), F.count(F.lit(1))).orderBy("ask").collect()]  # PIVOTS rows at most
    near = bounds(space, rings, asking, k)
    groups = groups_of_cells(space, asking)

    # a block is of one ring of a cell; what a ring holds beyond BLOCK is dealt to more of them
    dealt = spark.createDataFrame(
        [(c, r, -(-n // BLOCK)) for c, r, n in rings], "cell int, ring int, blocks int")
    blocks = assigned.select("id", "cell", "ring", "vector").join(
        F.broadcast(dealt), ["cell", "ring"]).select(  # PIVOTS * RINGS rows at most
        "cell", "ring", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
        "id", "vector")
    packed = blocks.groupBy("cell", "ring", "block").applyInArrow(
        _pack, "cell int, ring int, block int, ids binary, vectors binary")

    # the rings that a group of query cells needs; each run of their blocks is one task's work
    sizes, reach = {}, {}
    for ask, _, n in asking:
        g = groups[ask]
        sizes[g] = sizes.get(g, 0) + n
        for (own, cell), (low, high) in near.items():
            if own == ask:
                a, b = reach.get((g, cell), (low, high))
                reach[g, cell] = min(a, low), max(b, high)
    parts = {g: -(-n // GROUP) for g, n in sizes.items()}
    needed = [(c, r, g, n) for c, r, n in rings for g in sizes
              if (g, c) in reach and reach[g, c][0] <= r <= reach[g, c][1]]
    runs = {g: 0 for g in sizes}
    for _, _, g, n in needed:
        runs[g] += n
    runs = {g: max(1, -(-n // RUN)) for g, n in runs.items()}
    send = spark.createDataFrame([(c, r, g, parts[g], runs[g]) for c, r, g, _ in needed],
                                 "cell int, ring int, grp int, parts int, runs int")
    copies = packed.join(F.broadcast(send), ["cell", "ring"]).select(  # PIVOTS^2 * RINGS at most
        "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("cell", "ring", "block"), F.col("runs")).cast("int").alias("run"),
        "ids", "vectors")
    cells = spark.createDataFrame(
        [(c, g, parts[g], runs[g]) for c, g in groups.items()],
        "ask int, grp int, parts int, runs int")
    asked = queries.join(F.broadcast(cells), "ask").select(  # PIVOTS rows at most
        "grp", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "runs",
        "id", "vector")
    asked = asked.groupBy("grp", "part", "runs").applyInArrow(
        _pack, "grp int, part int, runs int, ids binary, vectors binary")
    asked = asked.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    solved = copies.groupBy("grp", "part", "run").cogroup(
        asked.groupBy("grp", "part", "run")).applyInArrow(
        _solve(shared, k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
