"""Running totals along an order inside each key, however many rows a key has.

All rows are range-partitioned by (key, order). Each block is scanned on its own, a window per
(key, block), so no task holds more than a block of any key. Only a key that crosses the edge of
a block needs the totals of the blocks before it: at most one key per edge, so the table of
those totals has no more rows than there are blocks.

Doubles are summed as decimals with 12 places, so the sums do not depend on the partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafill.sources.staging import stage

_BLOCK = "_block"
_DECIMAL = "decimal(27,12)"  # its sums have room for one more digit


def ordered_scan(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    *,
    number: str | None = None,
    sums: Mapping[str, str] | None = None,
    nexts: Mapping[str, str] | None = None,
    firsts: Mapping[str, str] | None = None,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Scan the rows of each key in ``order`` and append columns.

    ``number`` is the row number; ``sums`` maps an output to the column it accumulates,
    ``nexts`` to the column read from the following row, ``firsts`` to the column read from the
    first row of the key. A null key is a key like any other. ``per_key`` is inner-joined on the
    key afterwards, by a shuffle. The blocks are written to the shared folder when this is called.
    """
    spec = _Spec(rows, key, order, number, dict(sums or {}), dict(nexts or {}), dict(firsts or {}))
    scanned = spec.scan()
    return scanned if per_key is None else scanned.join(per_key.hint("merge"), key)


class _Spec:
    def __init__(self, rows, key, order, number, sums, nexts, firsts):
        self.rows, self.key, self.order = rows, key, [F.col(c) for c in order]
        self.number, self.sums, self.nexts, self.firsts = number, sums, nexts, firsts
        kinds = {f.name: f.dataType for f in rows.schema}
        self.doubles = {n for n, c in sums.items()
                        if isinstance(kinds[c], (T.DoubleType, T.FloatType))}

    def _parts(self, name: str, total) -> dict[str, Column]:
        """The partial sums behind an output; ``total`` sums a column."""
        value = F.col(self.sums[name])
        if name not in self.doubles:
            return {f"_sum_{name}": total(value)}
        # NaN, infinities and what no decimal holds are summed as doubles
        exact = value.cast("double").try_cast(_DECIMAL)
        return {f"_sum_{name}": total(exact),
                f"_odd_{name}": total(F.when(exact.isNull(), value.cast("double")))}

    def _sum_columns(self, total) -> dict[str, Column]:
        return {k: v for n in self.sums for k, v in self._parts(n, total).items()}

    def scan(self) -> DataFrame:
        key, keys = self.key, [self.key, _BLOCK]
        # written, so that every reader below sees the same block of a row
        blocks = stage(
            self.rows.repartitionByRange(F.col(key), *self.order)
            .withColumn(_BLOCK, F.spark_partition_id()), "blocks")
        along = Window.partitionBy(*keys).orderBy(*self.order)
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = blocks.withColumns({
            "_row": F.row_number().over(along).cast("bigint"),
            "_last": F.lead(F.lit(1)).over(along).isNull(),
            **self._sum_columns(lambda c: F.sum(c).over(upto)),
            **{f"_next_{n}": F.lead(c).over(along) for n, c in self.nexts.items()},
            **{f"_first_{n}": F.first(c).over(upto) for n, c in self.firsts.items()}})
        # at most two keys per block
        both = local.join(
            F.broadcast(self._offsets(blocks)),
            F.col(key).eqNullSafe(F.col("_key")) & (F.col(_BLOCK) == F.col("_of")), "left")
        out = {}
        if self.number:
            out[self.number] = F.col("_row") + F.coalesce("_rows_before", F.lit(0))
        for name in self.sums:
            total = self._added(local, f"_sum_{name}")
            if name in self.doubles:
                odd = self._added(local, f"_odd_{name}")
                exact = total.cast("double")
                total = F.when(odd.isNull(), exact).otherwise(
                    odd + F.coalesce(exact, F.lit(0.0)))
            out[name] = total
        for name in self.nexts:
            out[name] = F.when(F.col("_last"), F.col(f"_next_{name}_after")).otherwise(
                F.col(f"_next_{name}"))
        for name in self.firsts:
            out[name] = F.when(F.col("_crosses"), F.col(f"_first_{name}_before")).otherwise(
                F.col(f"_first_{name}"))
        return both.select(*[F.col(c) for c in self.rows.columns if c not in out],
                           *[c.alias(n) for n, c in out.items()])

    @staticmethod
    def _added(local: DataFrame, name: str) -> Column:
        """A sum inside the block plus that of the blocks before, in the type of the first."""
        kind = local.schema[name].dataType
        here, before = F.col(name), F.col(f"{name}_before").cast(kind)
        both = before + F.coalesce(here, F.lit(0).cast(kind))
        return F.when(before.isNull(), here).otherwise(both.cast(kind))

    def _offsets(self, blocks: DataFrame) -> DataFrame:
        """For the first and the last key of each block: totals before it, and what follows."""
        key, keys = self.key, [self.key, _BLOCK]
        one = F.struct(F.col(key).alias("k"))
        edges = blocks.groupBy(_BLOCK).agg(F.min(one).alias("lo"), F.max(one).alias("hi")).select(
            F.col(_BLOCK).alias("_of"), F.explode(F.array("lo", "hi")).alias("edge"))
        edges = edges.select("_of", F.col("edge.k").alias("_key")).distinct()
        # as many rows as blocks have edges
        at_edge = blocks.join(
            F.broadcast(edges),
            F.col(key).eqNullSafe(F.col("_key")) & (F.col(_BLOCK) == F.col("_of")), "left_semi")
        heads = {f"_head_{c}": c for c in {*self.nexts.values(), *self.firsts.values()}}
        summary = at_edge.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_rows"),
            *[c.alias(n) for n, c in self._sum_columns(F.sum).items()],
            *[F.min_by(F.struct(F.col(c).alias("v")), F.struct(*self.order)).alias(h)
              for h, c in heads.items()])
        by_block = Window.partitionBy(key).orderBy(_BLOCK)
        before = by_block.rowsBetween(Window.unboundedPreceding, -1)
        return summary.select(
            F.col(key).alias("_key"), F.col(_BLOCK).alias("_of"),
            F.sum("_rows").over(before).alias("_rows_before"),
            F.lag(F.lit(1)).over(by_block).isNotNull().alias("_crosses"),
            *[F.sum(n).over(before).alias(f"{n}_before") for n in self._sum_columns(F.sum)],
            *[F.lead(f"_head_{c}").over(by_block)["v"].alias(f"_next_{n}_after")
              for n, c in self.nexts.items()],
            *[F.first(f"_head_{c}").over(by_block)["v"].alias(f"_first_{n}_before")
              for n, c in self.firsts.items()])
