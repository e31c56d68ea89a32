"""Exact quantiles per group, without bringing a group's values into one task.

Values are counted first. Groups are then searched in two steps: the counts per coarse bin
locate the bins that hold the wanted ranks, and only the values of those bins are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_DOUBLING = 64
_LEAST = 1100  # no double's exponent is below -1100


def _bin(value: Column) -> Column:
    """Coarse order-preserving bin: 64 per doubling of the magnitude, infinities and NaN apart.

    All doubles have some 270,000 bins between them, however near to 0 they are.
    """
    v = value.cast("double")
    size = F.floor((F.log2(F.abs(v)) + _LEAST) * BINS_PER_DOUBLING).cast("int") + 1
    top = 4 * _LEAST * BINS_PER_DOUBLING
    return (F.when(F.isnan(v), F.lit(top + 1)).when(v == float("inf"), F.lit(top))
            .when(v == float("-inf"), F.lit(-top)).when(v == 0, F.lit(0))
            .when(v > 0, size).otherwise(-size))


def _values_at(
    df: DataFrame, by: Sequence[str], value: str, low: Column, high: Column
) -> DataFrame:
    """Per group: size ``_n`` and the values ``_low``/``_high`` at two 0-based ranks.

    ``low`` and ``high`` are expressions over the group size ``_n``; they differ by at most 1.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_count")).withColumn("_bin", _bin(F.col(value))))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {f"_of_{c}": c for c in (*by, "_bin")}
    bins = (
        counts.groupBy(*by, "_bin").agg(F.sum("_count").alias("_in_bin"))
        .withColumns({"_upto": F.sum("_in_bin").over(upto), "_n": F.sum("_in_bin").over(group)})
        .withColumns({"_before": F.col("_upto") - F.col("_in_bin"),
                      "_low_rank": low, "_high_rank": high})
        .where((F.col("_before") <= F.col("_high_rank")) & (F.col("_upto") > F.col("_low_rank")))
        .select(*[F.col(c).alias(o) for o, c in own.items()],
                "_before", "_n", "_low_rank", "_high_rank")
    )
    # null-safe: a NULL group counts, and both sides keep sharing the shuffle of the counts;
    # those grow with the values, so they are never sent through the driver
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(o)) for o, c in own.items()])
    inside = (
        Window.partitionBy(*by, "_bin").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.hint("merge").join(bins, same).withColumn(
        "_reached", F.col("_before") + F.sum("_count").over(inside))
    return ranked.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        F.min(F.when(F.col("_reached") > F.col("_low_rank"), F.col(value))).alias("_low"),
        F.min(F.when(F.col("_reached") > F.col("_high_rank"), F.col(value))).alias("_high"))


def quantile_cont(
    df: DataFrame, by: Sequence[str], value: str, p: float | str, out: str, size: str
) -> DataFrame:
    """Per group: the interpolated ``p`` quantile, not rounded, and the number of values.

    The rank (n - 1) p is taken exactly, ``p`` being the decimal that it is written as.
    """
    share = Fraction(str(p))
    spot = (F.col("_n") - 1) * share.numerator
    part = F.pmod(spot, F.lit(share.denominator))
    whole = F.call_function("div", spot, F.lit(share.denominator))
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    return _values_at(
        df, by, value, whole, whole + F.when(part > 0, 1).otherwise(0)).select(
        *by,
        F.col("_n").alias(size),
        F.when((part == 0) | (low == high), low)
        .otherwise(low + (high - low) * (part / share.denominator)).alias(out))


def upper_median(df: DataFrame, by: Sequence[str], value: str, out: str = "cut") -> DataFrame:
    """Per group: the least value of the top half (half rounded up)."""
    middle = F.floor(F.col("_n") / 2)
    return _values_at(df, by, value, middle, middle).select(*by, F.col("_low").alias(out))


def quantile_sketch(
    df: DataFrame, by: Sequence[str], value: str, p: float, out: str, size: str,
    accuracy: int = 10_000,
) -> DataFrame:
    """Per group: a value whose rank is within n / ``accuracy`` of the ``p`` quantile's, and n.

    One pass and one shuffle of sketches, which hold some ``accuracy`` numbers a group at most and
    are merged; for many values where an exact rank is not asked for. Not interpolated. Null
    values count nowhere.
    """
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias(size),
        F.percentile_approx(F.col(value).cast("double"), p, accuracy).alias(out))
