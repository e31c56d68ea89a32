"""Age bands, count buckets and the stratum label built from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lowest age, highest age, label; every other age (and NULL) is AGE_ELSE.
AGE_BANDS = (
    (None, 17, "age <18"),
    (18, 29, "age 18 to 29"),
    (30, 39, "age 30 to 39"),
    (40, 49, "age 40 to 49"),
    (50, 59, "age 50 to 59"),
    (60, 69, "age 60 to 69"),
    (70, 75, "age 70 to 79"),
    (76, 80, "age 80 to 85"),
)
AGE_ELSE = "age >85"
STRATUM_SEP = " | "


def age_band(age: Column, bands: Sequence[tuple] = AGE_BANDS, other: str = AGE_ELSE) -> Column:
    chain = F
    for low, high, label in bands:
        chain = chain.when(age <= high if low is None else age.between(low, high), F.lit(label))
    return chain.otherwise(F.lit(other))


def median_bucket(c: Column, cut, name: str) -> Column:
    """``0 name`` / ``med name`` / ``>med name`` by the median ``cut`` of the positive values."""
    return (
        F.when(c.isNull() | (c == 0), F.lit(f"0 {name}"))
        .when(c <= cut, F.lit(f"med {name}"))
        .otherwise(F.lit(f">med {name}"))
    )


def chronic_bucket(counts: Sequence[Column]) -> Column:
    """Number of disease visits; NULL when any count is NULL."""
    total = reduce(add, counts)
    return (
        F.when(total == 0, F.lit("no disease"))
        .when(total == 1, F.lit("1 chronic"))
        .when(total > 1, F.lit("2+ chronics"))
    )


def surgery_bucket(c: Column) -> Column:
    return F.when(c.isNull() | (c == 0), F.lit("No Surgery")).otherwise(F.lit("Surgery"))


def uniqueness_label(all_count: Column, distinct_count: Column) -> Column:
    return (
        F.when(all_count == 0, F.lit("unlabeled surgery"))
        .when(all_count > distinct_count, F.lit("same proc >1"))
        .otherwise(F.lit("unique"))
    )


def micro_stratum(parts: Sequence[Column]) -> Column:
    """The parts in order; a NULL part leaves its place empty."""
    return F.concat_ws(STRATUM_SEP, *[F.coalesce(p, F.lit("")) for p in parts])


def met_flag(value: Column, cut: Column) -> Column:
    """1 where the value reaches the cut, else 0 (also for NULL)."""
    return F.when(value >= cut, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
