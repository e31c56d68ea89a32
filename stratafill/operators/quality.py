"""Checks run after each step: sizes, deltas, duplicates, frequencies, traces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafill.functions.predicates import contains_any
from stratafill.operators.joins import join_reduced


def profile(df: DataFrame, key: str, extra: Mapping[str, str] | None = None) -> DataFrame:
    """One row: rows, distinct entities, the excess; ``extra`` maps outputs to columns whose
    distinct values are counted too."""
    return df.agg(
        F.count(F.lit(1)).alias("freq"),
        F.count_distinct(key).alias("distinct_mems"),
        (F.count(F.lit(1)) - F.count_distinct(key)).alias("error_num"),
        *[F.count_distinct(c).alias(out) for out, c in (extra or {}).items()])


def reconcile(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """One row: rows and distinct entities of two tables, and the differences."""
    tagged = new.select(F.col(key), F.lit("new").alias("side")).unionByName(
        old.select(F.col(key), F.lit("old").alias("side")))
    per_side = tagged.groupBy("side").agg(
        F.count(F.lit(1)).alias("ct"), F.count_distinct(key).alias("mems"))

    def of(side: str, c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(0))

    return per_side.agg(
        of("new", "ct").alias("new_ct"), of("old", "ct").alias("old_ct"),
        of("new", "mems").alias("new_mems"), of("old", "mems").alias("old_mems"),
    ).select(
        "new_ct", "old_ct", (F.col("new_ct") - F.col("old_ct")).alias("ct_delta"),
        "new_mems", "old_mems", (F.col("new_mems") - F.col("old_mems")).alias("mem_delta"))


def ratio(a: Column, b: Column) -> Column:
    """Whole-number quotient of two whole numbers, cut towards zero; NULL for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, b)).cast("bigint")


def reconcile_ratio(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """:func:`reconcile`, and the rows per entity on both sides."""
    return reconcile(new, old, key).withColumns({
        "new_ratio": ratio(F.col("new_ct"), F.col("new_mems")),
        "old_ratio": ratio(F.col("old_ct"), F.col("old_mems"))})


def freq(df: DataFrame, *cols: str) -> DataFrame:
    """Rows per value, most frequent first; NULL is a value."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"))


def entities_per_group(df: DataFrame, group: str, key: str, out: str = "mem_count") -> DataFrame:
    """Distinct entities per group, largest first."""
    return df.groupBy(group).agg(F.count_distinct(key).alias(out)).orderBy(F.desc(out))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") > 1)


def rows_of_duplicates(df: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """All rows of the entities that own a repeated key combination."""
    return join_reduced(df, duplicates(df, keys).select(entity).distinct(), entity, "left_semi")


def multi_encounter_days(
    df: DataFrame, key: str = "unique_patient", date: str = "EncounterDate",
    encounter: str = "ClinicalEncounterID",
) -> DataFrame:
    """All rows of the entities with several encounters on one day."""
    days = duplicates(df.select(key, date, encounter).distinct(), [key, date])
    return join_reduced(df, days.select(key).distinct(), key, "left_semi")


def trace(df: DataFrame, key: str, value, *order: str) -> DataFrame:
    """One entity's rows, ordered for display."""
    return df.where(F.col(key) == value).orderBy(*order)


def top_n(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def lookup_contains(df: DataFrame, words: Mapping[str, Sequence[str]], *cols: str) -> DataFrame:
    """Distinct ``cols`` of the rows in which a column contains one of its words."""
    return df.where(contains_any(words)).select(*cols).distinct()
