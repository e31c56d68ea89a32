"""Joins for keys that hold much of a table, and joins on a range of dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafill.sources.staging import stage


def join_reduced(
    rows: DataFrame, reduced: DataFrame, on: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join ``rows`` with a table that has few rows of a key, most often one.

    Adaptive execution splits the rows of a hot key only if both inputs of the join are shuffles
    of their own. What an aggregate, a distinct or a join on the same key returns is not shuffled
    again, so it is written first. It is not broadcast, however small its file: it may have a row
    per patient, and rows take far more room in the driver than in a file. ``how`` may be inner,
    left, left_semi or left_anti.
    """
    return rows.join(stage(reduced, "reduced").hint("merge"), on, how)


def date_bin(c: Column, days: int) -> Column:
    """The number of the stretch of ``days`` days that a date or timestamp is in."""
    return F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / days)


def join_within(
    points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, start: str, end: str,
    days: int,
) -> DataFrame:
    """Inner join on equal ``on`` with ``start <= at <= end``; names of both sides must differ.

    Dates are binned by ``days``, so the join stays one on equal columns, and the rows of a hot
    key are spread by date too. A span is repeated once per bin that it touches: take about its
    usual length as ``days``. A null date or key, or a span that ends before it starts, matches
    nothing.
    """
    touched = F.sequence(date_bin(F.col(start), days), date_bin(F.col(end), days))
    binned = spans.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(touched))
    return (
        points.withColumn("_bin", date_bin(F.col(at), days)).join(binned, [*on, "_bin"])
        .where(F.col(at).between(F.col(start), F.col(end))).drop("_bin"))
