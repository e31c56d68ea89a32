"""Date expressions. Year tests are half-open ranges, so they reach the Parquet scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text styles by number.
STYLES = {101: "MM/dd/yyyy", 102: "yyyy.MM.dd"}


def _jan1(year: int) -> Column:
    return F.lit(dt.date(year, 1, 1))


def after_year(c: Column, year: int) -> Column:
    """``year(c) > year``."""
    return c >= _jan1(year + 1)


def years_between(c: Column, first: int, last: int) -> Column:
    """``year(c) between first and last``."""
    return (c >= _jan1(first)) & (c < _jan1(last + 1))


def fmt_date(c: Column, style: int) -> Column:
    return F.date_format(c, STYLES[style])


def unpadded_date(c: Column, sentinel: str) -> Column:
    """``y-m-d`` without leading zeros; the sentinel stands for NULL."""
    return F.when(c.isNull(), F.lit(sentinel)).otherwise(
        F.concat_ws("-", F.year(c), F.month(c), F.dayofmonth(c)))


def days_between(start: Column, end: Column) -> Column:
    """Number of date boundaries crossed from ``start`` to ``end``."""
    return F.datediff(end, start).cast("bigint")


def age_years(born: Column, as_of: str) -> Column:
    """Whole years of 365.25 days on the day ``as_of``."""
    days = F.datediff(F.lit(dt.date.fromisoformat(as_of)), born)
    return F.floor(days / F.lit(365.25)).cast("bigint")


def date_parts(c: Column) -> list[Column]:
    return [
        F.year(c).cast("bigint").alias("y"),
        F.month(c).cast("bigint").alias("m"),
        F.dayofmonth(c).cast("bigint").alias("d"),
    ]
