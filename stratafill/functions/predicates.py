"""Row predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_list(c: Column, values: Sequence, collation: str | None = None) -> Column:
    """``c IN (values)``; ``collation`` (e.g. ``UTF8_LCASE``) sets how text compares."""
    return (F.collate(c, collation) if collation else c).isin(*values)


def exclude_pair(
    a: Column, a_values: Sequence, b: Column, b_values: Sequence, collation: str | None = None
) -> Column:
    """Drop rows where both ``a`` and ``b`` are listed; an undecided (NULL) test drops too."""
    return ~in_list(a, a_values, collation) | ~in_list(b, b_values, collation)


def contains_any(words: Mapping[str, Sequence[str]]) -> Column:
    """True where any column contains any of its words, ignoring case."""
    tests = [F.upper(F.col(c)).contains(w.upper()) for c, ws in words.items() for w in ws]
    return reduce(or_, tests)


def column_in_columns(c: Column, others: Sequence[Column]) -> Column:
    """``c IN (column, column, ...)``."""
    return reduce(or_, [c == o for o in others])
