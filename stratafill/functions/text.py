"""Text expressions. Concatenation treats NULL as the empty string throughout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(*parts: Column | str) -> Column:
    """Concatenation in which a NULL part vanishes; plain strings are literals."""
    return F.concat_ws(
        "", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def tenant_key(context: Column, local_id: Column, sep: str = " - ") -> Column:
    """Key of an entity that is unique only inside its tenant."""
    return joined(context, sep, local_id)


def label_join(parts: Sequence[Column], sep: str) -> Column:
    """Display label; the separator stays where a part is NULL."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def normalize_name(c: Column) -> Column:
    """Upper case without spaces and hyphens."""
    return F.upper(F.trim(F.translate(c, " -", "")))


def match_key(first: Column, last: Column, born: Column) -> Column:
    return joined(first, "|", last, "|", born)


def zip5(c: Column, default: str = "99999") -> Column:
    """First five characters; the default replaces NULL but not the empty string."""
    return F.coalesce(F.substring(c, 1, 5), F.lit(default))


def presence_flag(c: Column, yes: str, no: str) -> Column:
    return F.when(c.isNull(), F.lit(no)).otherwise(F.lit(yes))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*cols)


def default_null(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULL by a default of the column's own type."""
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType))
        for name, value in defaults.items()
    })


def fill_tiebreaker(date: Column, ndc: Column, quantity: Column) -> Column:
    """Sort key ``yyyy.MM.dd`` + ndc + quantity, compared as text."""
    return joined(F.date_format(date, "yyyy.MM.dd"), ndc, quantity)
