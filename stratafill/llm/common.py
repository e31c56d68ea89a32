"""Helpers that several operators share."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def document_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """What names a document: its id and a hash of its text.

    Ids may be null or repeat. Rows that agree in both are the same document and share results.
    """
    return {"_id": F.col(id_col).cast("bigint"),
            "_th": F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col).cast("string")))}


KEY = ["_id", "_th"]


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality of columns in which null equals null."""
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand Python at most so many rows at once; texts and vectors are wide."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def share_drawn(order: Column, most: int, n: int) -> Column:
    """Draw about ``most`` of ``n`` different rows by a 64-bit hash (a long); all, if most >= n.

    The whole hash is compared, its low 20 bits before the others, so the share is right at any
    size, and the rows that are drawn are in no special place of an order by the hash.
    """
    if most >= n:
        return F.lit(True)
    low_first = F.shiftleft(order, 44).bitwiseOR(F.shiftrightunsigned(order, 20))
    return low_first.bitwiseXOR(F.lit(-(1 << 63))) < F.lit((most << 64) // n - (1 << 63))


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns of these names (in any case) renamed, and how to name them back."""
    used = {c.lower() for c in [*docs.columns, *names]}
    back, wanted = {}, {n.lower() for n in names}
    for c in docs.columns:
        if c.lower() in wanted:
            free = next(x for x in (f"_kept_{i}" for i in range(len(used) + 1)) if x not in used)
            used.add(free)
            back[free] = c
    return docs.withColumnsRenamed({v: k for k, v in back.items()}), back
