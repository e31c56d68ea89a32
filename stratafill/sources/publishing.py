"""Published tables: their layout, replacing a part of one, and versions that are checked first."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextlib.contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    held = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def publish(
    df: DataFrame, table: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None,
    bucket_by: Sequence[str] = (), buckets: int = 0,
) -> DataFrame:
    """Replace the catalog table ``table`` by ``df`` and return the table.

    With ``buckets`` the rows are dealt to so many buckets by ``bucket_by`` and sorted by it in
    each. Later steps that group or join by these columns then read the table without a shuffle.
    All rows of a key are read by one task in such steps, so bucket by keys of bounded size.
    """
    if buckets:
        # one task per bucket writes, so a bucket is one file and not one per task
        df = df.repartition(buckets, *bucket_by)
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(table)
    return df.sparkSession.read.table(table)


def replace_partitions(
    df: DataFrame, table: str, partition_by: Sequence[str], values: Sequence | None = None
) -> DataFrame:
    """Replace the partitions of ``table`` that ``df`` has rows for; others keep their files.

    ``values`` are the values of the first partition column that ``df`` stands for, such as the
    tenants of a rerun: rows of others are refused, and one without any row loses its partitions.
    ``df`` must not read ``table``. A table that does not exist is made.
    """
    spark, first = df.sparkSession, partition_by[0]
    if values is not None:
        listed = F.col(first).isin(*values)
        if not df.where(~F.coalesce(listed, F.lit(False))).isEmpty():
            raise ValueError(f"rows whose {first} is not one of {list(values)}")
    if not spark.catalog.tableExists(table):
        return publish(df, table, partition_by=partition_by)
    columns = spark.read.table(table).columns
    with settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        df.select(*columns).write.mode("overwrite").insertInto(table)
    if values is not None:
        # at most a row per value
        found = {r[0] for r in df.select(F.col(first)).distinct().collect()}
        for value in sorted(set(values) - found, key=str):
            literal = str(value).replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({first} = '{literal}')")
    return spark.read.table(table)


def has_rows(rows: int) -> Callable[[DataFrame], None]:
    """A check that a written table has so many rows; it reads the footers of the files only."""
    def check(written: DataFrame) -> None:
        found = written.count()
        if found != rows:
            raise ValueError(f"{found} rows were written, not {rows}")
    return check


def publish_version(
    df: DataFrame, name: str, checks: Sequence[Callable[[DataFrame], None]] = (), keep: int = 1,
    **layout,
) -> DataFrame:
    """Write ``df`` as a new version beside the old one, check it, then let ``name`` mean it.

    ``name`` is a view over the version, so readers see the old table until the checks have
    passed and the new one from then on. A check that raises leaves ``name`` as it was and the
    new version is dropped. ``keep`` older versions stay, for readers that began before.
    ``layout`` goes to :func:`publish`.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        raise ValueError(f"{name} is a table, not a view over versions")
    before = versions(spark, name)
    version = f"{name}__v{time.time_ns():020d}"
    try:
        written = publish(df, version, "error", **layout)
        for check in checks:
            check(written)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for old in before[:len(before) - keep] if keep else before:
        spark.sql(f"DROP TABLE IF EXISTS {old}")
    return spark.read.table(name)


def versions(spark: SparkSession, name: str) -> list[str]:
    """The versions of ``name``, oldest first, with its database."""
    database, _, own = name.rpartition(".")
    listed = spark.sql(f"SHOW TABLES {f'IN {database} ' if database else ''}LIKE '{own}__v*'")
    return sorted(f"{database}.{r.tableName}" if database else r.tableName
                  for r in listed.collect())
