"""Staged intermediates."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_watching: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master uses a folder in its warehouse; any other master refuses.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate result that later steps read more than once, and read it back.

    The files replace the lineage: a lost executor costs a re-read, and each reader prunes
    columns and pushes its filters into the scan. ``partition_by`` are columns with few values
    that readers prune by. ``release`` removes the files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    # whatever is not released goes when the driver ends
    remove_at_exit(spark, path)
    for held in _watching:
        held.append(staged)
    return staged


def stage_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``stage``, with the rows and the aggregates ``counts``, taken in the pass that writes."""
    seen = Observation()
    staged = stage(df.observe(
        seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]), name)
    return staged, {"rows": 0, **seen.get}


@contextlib.contextmanager
def staged_since() -> Iterator[list[DataFrame]]:
    """A list that gets every table staged inside the block."""
    held: list[DataFrame] = []
    _watching.append(held)
    try:
        yield held
    finally:
        _watching[:] = [x for x in _watching if x is not held]


def release(*staged: DataFrame) -> None:
    """Remove the files of staged tables; nothing that is still to run may read them."""
    for df in staged:
        remove(df.sparkSession, df.staged_path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    It does so once the driver's JVM has collected the plans that made them, which may be long
    after; between two large steps that is disk for nothing.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path that ``new_path`` gave, by Spark's own file system layer."""
    _file_system(spark, path).delete(_path(spark, path), True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a path that has been written when the driver ends."""
    _file_system(spark, path).deleteOnExit(_path(spark, path))


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)
