"""Pages to web archives without repeating equal payloads, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafill.llm.warc import SCHEMA, WarcDataSource
from stratafill.sources.staging import stage

LEAST_BYTES = 100


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_records(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    least_bytes: int = LEAST_BYTES,
) -> DataFrame:
    """A WARC record per page (the schema of the ``warc`` source).

    Of pages with equal bodies of ``least_bytes`` or more, the one with the smallest id is a
    response and the others revisit it; smaller ones are all responses. Length and digest are
    those of the full body, also where a revisit leaves it out. A null body is empty, a null url
    is left out. A page without an id is a response; so is every row that repeats the smallest
    id. Other columns play no part.

    Only ids and digests are compared. A frequent body is one key there, which adaptive
    execution splits, since the least ids are written before they are joined; the pages
    themselves are then joined by id and digest.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("target_uri"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"),
                             "payload_digest": F.sha2("payload", 256)})
    keys = rows.where((F.col("payload_bytes") >= least_bytes) & F.col("id").isNotNull()).select(
        "id", "payload_digest").distinct()
    first = stage(keys.groupBy("payload_digest").agg(
        F.min("id").alias("first"), F.max("id").alias("last")).where("first != last"), "first_pages")
    later = keys.join(first, "payload_digest").where("id != first").select(
        "id", "payload_digest", "first")
    joined = rows.join(later, ["id", "payload_digest"], "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("first").isNotNull()
    return joined.select(
        F.coalesce(urn(F.col("id")), F.lit("<urn:page:>")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", "payload_bytes",
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    spark = pages.sparkSession
    register(spark)
    archive_records(pages, **columns).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of a folder of archives; without ``payload`` no payload is decoded."""
    register(spark)
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("warc").schema(schema).load(path)


def page_of(urn: str) -> Column:
    """The page id of a record id."""
    return F.regexp_extract(F.col(urn), r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
