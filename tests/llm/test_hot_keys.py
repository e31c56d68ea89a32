"""Joins of a key that holds most rows are split."""

from pyspark.sql import functions as F

from stratafill.llm import components
from stratafill.llm.archive import archive_records, read_archives
from stratafill.llm.minhash import similar_pairs
from stratafill.sources import stage
from tests.test_joins import final_plan, small_parts  # noqa: F401


def test_a_hub_is_split(spark, small_parts):  # noqa: F811
    links = stage(spark.range(1, 60_001, numPartitions=8).select(
        F.when(F.col("id") % 4 < 3, 0).otherwise(F.col("id")).alias("a"),
        (F.col("id") + 100_000).alias("b")), "links")
    moved, least = components._star(links, "b > a")
    assert "skew=true" in final_plan(moved)
    assert least.count() == 15_001
    found = components.connected_components(links).where("component = 0").count()
    assert found == 45_001


def test_a_frequent_body_is_split(spark, small_parts):  # noqa: F811
    pages = spark.range(40_000, numPartitions=8).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"),
        F.when(F.col("id") % 3 < 2, F.lit("x" * 200)).otherwise(
            F.concat(F.col("id").cast("string"), F.lit("y" * 200))).alias("html"))
    found = archive_records(stage(pages, "pages"))
    assert "skew=true" in final_plan(found.select("record_id", "record_type", "refers_to"))
    assert found.where("record_type = 'revisit'").count() == 26_667 - 1


def test_pairs_of_one_class_are_compared(spark):
    texts = [(i, f"one two three four five six seven eight nine {'ten' if i else 'other'}") for i in range(300)]
    docs = spark.createDataFrame(texts, "_id bigint, text string").withColumn("_th", F.xxhash64("text"))
    classes = docs.select(F.col("_id").alias("cid"), "_id", "_th")
    pairs = stage(spark.range(1, 300).select(F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b")), "p")
    found = similar_pairs(pairs, classes, docs, 0.7, 5)
    assert found.count() == 299 and {round(r.similarity, 4) for r in found.collect()} == {round(5 / 7, 4)}


def test_archives_are_read_by_type_in_the_source(spark, tmp_path):
    pages = spark.createDataFrame(
        [(i, "u", ("a" * 150) if i % 2 else f"{i}" * 120) for i in range(40)] + [(99, None, "z" * 3_000_000)],
        "page_id bigint, url string, html string")
    from stratafill.llm.archive import write_archives
    path = "file://" + str(tmp_path / "warc")
    write_archives(pages, path)
    both = {}
    for kind, columns in (("response", ["record_id", "record_type", "payload"]),
                          ("revisit", ["record_id", "record_type", "payload_bytes"])):
        df = read_archives(spark, path, columns).where(F.col("record_type") == kind)
        both[kind] = df.collect()
        # the source took the filter, so Spark has none left
        assert "Filter (record_type" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.record_type for r in both[kind]} == {kind}
    assert len(both["response"]) == 22 and len(both["revisit"]) == 19
    assert max(len(r.payload) for r in both["response"]) == 3_000_000
