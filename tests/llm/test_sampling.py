"""Learning from a sample gives what learning from all rows gives."""

import pytest
from pyspark.sql import functions as F

from stratafill.llm import langid, toxicity
from stratafill.llm.common import share_drawn

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").dropna()
    return docs.select("doc_id", "text").join(labels, "doc_id").cache()


def judged(labelled, rows):
    docs = labelled.where(langid.held_out())
    found = toxicity.severity(docs, toxicity.train(rows.select("text", "toxic"))).collect()
    return {r._id: r for r in found}


def test_toxicity_of_a_sample_and_of_repeated_rows(labelled, monkeypatch):
    rows = labelled.where(~langid.held_out())
    toxic = rows.where("toxic = 1").select("text").distinct().count()
    want = judged(labelled, rows)
    flagged = sum(r.toxic for r in want.values())
    mean = sum(r.toxic_score for r in want.values()) / len(want)
    # as many of either class are drawn, though there are eight times as many clean ones
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", toxic)
    got = judged(labelled, rows)
    assert abs(sum(r.toxic_score for r in got.values()) / len(got) - mean) < 0.4 * mean
    assert sum(r.toxic != want[i].toxic for i, r in got.items()) <= 0.05 * len(want)
    assert 0.7 * flagged <= sum(r.toxic for r in got.values()) <= 1.3 * flagged
    # the same rows thirty times over are the same table
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 3000)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30))))
    got = judged(labelled, many)
    assert {i: r.toxic for i, r in got.items()} == {i: r.toxic for i, r in want.items()}
    assert all(abs(r.toxic_score - want[i].toxic_score) < 1e-6 for i, r in got.items())


def test_the_whole_hash_draws(spark):
    """One row in 10,000, and in a billion, where 20 bits of a hash draw ten times too many."""
    rows = spark.range(2_000_000).select(F.xxhash64("id").alias("h"))
    drawn = rows.where(share_drawn(F.col("h"), 3000, 30_000_000)).count()
    assert 140 <= drawn <= 262
    assert rows.where(share_drawn(F.col("h"), 6000, 50_000_000_000)).count() <= 5
    assert rows.where(share_drawn(F.col("h"), 7, 7)).count() == 2_000_000
    assert rows.where(share_drawn(F.col("h"), 1, 2)).count() - 1_000_000 < 5000


def test_languages_beyond_the_bound_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = spark.createDataFrame(
        [(f"{w} {i}", x) for x, w, n in (("aa", "abba", 30), ("bb", "obbo", 20), ("cc", "icci", 20))
         for i in range(n)] + [(f"dirty {i}", f"x{i}") for i in range(50)], "text string, lang string")
    assert langid.train(rows).languages == ["aa", "bb"]


def test_languages_of_a_sample_are_as_frequent_as_in_the_table(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(f"{w} {i % 40} {'abcdefgh'[i % 8]}{'klmnopqr'[i // 8 % 8]}", lang)
         for lang, w, n in (("xx", "same", 1200), ("yy", "same", 120)) for i in range(n)]
        + [(f"same {'abcdefgh'[i % 8]} {i}", "xx") for i in range(400)], "text string, lang string")
    asked = spark.createDataFrame([(1, "same")], "doc_id bigint, text string")
    want = langid.predict(asked, langid.train(rows)).first()
    monkeypatch.setattr(langid, "SAMPLE_PER_LANGUAGE", 60)
    got = langid.predict(asked, langid.train(rows)).first()
    assert want.lang_pred == got.lang_pred == "xx"
    assert want.score > 0.75 and abs(got.score - want.score) < 0.15
