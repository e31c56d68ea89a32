from pyspark.sql import functions as F

from stratafill.operators import quality


def test_checks(spark):
    df = spark.createDataFrame(
        [("a", 1, 10), ("a", 1, 11), ("a", 2, 12), ("b", 1, 13), (None, 1, 14)],
        "unique_patient string, EncounterDate int, ClinicalEncounterID int")
    assert tuple(quality.profile(df, "unique_patient").first()) == (5, 2, 3)
    assert [tuple(r) for r in quality.freq(df, "unique_patient").collect()][0] == ("a", 3)
    assert quality.freq(df, "unique_patient").count() == 3
    assert [tuple(r) for r in quality.duplicates(
        df, ["unique_patient", "EncounterDate"]).collect()] == [("a", 1, 2)]
    assert quality.multi_encounter_days(df).count() == 3
    assert quality.trace(df, "unique_patient", "a", "ClinicalEncounterID").count() == 3
    assert [r[2] for r in quality.top_n(df, 2, F.desc("ClinicalEncounterID")).collect()] == [14, 13]
    assert tuple(quality.reconcile(df, df.limit(0), "unique_patient").first()) == (5, 0, 5, 2, 0, 2)


def test_ratio_guards_zero(spark):
    rows = [(7, 2, 3), (7, 0, None), (-1, 2, 0), (9007199254740993, 1, 9007199254740993)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, want bigint")
    got = df.select(quality.ratio(F.col("a"), F.col("b")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
