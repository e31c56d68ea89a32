import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratafill.functions import buckets, dates, predicates, text
from stratafill.functions.rules import DEPRESSION, DISEASE, ONCOLOGY, PAIN

c = F.col


def column(spark, values, kind, expr):
    """``expr`` over one column ``x``."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_concatenation_skips_null(spark):
    assert column(spark, ["a", None], "string", text.tenant_key(c("x"), F.lit(7))) == [
        "a - 7", " - 7"]
    assert column(spark, ["a", None], "string", text.label_join([c("x"), F.lit("z")], " - ")) == [
        "a - z", " - z"]
    assert column(spark, [None], "string", text.match_key(c("x"), c("x"), c("x"))) == ["||"]


def test_names_and_zip(spark):
    assert column(spark, [" de La-Cruz ", None], "string", text.normalize_name(c("x"))) == [
        "DELACRUZ", None]
    assert column(spark, ["12345-6789", "", None, "123"], "string", text.zip5(c("x"))) == [
        "12345", "", "99999", "123"]


def test_default_takes_the_type_of_the_column(spark):
    df = spark.createDataFrame([(None, None)], "n int, t string")
    out = text.default_null(df, {"n": 0, "t": "NA"})
    assert out.collect() == [(0, "NA")] and dict(out.dtypes)["n"] == "int"


def test_dates(spark):
    d = dt.date(2018, 3, 5)
    assert column(spark, [d, None], "date", dates.unpadded_date(c("x"), "2099-12-31")) == [
        "2018-3-5", "2099-12-31"]
    assert column(spark, [d], "date", dates.fmt_date(c("x"), 101)) == ["03/05/2018"]
    assert column(spark, [d], "date", dates.fmt_date(c("x"), 102)) == ["2018.03.05"]


def test_days_count_date_boundaries(spark):
    late, early = dt.datetime(2018, 1, 1, 23, 59), dt.datetime(2018, 1, 2, 0, 0)
    df = spark.createDataFrame([(late, early)], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(dates.days_between(c("a"), c("b"))).first()[0] == 1


def test_eighteenth_birthday_counts_as_17(spark):
    assert column(spark, [dt.date(2000, 12, 31), dt.date(2000, 12, 30), None], "date",
                  dates.age_years(c("x"), "2018-12-31")) == [17, 18, None]


def test_year_ranges(spark):
    stamps = [dt.datetime(2016, 12, 31, 23, 59), dt.datetime(2017, 1, 1), None]
    assert column(spark, stamps, "timestamp_ntz", dates.after_year(c("x"), 2016)) == [
        False, True, None]
    assert column(spark, stamps, "timestamp_ntz", dates.years_between(c("x"), 2015, 2016)) == [
        True, False, None]


def test_age_band_labels(spark):
    ages = [17, 18, 29, 30, 70, 75, 76, 80, 81, None]
    assert column(spark, ages, "bigint", buckets.age_band(c("x"))) == [
        "age <18", "age 18 to 29", "age 18 to 29", "age 30 to 39", "age 70 to 79",
        "age 70 to 79", "age 80 to 85", "age 80 to 85", "age >85", "age >85"]


def test_buckets(spark):
    assert column(spark, [None, 0, 1, 2, 3], "bigint", buckets.median_bucket(c("x"), 2, "p")) == [
        "0 p", "0 p", "med p", "med p", ">med p"]
    chronic = buckets.chronic_bucket([c("x"), F.lit(0)])
    assert column(spark, [None, 0, 1, 2], "bigint", chronic) == [
        None, "no disease", "1 chronic", "2+ chronics"]
    assert column(spark, [None], "bigint", buckets.micro_stratum(
        [F.lit("a"), chronic, F.lit("b")])) == ["a |  | b"]
    assert column(spark, [None, 3.0, 3.2], "double", buckets.met_flag(c("x"), F.lit(3.2))) == [
        0, 0, 1]


def test_exclude_pair_keeps_only_decided_rows(spark):
    rows = [("X", None), (None, "b"), ("X", "b"), ("X", "z"), (None, None), ("x", "b")]
    df = spark.createDataFrame(rows, "a string, b string")
    kept = df.where(predicates.exclude_pair(c("a"), ["X"], c("b"), ["b"])).collect()
    assert sorted(map(tuple, kept)) == [("X", "z"), ("x", "b")]
    folded = df.where(
        predicates.exclude_pair(c("a"), ["X"], c("b"), ["b"], "UTF8_LCASE")).collect()
    assert list(map(tuple, folded)) == [("X", "z")]


def test_contains_any_ignores_case_and_null(spark):
    df = spark.createDataFrame(
        [("ms contin", None), (None, "NARCOTIC"), ("x", "y"), (None, None)], "n string, k string")
    hits = df.where(predicates.contains_any({"n": ["MS CONTIN"], "k": ["narcotic"]}))
    assert hits.count() == 2


@pytest.mark.parametrize("code, label", [
    ("R52", "pain, unspecified"), ("R102", "abdomen pain"), ("M2551", "joint pain"),
    ("M545", "back pain"), ("M542", "spine pain"), ("S89", "No Pain"),
    ("S90", "ankle/foot injuries"), ("S99921", "ankle/foot injuries"), ("R070", "throat pain"),
    ("R071", "chest pain"), ("R0789", "chest pain"), ("R07", "No Pain"), ("", "No Pain"),
    (None, "No Pain"), ("G43909", "migrane"), ("G4390", "No Pain"),
])
def test_pain_rules(spark, code, label):
    assert column(spark, [code], "string", PAIN.label(c("x"))) == [label]


def test_other_rules(spark):
    assert column(spark, ["C55", "C55.1", "C50911"], "string", ONCOLOGY.label(c("x"))) == [
        "oncology", "no oncology", "no oncology"]
    assert column(spark, ["I5022", "I502", "40201", "I694", "I6940", "I69"], "string",
                  DISEASE.label(c("x"))) == [
        "hf", "not a core disease", "hf", "stroke", "stroke", "not a core disease"]
    assert column(spark, ["F32.9", "F33"], "string", DEPRESSION.number(c("x"))) == [1, 2]
    assert column(spark, ["M25.51"], "string", PAIN.label(c("x"), strip_dots=True)) == [
        "joint pain"]


def test_rules_that_cannot_match_are_reported():
    assert PAIN.shadowed() == [
        ("pelvic and perineal pain", "R102"), ("shoulder pain", "M2551")]
    assert len(ONCOLOGY.rules[0].exact) == 67 and len(PAIN.rules) == 22
    assert sum(len(r.prefixes) for r in DISEASE.rules) == 6 + 42 + 1 + 3 + 3 + 1 + 4
