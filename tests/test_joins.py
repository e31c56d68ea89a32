"""Joins of hot keys, joins on dates, appointments and claims."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratafill.analogues import adapters as on
from stratafill.operators import claims, quality
from stratafill.operators.features import build_detail, encounter_codes, encounter_features
from stratafill.operators.cohort import build_demographics, build_fills
from stratafill.operators.joins import join_reduced, join_within
from stratafill.plans.workflow import detail_from_fills
from stratafill.sources import stage
from tests.fixtures import CFG, source_tables
from tests.test_plans import plan

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_parts(spark):
    """Thresholds under which a hot key of a few thousand rows counts as skewed."""
    held = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark, n=60_000):
    """(key, other, encounter): two thirds of the rows have the key 1."""
    return spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).cast("string").alias("unique_patient"),
        F.date_add(F.lit("2018-01-01").cast("date"), (F.col("id") % 700).cast("int"))
        .alias("EncounterDate"),
        F.col("id").alias("ClinicalEncounterID"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def test_reduced_side_lets_a_hot_key_be_split(spark, small_parts):
    rows = hot_rows(spark)
    per_key = rows.groupBy("unique_patient").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left", "left_semi"):
        joined = join_reduced(rows, per_key, "unique_patient", how)
        assert "skew=true" in final_plan(joined), how
        assert joined.count() == 60_000


def test_days_of_a_hot_patient_are_split(spark, small_parts):
    rows = hot_rows(spark)
    found = quality.multi_encounter_days(rows)
    assert "skew=true" in final_plan(found)
    assert found.count() == 40_000
    again = quality.rows_of_duplicates(
        rows.withColumn("line", F.col("ClinicalEncounterID") % 5), ["unique_patient", "line"],
        "unique_patient")
    assert "skew=true" in final_plan(again)
    assert again.count() == 40_000


def test_detail_of_a_hot_patient_is_split(spark, small_parts):
    tables = source_tables(spark)
    fills = build_fills(tables, CFG)
    one = fills.where("unique_patient = 'T1 - 1'").limit(1)
    many = spark.range(40_000, numPartitions=8).crossJoin(F.broadcast(one)).withColumn(
        "documentid", F.col("id")).withColumn("medicationtype", F.sha2(
            F.col("id").cast("string"), 256)).withColumn("ClinicalEncounterID", F.col("id")).drop("id")
    others = spark.range(3000, numPartitions=8).crossJoin(F.broadcast(one)).withColumn(
        "unique_patient", F.concat(F.lit("T1 - x"), F.col("id"))).drop("id")
    fills = stage(many.select(*fills.columns).unionByName(others.select(*fills.columns)), "fills")
    people = build_demographics(tables["patient"], fills, CFG)
    surgery = spark.createDataFrame(
        [("T1 - 1", 2, 1, "same proc >1")],
        "unique_patient string, surg_procs_all long, surg_procs_distinct long, "
        "surgery_uniqueness_ratio string")
    dx = encounter_features(encounter_codes(
        fills, tables["encounter_diagnosis"], tables["encounter_dx_icd10"],
        tables["icd_code_all"], CFG))
    detail = build_detail(people, fills, surgery, dx)
    assert "skew=true" in final_plan(detail)
    assert detail.count() == 40_000
    assert detail_from_fills(fills, tables, CFG).count() == 40_000


def test_join_within_equals_a_search_of_all_pairs(spark):
    rng = random.Random(5)
    day = dt.date(2018, 1, 1)

    def date():
        return None if rng.random() < 0.05 else day + dt.timedelta(rng.randint(-40, 40))
    points = [(rng.choice([1, 2, None]), i, date()) for i in range(120)]
    spans = [(rng.choice([1, 2, None]), i, date(), date()) for i in range(60)]
    got = join_within(
        spark.createDataFrame(points, "k int, p int, at date"),
        spark.createDataFrame(spans, "k int, s int, a date, b date"), ["k"], "at", "a", "b", 7)
    want = Counter((k, p, s) for k, p, at in points for j, s, a, b in spans
                   if k == j is not None and at and a and b and a <= at <= b)
    assert Counter((r.k, r.p, r.s) for r in got.collect()) == want and want
    text = plan(got)
    assert "NestedLoop" not in text and "Cartesian" not in text


D = dt.datetime
APPOINTMENTS = [  # tenant, patient, appointment, date, claim
    ("T1", 501, 1, D(2018, 1, 5), 70), ("T1", 501, 2, D(2018, 2, 5), 71),
    ("T1", 501, 3, D(2017, 12, 31), 72), ("T2", 501, 1, D(2018, 1, 5), 70),
    ("T1", 900, 4, D(2018, 1, 5), 73), ("T1", 501, 5, D(2018, 3, 1), None)]
CLAIMS = [  # tenant, patient, claim, original, provider, appointment, department, charged
    ("T1", 501, 70, None, 8, 1, 1, D(2018, 1, 5)), ("T1", 501, 99, 71, 8, 2, 1, D(2018, 2, 9)),
    ("T1", 501, 98, 97, 8, 2, 1, D(2018, 2, 5)), ("T1", 501, 72, None, 9, 3, 1, D(2018, 1, 2)),
    ("T1", 900, 73, 73, 9, 4, 2, D(2018, 1, 6)), ("T1", 501, 71, None, 7, None, 2, D(2018, 3, 1)),
    ("T1", 501, None, None, 7, 5, 2, D(2018, 3, 1))]


@pytest.fixture
def booked(spark):
    return spark.createDataFrame(
        APPOINTMENTS, "context_id string, patientid long, appointmentid long, "
        "AppointmentDate timestamp_ntz, claimid long")


@pytest.fixture
def claimed(spark):
    return spark.createDataFrame(
        CLAIMS, "context_id string, patientid long, claimid long, originalclaimid long, "
        "renderingproviderid long, claimappointmentid long, servicedepartmentid long, "
        "ChargeFromDate timestamp_ntz")


def test_link_appointments(spark, booked, claimed):
    fills = spark.createDataFrame(
        [("T1", 501, 11), ("T1", 501, 12), ("T1", 501, 12), ("T2", 900, 13)],
        "context_id string, patientid long, documentid long")
    linked = [("T1", 501, 1, 70, 8), ("T1", 501, 2, 99, 8)]

    def rows(df):
        return Counter((r.context_id, r.patientid, r.appointmentid, r.claimid, r.renderingproviderid)
                       for r in df.collect())
    assert rows(claims.link_appointments(booked, claimed, fills)) == Counter(linked * 2)
    assert rows(claims.link_appointments(
        booked, claimed, fills, per_document=False)) == Counter(linked)
    assert rows(claims.link_appointments(booked, claimed, fills, after=2016, per_document=False)
                ) == Counter([*linked, ("T1", 501, 3, 72, 9)])
    near = rows(claims.link_claims_within(booked, claimed, before=0, after=3))
    assert near == Counter([("T1", 501, 1, 70, 8), ("T1", 501, 3, 72, 9), ("T1", 900, 4, 73, 9)])
    near = rows(claims.link_claims_within(booked, claimed, before=0, after=24))
    assert near[("T1", 501, 2, 99, 8)] == 1 and near[("T1", 501, 2, 71, 7)] == 1


def test_appointment_records(spark, booked, claimed):
    records = spark.createDataFrame(
        [("T1", 501, 5, 11), ("T1", 501, None, 12), ("T1", 501, 6, 13)],
        "context_id string, patientid long, ChartID long, documentid long")
    documents = spark.createDataFrame(
        [("T1", 501, 5, 21), ("T1", 501, 5, 22), ("T1", 501, 7, 23)],
        "context_id string, patientid long, ChartID long, documentid long")
    got = claims.appointment_records(
        booked, records, claimed, documents, since="2018-01-01", tenants=["T1"])
    assert sorted((r.appointmentid, r.claimid, r.recordid, r.documentid) for r in got.collect()) \
        == [(1, 70, 11, 21), (1, 70, 11, 22), (2, 99, 11, 21), (2, 99, 11, 22)]
    assert claims.appointment_records(
        booked, records, claimed, documents, since="2018-01-01", until="2018-01-10").count() == 2


def test_claims_by_transactions(spark, claimed):
    charges = spark.createDataFrame(
        [("T1", 70, D(2016, 12, 31, 23)), ("T1", 70, D(2017, 1, 1)), ("T1", 70, D(2018, 1, 1)),
         ("T2", 71, D(2018, 1, 1)), ("T1", 99, None), ("T1", None, D(2018, 1, 1))],
        "context_id string, claimid long, ChargeFromDate timestamp_ntz")
    got = claims.claims_by_transactions(claimed, charges)
    assert sorted((r.claimid, r.unique_patient, r.ChargeFromDate.year) for r in got.collect()) == [
        (70, "T1 - 501", 2017), (70, "T1 - 501", 2018)]
    text = plan(claims.claims_by_transactions(
        claimed, stage(charges, "charges")))
    assert "GreaterThanOrEqual(ChargeFromDate" in text


def test_only_years_of_fills_are_read(spark, claimed, tmp_path):
    charges = spark.createDataFrame(
        [("T1", 70, 2016), ("T1", 71, 2017), ("T1", 99, 2018), ("T1", 99, 2018)],
        "context_id string, claimid long, charge_year int")
    dated = stage(charges, "charges", ["charge_year"])
    fills = spark.createDataFrame([("2018-05-01",), ("2015-01-01",), (None,)], "d string").select(
        F.col("d").cast("date").alias("EncounterDate"))
    got = claims.claims_in_fill_years(claimed, dated, fills)
    assert [r.claimid for r in got.collect()] == [99]
    scan = claims.transactions_in_fill_years(dated, fills)
    assert "dynamicpruning" in plan(scan)
    files = [m for m in scan.select(F.input_file_name()).distinct().collect()]
    assert files and all("charge_year=2018" in f[0] for f in files)


def test_registered_tables_have_links(spark):
    from stratafill.sources import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    assert on.claims(t).where("originalclaimid IS NOT NULL").count() > 0
