import dataclasses
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from stratafill.config import PAST_CUTS
from stratafill.operators import cohort, features, quality, strata
from stratafill.operators.sequence import CLEAR_NAMES
from stratafill.plans import workflow
from stratafill.sources import preview, publish, stage, staged_since
from tests.fixtures import CFG, source_tables


@pytest.fixture(scope="module")
def tables(spark):
    return source_tables(spark)


@pytest.fixture(scope="module")
def result(tables):
    return workflow.run(tables, CFG)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_fills(result):
    assert tuple(result.fills.columns) == cohort.FILL_COLUMNS
    assert rows(result.fills, "unique_patient", "documentid", "ndc") == sorted([
        ("T1 - 1", 1, "00001"), ("T1 - 1", 2, "00001"), ("T1 - 1", 3, "00002"),
        ("T1 - 1", 16, "00002"), ("T1 - 2", 9, "00001"), ("T1 - 2", 11, "00004"),
        ("T1 - 2", 12, "00005"), ("T1 - 2", 13, "00006"), ("T2 - 1", 1, "00001")], key=str)


def test_undecided_exclusion_drops_null_class_with_listed_name(spark, tables):
    cfg = dataclasses.replace(CFG, excluded_names=("Tramadol",))
    names = {r[0] for r in cohort.qualifying_drugs(
        tables["medication"], cfg).select("MedicationName").collect()}
    assert "Tramadol" not in names and "Suboxone" in names


def test_demographics(tables, result):
    out = cohort.build_demographics(tables["patient"], result.fills, CFG)
    assert tuple(out.columns) == cohort.DEMOGRAPHIC_COLUMNS
    by_key = {r["unique_patient"]: r for r in out.collect()}
    assert set(by_key) == {"T1 - 1", "T1 - 2", "T2 - 1"}
    one, two, three = by_key["T1 - 1"], by_key["T1 - 2"], by_key["T2 - 1"]
    assert (one["fname_lname_dob"], one["age"], one["age_cohort"], one["zip"]) == (
        "ANNLEE|DELACRUZ|06/15/1988", 30, "age 30 to 39", "12345")
    assert (one["ethnicity"], one["DeceasedDate"], one["emergency_contact_flag"]) == (
        "NA", "2099-12-31", "No EContact")
    assert (two["age"], two["age_cohort"], two["DeceasedDate"], two["zip"], two["city_state"]) == (
        None, "age >85", "2018-3-5", "", " - Y")
    assert two["fname_lname_dob"] == "ANNLEE|DELACRUZ|"
    assert (three["age"], three["zip"]) == (17, "99999")
    strict = dataclasses.replace(CFG, drop_incomplete=True)
    assert cohort.build_demographics(tables["patient"], result.fills, strict).count() == 2


def test_surgery(tables):
    out = features.build_surgery(tables["patient_surgery"], tables["chart"], CFG)
    assert rows(out, *out.columns) == [
        ("T1 - 1", 3, 2, "same proc >1"), ("T1 - 2", 0, 0, "unlabeled surgery")]


def test_encounter_features(tables, result):
    codes = features.encounter_codes(
        result.fills, tables["encounter_diagnosis"], tables["encounter_dx_icd10"],
        tables["icd_code_all"], CFG)
    out = features.encounter_features(codes)
    assert len(out.columns) == 2 + 35
    got = {(r["unique_patient"], r["ClinicalEncounterID"]): r for r in out.collect()}
    first = got["T1 - 1", 100]  # R52 once, two oncology spellings, one missing code, no ICD9
    assert (first["diagnosiscode_all_total"], first["oncology_visits"], first["pain_visits"],
            first["diabetes_visits"]) == (3, 1, 1, 0)
    assert got["T1 - 1", 101]["diabetes_visits"] == 1
    assert got["T1 - 2", 103]["depression_single_episode_visits"] == 1
    shadowed = got["T2 - 1", 100]
    assert (shadowed["joint_pain_visits"], shadowed["shoulder_pain_visits"],
            shadowed["hf_visits"]) == (1, 0, 1)
    assert quality.duplicates(out, ["unique_patient", "ClinicalEncounterID"]).isEmpty()


def test_detail(result):
    assert tuple(result.detail.columns) == features.DETAIL_COLUMNS
    assert len(features.DETAIL_COLUMNS) == 68
    delta = quality.reconcile(result.detail, result.fills, "unique_patient").first()
    assert (delta["ct_delta"], delta["mem_delta"]) == (0, 0)
    got = {(r["unique_patient"], r["documentid"]): r for r in result.detail.collect()}
    assert got["T2 - 1", 1]["surgery_uniqueness_ratio"] == "no surgery"
    assert got["T2 - 1", 1]["surg_procs_all"] == 0
    assert got["T1 - 1", 1]["numberofrefillsprescribed"] == 0
    assert got["T1 - 1", 16]["diagnosiscode_all_total"] == 0


def test_feature_sums_repeat_per_fill_unless_deduplicated(result):
    def pain(mode):
        return dict(rows(features.patient_totals(result.detail, mode),
                         "unique_patient", "pain_visits_total"))

    assert pain("reference")["T1 - 1"] == 2 and pain("dedup")["T1 - 1"] == 1
    quantity = "total_opioid_prescribed"
    assert rows(features.patient_totals(result.detail, "dedup"), "unique_patient", quantity) == (
        rows(features.patient_totals(result.detail), "unique_patient", quantity))
    once = dict(rows(features.patient_sums(result.detail, "dedup"),
                     "unique_patient", "surg_procs_all"))
    assert once["T1 - 1"] == 3
    with pytest.raises(ValueError):
        features.patient_totals(result.detail, "other")


def test_sums_have_36_totals(result):
    assert len(features.patient_sums(result.detail).columns) == 2 + 36


def test_cumulative(result):
    out = result.cumulative
    assert tuple(out.columns) == workflow.CUMULATIVE_COLUMNS
    got = rows(out.where("unique_patient = 'T1 - 1'"),
               "rowid_encounter", "prescriptionfillquantity", "cumul_prescritionfillqty",
               "filldatediff", "cumul_filldatediff", "strata_mems", "met_exceed_threshold")
    # quantities in text order: 10.000 before 9.000; documents 3 and 16 are one fill
    assert [(r[0], float(r[1]), float(r[2]), *r[3:]) for r in got] == [
        (1, 10.0, 10.0, 0, 0, 1, 0), (2, 9.0, 19.0, 10, 10, 1, 0), (3, 30.0, 49.0, 0, 10, 1, 1)]
    last = out.where("unique_patient = 'T1 - 1' and rowid_encounter = 3").first()
    assert last["lag_filldate"] == last["current_filldate"] == dt.datetime(2018, 1, 11, 0, 30)
    labels = dict(rows(out, "unique_patient", "micro_strata"))
    assert labels["T2 - 1"] == (
        "age <18 | 1 chronic | No Surgery | med dx | 0 onc | med pain | 0 depress")


def test_dedup_and_literal_cuts(result):
    cfg = dataclasses.replace(CFG, feature_mode="dedup", cuts=PAST_CUTS)
    key = ("unique_patient", "rowid_encounter", "cumul_prescritionfillqty")
    found = workflow.cumulative_by_stratum(result.detail, cfg)
    assert rows(found, *key) == rows(result.cumulative, *key)
    labels = dict(rows(found, "unique_patient", "micro_strata"))
    assert labels["T1 - 1"] == (
        "age 30 to 39 | 1 chronic | Surgery | >med dx | med onc | med pain | 0 depress")


def test_several_strata_per_patient_are_refused(spark):
    twice = spark.createDataFrame([("p", "x"), ("p", "y")], "unique_patient string, micro_strata string")
    with pytest.raises(ValueError):
        strata.check_one_stratum(twice)


def test_publish_replaces_and_copies(spark, tables):
    with staged_since() as staged:
        result = workflow.run(tables, CFG, "detail_copy", "cumulative_copy",
                              cumulative_partitions=["micro_strata"])
    # a finished run leaves no staged file
    assert staged and not any(os.path.exists(x.staged_path) for x in staged)
    assert result.cumulative.where("micro_strata like 'age <18%'").count() == 1
    again = publish(result.cumulative.limit(2), "cumulative_small", partition_by=["micro_strata"])
    again = publish(spark.table("cumulative_copy").limit(3), "cumulative_small")
    assert again.count() == 3 and preview(again, 2).count() == 2
    detail = spark.read.table("detail_copy")
    delta = quality.reconcile(detail, result.detail, "unique_patient").first()
    assert (delta["ct_delta"], delta["mem_delta"]) == (0, 0)


def test_random_id_is_repeatable(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    ids = [r[0] for r in df.select(strata.random_id(F.col("k"), "s")).collect()]
    assert ids == [r[0] for r in df.select(strata.random_id(F.col("k"), "s")).collect()]
    assert len(set(ids)) == 2
    assert ids != [r[0] for r in df.select(strata.random_id(F.col("k"), "t")).collect()]
    drawn = [df.select(strata.random_id(F.col("k"), None)).collect() for _ in range(2)]
    assert drawn[0] != drawn[1]


def test_tenant_safe_diagnoses(spark, tables, result):
    """A tenant's own diagnosis rows only, where the table names the tenant."""
    args = (result.fills, tables["encounter_diagnosis"],
            tables["encounter_dx_icd10"].withColumn("context_id", F.lit("T2")),
            tables["icd_code_all"])
    safe = features.encounter_codes(*args, dataclasses.replace(CFG, tenant_safe=True))
    assert {r[0] for r in safe.select("context_id").collect()} == {"T2"}
    assert features.encounter_codes(*args, CFG).count() > safe.count()


def test_dots_can_be_ignored(spark):
    codes = spark.createDataFrame([("M25.51",), ("C55",)], "DiagnosisCode string")
    out = features.number_rules(codes, dataclasses.replace(CFG, strip_dots=True))
    assert sorted(map(tuple, out.select("pain_rule", "oncology_rule").collect())) == [
        (0, 1), (13, 0)]


def test_corrected_names(result):
    clear = result.cumulative.withColumnsRenamed(CLEAR_NAMES).columns
    assert "perct80_prescriptionfillqty" in clear and "cumul_prescriptionfillqty" in clear


def test_open_place_of_a_single_disease_visit(spark):
    sums = spark.createDataFrame([("p", 0, 1, 2)], "unique_patient string, a int, b int, c int")
    parts = [F.when(F.col(x) == 0, F.lit("not")).when(F.col(x) > 1, F.lit("has")) for x in "abc"]
    assert strata.assign_strata(sums, {}, parts).first()["micro_strata"] == "not |  | has"


def test_two_demographic_rows_multiply_the_fills(spark, tables, result):
    """Same band: fills repeat in the detail but not in the sequence. Other band: refused."""
    def with_second_row(**changes):
        second = tables["patient"].where("context_id = 'T1' and EnterpriseID = 1")
        for name, value in changes.items():
            second = second.withColumn(name, F.lit(value).cast(second.schema[name].dataType))
        people = dict(tables, patient=tables["patient"].unionByName(second))
        return stage(workflow.detail_from_fills(result.fills, people, CFG), "detail")

    moved = with_second_row(City="Elsewhere")
    own = result.fills.where("unique_patient = 'T1 - 1'").count()
    assert moved.count() == result.detail.count() + own
    assert workflow.cumulative_by_stratum(moved, CFG).count() == result.cumulative.count()
    with pytest.raises(ValueError):
        workflow.cumulative_by_stratum(with_second_row(DOB="1950-01-01"), CFG)


def test_exploration(tables):
    words = {"MedicationName": ("SUBOXONE", "TRAMADOL")}
    found = quality.lookup_contains(
        tables["medication"], words, "MedicationName", "HIC3Description")
    assert {r[0] for r in found.collect()} == {"Suboxone", "Tramadol"}
    kinds = quality.distinct_values(tables["patient_medication"], "medicationtype")
    assert [r[0] for r in kinds.collect()] == ["CLINICALPRESCRIPTION", "HISTORY"]
    per_band = quality.entities_per_group(tables["chart"], "context_id", "EnterpriseID")
    assert [tuple(r) for r in per_band.collect()][0] == ("T1", 2)
