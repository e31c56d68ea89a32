"""Text that differs in case and in blanks at the end, compared as a lenient collation does."""

import dataclasses

import duckdb
import pytest
from pyspark.sql import functions as F

from stratafill.operators.features import encounter_codes, encounter_features
from stratafill.plans import workflow
from stratafill.sources import SCHEMAS
from stratafill.sources.tables import collated
from tests.fixtures import CFG, CODES, DIAGNOSES, DX_CODES, source_tables

LENIENT = "UTF8_LCASE_RTRIM"


def messy(tables):
    """The same tables, every third row in another case and every fourth with blanks."""
    out = {}
    for name, df in tables.items():
        numbered = df.withColumn("_n", F.monotonically_increasing_id() % 12)
        for c in ("context_id", "medicationtype", "DiagnosisCode", "DiagnosisCodeSet"):
            if c in df.columns:
                text = F.when(F.col("_n") % 3 == 0, F.lower(c)).otherwise(F.col(c))
                numbered = numbered.withColumn(c, F.when(
                    F.col("_n") % 4 == 1, F.concat(text, F.lit("  "))).otherwise(text))
        out[name] = numbered.select(*df.columns)
    return out


def lines(df):
    same = [F.lower(F.rtrim(c)).alias(c) if t.startswith("string") else F.col(c)
            for c, t in df.dtypes if c != "randGUID"]
    return sorted(map(str, df.select(*same).collect()))


def test_a_lenient_collation_gives_the_results_of_clean_text(spark):
    tables = source_tables(spark)
    want = workflow.run(tables, CFG)
    cfg = dataclasses.replace(CFG, collation=LENIENT)
    got = workflow.run(messy(tables), cfg)
    for step in ("fills", "detail", "cumulative"):
        assert lines(getattr(got, step)) == lines(getattr(want, step)), step
    assert got.profiles == want.profiles
    strict = workflow.run(messy(tables), CFG)
    assert strict.fills.count() < want.fills.count()


def test_codes_compare_like_nocase_sql(spark):
    tables = messy(source_tables(spark))
    extra = spark.createDataFrame(
        [(20, "r52", "ICD10"), (21, "R52  ", "icd10"), (22, "s95", "ICD10"), (23, "E11 9", "ICD10")],
        SCHEMAS["icd_code_all"])
    tables["icd_code_all"] = tables["icd_code_all"].unionByName(extra)
    more = spark.createDataFrame([(1, i) for i in range(20, 24)], SCHEMAS["encounter_dx_icd10"])
    tables["encounter_dx_icd10"] = tables["encounter_dx_icd10"].unionByName(more)
    fills = workflow.run(source_tables(spark), CFG).fills.withColumn(
        "context_id", F.lower("context_id"))
    loose = collated(tables, LENIENT)
    cfg = dataclasses.replace(CFG, collation=LENIENT)
    got = encounter_features(encounter_codes(
        fills, loose["encounter_diagnosis"], loose["encounter_dx_icd10"], loose["icd_code_all"], cfg))
    con = duckdb.connect()
    con.execute("CREATE TABLE fills (t VARCHAR COLLATE NOCASE, p BIGINT, e BIGINT)")
    con.executemany("INSERT INTO fills VALUES (?, ?, ?)", [
        tuple(r) for r in fills.select("context_id", "EnterpriseID", "ClinicalEncounterID").collect()])
    con.execute("CREATE TABLE dx (t VARCHAR COLLATE NOCASE, e BIGINT, d BIGINT)")
    con.executemany("INSERT INTO dx VALUES (?, ?, ?)", [(t.rstrip(), e, d) for t, e, d in DIAGNOSES])
    con.execute("CREATE TABLE link (d BIGINT, i BIGINT)")
    con.executemany("INSERT INTO link VALUES (?, ?)", [*DX_CODES, *[(1, i) for i in range(20, 24)]])
    con.execute("CREATE TABLE codes (i BIGINT, c VARCHAR COLLATE NOCASE, s VARCHAR COLLATE NOCASE)")
    con.executemany("INSERT INTO codes VALUES (?, ?, ?)", [
        *CODES, (20, "r52", "ICD10"), (21, "R52", "icd10"), (22, "s95", "ICD10"),
        (23, "E11 9", "ICD10")])
    want = con.execute("""
        SELECT e, count(c), count(CASE WHEN c = 'R52' OR c >= 'S90' AND c <= 'S99' THEN 1 END)
        FROM (SELECT DISTINCT f.t, p, f.e, c FROM fills f JOIN dx ON f.t = dx.t AND f.e = dx.e
              JOIN link ON dx.d = link.d JOIN codes ON link.i = codes.i WHERE s = 'ICD10')
        WHERE t = 'T1' AND e = 100 GROUP BY e""").fetchall()
    found = got.where("unique_patient = 't1 - 1' AND ClinicalEncounterID = 100").select(
        "ClinicalEncounterID", "diagnosiscode_all_total",
        F.col("unspecified_pain_visits") + F.col("ankle_foot_visits")).collect()
    assert [tuple(r) for r in found] == want and want


def test_unknown_collations_are_refused(spark):
    with pytest.raises(ValueError):
        collated(source_tables(spark), "UNICODE_CI")
