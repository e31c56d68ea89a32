"""Made-up source tables with the edge cases of each step."""

import datetime as dt
from decimal import Decimal

from stratafill.config import CohortConfig
from stratafill.sources.tables import SCHEMAS

CFG = CohortConfig(tenants=("T1", "T2"))
CLIN = "CLINICALPRESCRIPTION"


def day(text):
    return dt.date.fromisoformat(text)


def ts(text):
    return dt.datetime.fromisoformat(text)


def q(x):
    return None if x is None else Decimal(str(x))


# record: tenant, document, type, deleted, quantity, refills
RECORDS = [
    ("T1", 1, CLIN, None, q(9), None),
    ("T1", 2, CLIN, None, q(10), 1),
    ("T1", 3, CLIN, None, q(30), 0),
    ("T1", 3, CLIN, None, q(30), 0),                       # exact duplicate
    ("T1", 4, CLIN, ts("2018-01-01"), q(7), 0),            # deleted
    ("T1", 5, "HISTORY", None, q(7), 0),                   # other type
    ("T3", 6, CLIN, None, q(7), 0),                        # other tenant
    ("T1", 7, CLIN, None, None, 0),                        # no quantity
    ("T2", 1, CLIN, None, q(5), 2),                        # document number of another tenant
    ("T1", 8, CLIN, None, q(40), 0),                       # last minute of 2016
    ("T1", 9, CLIN, None, q(60), 0),                       # first minute of 2017
    ("T1", 10, CLIN, None, q(20), 0),                      # excluded class-and-name pair
    ("T1", 11, CLIN, None, q(21), 0),                      # excluded class, other name
    ("T1", 12, CLIN, None, q(22), 0),                      # no class, name hit
    ("T1", 13, CLIN, None, q(23), 0),                      # no name, class hit
    ("T1", 14, CLIN, None, q(24), 0),                      # no hit
    ("T1", 15, CLIN, None, q(25), 0),                      # encounter without a date
    ("T1", 16, CLIN, None, q(30), 0),                      # same date, drug, quantity as 3
]
# document: tenant, document, patient, encounter, chart, drug
DOCUMENTS = [
    ("T1", 1, 501, 100, 11, 1), ("T1", 2, 501, 100, 11, 1), ("T1", 3, 501, 101, 11, 2),
    ("T1", 4, 501, 101, 11, 1), ("T1", 5, 501, 101, 11, 1), ("T3", 6, 501, 101, 11, 1),
    ("T1", 7, 501, 101, 11, 1), ("T2", 1, 777, 100, 11, 1), ("T1", 8, 502, 102, 12, 1),
    ("T1", 9, 502, 103, 12, 1), ("T1", 10, 502, 103, 12, 3), ("T1", 11, 502, 103, 12, 4),
    ("T1", 12, 502, 103, 12, 5), ("T1", 13, 502, 103, 12, 6), ("T1", 14, 502, 103, 12, 7),
    ("T1", 15, 502, 104, 12, 1), ("T1", 16, 501, 105, 13, 2),
]
ENCOUNTERS = [
    ("T1", 100, ts("2018-01-01 09:00")), ("T1", 101, ts("2018-01-11 00:30")),
    ("T1", 102, ts("2016-12-31 23:59")), ("T1", 103, ts("2017-01-01 00:00")),
    ("T1", 104, None), ("T1", 105, ts("2018-01-11 00:30")), ("T2", 100, ts("2018-03-01")),
    ("T3", 101, ts("2018-01-11")),
]
CHARTS = [("T1", 11, 1), ("T1", 13, 1), ("T1", 12, 2), ("T2", 11, 1), ("T3", 11, 9)]
# drug: tenant, id, ndc, name, class
_DRUGS = [
    (1, "00001", "kadian 10 mg", "ANALGESICS"),            # name hit, other case
    (2, "00002", "Plain", "Narcotic Analgesics"),          # class hit, other case
    (3, "00003", "Suboxone", "NARCOTIC WITHDRAWAL THERAPY AGENTS"),
    (4, "00004", "Other", "NARCOTIC WITHDRAWAL THERAPY AGENTS"),
    (5, "00005", "Tramadol", None),
    (6, "00006", None, "METHADONE"),
    (7, "00007", "Aspirin", "ANALGESICS"),
]
DRUGS = [(t, *d) for t in ("T1", "T2") for d in _DRUGS]


def person(tenant, ent, first="Ann-Lee ", last="De La-Cruz", sex="F", dob="1988-06-15",
           eth=None, race="B", marital="M", died=None, city="X", state="Y", zipc="12345-6789",
           contact=None):
    return (tenant, ent, first, last, sex, dob and day(dob), eth, race, marital,
            died and day(died), city, state, zipc, contact)


PATIENTS = [
    person("T1", 1),
    person("T1", 2, dob=None, died="2018-03-05", city=None, zipc="", contact="sister"),
    person("T2", 1, dob="2001-01-01", zipc=None),
    person("T2", 99),                                      # no fills
]
# surgery: tenant, chart, time, procedure, note
SURGERIES = [
    ("T1", 11, ts("2014-12-31 23:59"), "early", None),
    ("T1", 11, ts("2015-01-01"), "knee", None),
    ("T1", 13, ts("2018-12-31 23:59"), "knee", "n"),       # other chart, same person
    ("T1", 11, ts("2018-06-01"), None, "note"),
    ("T1", 11, ts("2019-01-01"), "late", None),
    ("T1", 12, ts("2016-01-01"), None, None),
]
# encounter 100: R52 twice (two code numbers), dotted oncology, undotted oncology, ICD9, no code
DIAGNOSES = [("T1", 100, 1), ("T1", 100, 2), ("T1", 101, 3), ("T1", 103, 4), ("T2", 100, 5)]
DX_CODES = [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6), (3, 7), (3, 8), (4, 9), (5, 10),
            (5, 11)]
CODES = [
    (1, "R52", "ICD10"), (2, "R52", "ICD10"), (3, "Z12.11", "ICD10"), (4, "Z1211", "ICD10"),
    (5, "E119", "ICD9"), (6, None, "ICD10"), (7, "E119", "ICD10"), (8, "I10", "ICD10"),
    (9, "F329", "ICD10"), (10, "M2551", "ICD10"), (11, "I5022", "ICD10"),
]


def source_tables(spark):
    rows = {
        "patient_medication": RECORDS, "document": DOCUMENTS, "clinicalencounter": ENCOUNTERS,
        "chart": CHARTS, "medication": DRUGS, "patient": PATIENTS, "patient_surgery": SURGERIES,
        "encounter_diagnosis": DIAGNOSES, "encounter_dx_icd10": DX_CODES, "icd_code_all": CODES,
    }
    return {name: spark.createDataFrame(data, SCHEMAS[name]) for name, data in rows.items()}
