"""Source tables: what is read and which columns the operators use."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DateType()
_TS, _Q = T.TimestampNTZType(), T.DecimalType(18, 3)


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


# Source column names and types.
SCHEMAS: dict[str, T.StructType] = {
    "patient_medication": _schema(
        context_id=_S, documentid=_L, medicationtype=_S, DeletedDatetime=_TS,
        prescriptionfillquantity=_Q, numberofrefillsprescribed=_I),
    "document": _schema(
        context_id=_S, documentid=_L, patientid=_L, ClinicalEncounterID=_L, ChartID=_L, FBDMedID=_L),
    "clinicalencounter": _schema(context_id=_S, ClinicalEncounterID=_L, EncounterDate=_TS),
    "chart": _schema(context_id=_S, ChartID=_L, EnterpriseID=_L),
    "medication": _schema(
        context_id=_S, FDBMedID=_L, ndc=_S, MedicationName=_S, HIC3Description=_S),
    "patient": _schema(
        context_id=_S, EnterpriseID=_L, FirstName=_S, LastName=_S, Sex=_S, DOB=_D, Ethnicity=_S,
        Race=_S, MaritalStatus=_S, DeceasedDate=_D, City=_S, state=_S, Zip=_S,
        EmergencyContactRelationship=_S),
    "patient_surgery": _schema(
        context_id=_S, ChartID=_L, surgerydatetime=_TS, Procedure=_S, Note=_S),
    "encounter_diagnosis": _schema(
        context_id=_S, ClinicalEncounterID=_L, ClinicalEncounterDXID=_L),
    "encounter_dx_icd10": _schema(ClinicalEncounterDXID=_L, IcdCodeID=_L),
    "icd_code_all": _schema(IcdCodeID=_L, DiagnosisCode=_S, DiagnosisCodeSet=_S),
}


def load(spark: SparkSession, root: str | None, name: str) -> DataFrame:
    """Table ``name``: ``<root>/<name>.parquet``, or the catalog table when ``root`` is None."""
    if root is None:
        return spark.read.table(name)
    return spark.read.parquet(f"{root}/{name}.parquet")


class Tables(dict):
    """Tables of one place by name, each opened when first asked for."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        super().__init__()
        self.spark, self.root = spark, root

    def __missing__(self, name: str) -> DataFrame:
        self[name] = load(self.spark, self.root, name)
        return self[name]


TENANT = "context_id"
#: text that lists and rules are compared with
COMPARED: dict[str, tuple[str, ...]] = {
    "patient_medication": ("medicationtype",),
    "medication": ("MedicationName", "HIC3Description"),
    "icd_code_all": ("DiagnosisCode", "DiagnosisCodeSet"),
}


def one_spelling(c: Column, collation: str) -> Column:
    """The text that all texts equal under the collation are written as.

    For the collations that ignore the case of letters (LCASE), blanks at the end (RTRIM) or both.
    """
    if "RTRIM" in collation:
        c = F.rtrim(c)
    return F.lower(c) if "LCASE" in collation else c


def collated(tables: Mapping[str, DataFrame], collation: str) -> dict[str, DataFrame]:
    """The source tables with text that compares as under ``collation`` in every step.

    Tenants get one spelling, since they become a part of the patient's key; text that lists,
    patterns, prefixes and ranges are compared with is given the collation.
    """
    if not any(x in collation for x in ("LCASE", "RTRIM")) or not collation.startswith("UTF8_"):
        raise ValueError(f"collation {collation!r} is not one of UTF8_LCASE and the RTRIM ones")
    out = {}
    for name in SCHEMAS:
        df = tables[name]
        if TENANT in df.columns:
            df = df.withColumn(TENANT, one_spelling(F.col(TENANT).cast("string"), collation))
        out[name] = df.withColumns({
            c: F.collate(F.col(c), collation) for c in COMPARED.get(name, ())})
    return out
