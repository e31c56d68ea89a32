"""Cohort selection: qualifying fills, and one demographic row per patient."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafill.config import CohortConfig
from stratafill.functions.buckets import age_band
from stratafill.functions.dates import after_year, age_years, fmt_date, unpadded_date
from stratafill.functions.predicates import contains_any, exclude_pair, in_list
from stratafill.functions.text import (
    label_join, match_key, normalize_name, presence_flag, tenant_key, zip5)

# Output columns.
FILL_COLUMNS = (
    "context_id", "EnterpriseID", "unique_patient", "patientid", "documentid", "EncounterDate",
    "medicationtype", "ndc", "FBDMedID", "prescriptionfillquantity", "numberofrefillsprescribed",
    "ChartID", "ClinicalEncounterID",
)
DEMOGRAPHIC_COLUMNS = (
    "CONTEXT_ID", "EnterpriseID", "unique_patient", "FirstName", "LastName", "gender", "ln2",
    "fn2", "dob2", "age", "age_cohort", "ethnicity", "race", "maritalstatus", "DeceasedDate",
    "City", "state", "city_state", "zip", "emergency_contact_flag", "fname_lname_dob",
)


def live_prescriptions(medication_records: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Records that are not deleted, of the wanted types and tenants, with a quantity."""
    keep = (
        F.col("DeletedDatetime").isNull()
        & in_list(F.col("medicationtype"), cfg.medication_types, cfg.collation)
        & F.col("prescriptionfillquantity").isNotNull()
    )
    if cfg.tenants is not None:
        keep &= in_list(F.col("context_id").cast("string"), cfg.tenants, cfg.collation)
    return medication_records.where(keep)


def qualifying_drugs(medication: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Drugs of the wanted classes and names, without the excluded class-and-name pairs."""
    return medication.where(
        exclude_pair(
            F.col("HIC3Description"), cfg.excluded_classes,
            F.col("MedicationName"), cfg.excluded_names, cfg.collation)
        & contains_any(cfg.drug_words))


def build_fills(tables: Mapping[str, DataFrame], cfg: CohortConfig) -> DataFrame:
    """Distinct qualifying fills (:data:`FILL_COLUMNS`) from the five source tables.

    All five are shuffled, none is broadcast: they grow with the data, and Spark's estimate of
    their size knows neither what a list repeats per row nor how far a file is compressed.
    """
    records = live_prescriptions(tables["patient_medication"], cfg)
    encounters = tables["clinicalencounter"].where(
        after_year(F.col("EncounterDate"), cfg.fills_after_year))
    drugs = qualifying_drugs(tables["medication"], cfg).select(
        "context_id", F.col("FDBMedID").alias("FBDMedID"), "ndc").hint("merge")
    fills = (
        records.select("context_id", "documentid", "medicationtype",
                       "prescriptionfillquantity", "numberofrefillsprescribed")
        .join(tables["document"].select(
            "context_id", "documentid", "patientid", "ClinicalEncounterID", "ChartID", "FBDMedID")
            .hint("merge"), ["context_id", "documentid"])
        .join(drugs, ["context_id", "FBDMedID"])
        .join(encounters.select("context_id", "ClinicalEncounterID", "EncounterDate")
              .hint("merge"), ["context_id", "ClinicalEncounterID"])
        .join(tables["chart"].select("context_id", "ChartID", "EnterpriseID").hint("merge"),
              ["context_id", "ChartID"])
    )
    return distinct_fill_records(fills)


def attach_appointments(fills: DataFrame, appointments: DataFrame) -> DataFrame:
    """The fills with the appointments of the same tenant, patient and date, if there are any."""
    same_day = appointments.select(
        "context_id", F.col("PatientID").alias("patientid"),
        F.col("AppointmentDate").alias("EncounterDate"), "appointmentid", "AppointmentDate",
        "claimid").hint("merge")
    return fills.join(same_day, ["context_id", "patientid", "EncounterDate"], "left").select(
        *fills.columns, "appointmentid", "AppointmentDate", "claimid")


def distinct_fill_records(joined_fills: DataFrame) -> DataFrame:
    """Key the joined fill records by tenant and keep the distinct ones."""
    # the key is a function of two other columns: added after the shuffle of the distinct
    kept = [c for c in FILL_COLUMNS if c != "unique_patient"]
    return (
        joined_fills.select(*kept).distinct()
        .withColumn("medicationtype", F.col("medicationtype").cast("string"))  # no collation
        .withColumn("unique_patient", tenant_key(F.col("context_id"), F.col("EnterpriseID")))
        .select(*FILL_COLUMNS)
    )


def build_demographics(patient: DataFrame, fills: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Distinct demographic rows (:data:`DEMOGRAPHIC_COLUMNS`) of the patients with fills."""
    c = F.col
    # a row per patient: shuffled, as in build_fills
    keys = fills.select("context_id", "EnterpriseID").distinct().hint("merge")
    rows = (
        patient.join(keys, ["context_id", "EnterpriseID"], "left_semi")
        .withColumns({
            "unique_patient": tenant_key(c("context_id"), c("EnterpriseID")),
            "gender": c("Sex"),
            "ln2": normalize_name(c("LastName")),
            "fn2": normalize_name(c("FirstName")),
            "dob2": fmt_date(c("DOB"), 101),
            "age": age_years(c("DOB"), cfg.as_of),
            "ethnicity": F.coalesce(c("Ethnicity"), F.lit("NA")),
            "race": F.coalesce(c("Race"), F.lit("NA")),
            "maritalstatus": F.coalesce(c("MaritalStatus"), F.lit("NA")),
            "DeceasedDate": unpadded_date(c("DeceasedDate"), "2099-12-31"),
            "city_state": label_join([c("City"), c("state")], " - "),
            "zip": zip5(c("Zip")),
            "emergency_contact_flag": presence_flag(
                c("EmergencyContactRelationship"), "EContact Person", "No EContact"),
        })
        .withColumns({
            "age_cohort": age_band(c("age"), cfg.age_bands),
            "fname_lname_dob": match_key(c("fn2"), c("ln2"), c("dob2")),
        })
        .withColumnRenamed("context_id", "CONTEXT_ID")
    )
    if cfg.drop_incomplete:
        rows = rows.dropna(subset=["FirstName", "LastName", "DOB", "City", "state"])
    return rows.select(*DEMOGRAPHIC_COLUMNS).distinct()
