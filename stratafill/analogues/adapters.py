"""Driver tables in the shape of the source tables.

customer -> patient and chart, orders -> encounter, line item -> fill record and diagnosis,
part -> drug and diagnosis code, purchase event -> surgery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafill.analogues.codes import CODES
from stratafill.config import CohortConfig
from stratafill.operators.cohort import build_fills
from stratafill.operators.features import build_surgery, encounter_codes
from stratafill.plans.workflow import detail_from_fills
from stratafill.sources.staging import stage
from stratafill.sources.tables import Tables

c = F.col

CFG = CohortConfig(
    fills_after_year=1996,
    medication_types=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"),
    excluded_classes=("PROMO",),
    excluded_names=("red anvil", "old ring", "hot gizmo"),
    drug_words={
        "HIC3Description": ("promo", "standard"),
        "MedicationName": ("anvil", "widget", "red b", "cold r", "new g"),
    },
    surgery_years=(2023, 2024),
    id_seed="example",
)


def code_of(number: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(x) for x in CODES]), (number % len(CODES) + 1).cast("int"))


def tenant_orders(t: Tables) -> DataFrame:
    """Orders with their customer's nation, which is the tenant everywhere.

    Customers grow with the orders, so they are shuffled and never sent through the driver.
    """
    people = t["customer"].select(
        "c_custkey", c("c_nationkey").cast("string").alias("context_id")).hint("merge")
    return t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(
        people, c("o_custkey") == c("c_custkey")).drop("c_custkey")


def tenant_lines(t: Tables) -> DataFrame:
    """Line items with tenant and order; (order, part, supplier) numbers the document."""
    return t["lineitem"].join(
        tenant_orders(t).hint("merge"), c("l_orderkey") == c("o_orderkey")).withColumn(
        "documentid", (c("l_orderkey") * 1_000_000 + c("l_partkey")) * 10_000 + c("l_suppkey"))


def source_tables(t: Tables) -> dict[str, DataFrame]:
    """The ten source tables, each with the tenant that the source has on it."""
    return {
        "patient_medication": tenant_lines(t).select(
            "context_id", "documentid", c("o_orderpriority").alias("medicationtype"),
            F.when(c("l_returnflag") == "R", c("l_shipdate")).alias("DeletedDatetime"),
            F.nullif(c("l_quantity"), F.lit(50.0)).alias("prescriptionfillquantity"),
            F.nullif(c("l_linenumber"), F.lit(1)).cast("bigint")
            .alias("numberofrefillsprescribed")),
        "document": tenant_lines(t).select(
            "context_id", "documentid", c("o_custkey").alias("patientid"),
            c("l_orderkey").alias("ClinicalEncounterID"), c("o_custkey").alias("ChartID"),
            c("l_partkey").alias("FBDMedID")),
        "clinicalencounter": tenant_orders(t).select(
            "context_id", c("o_orderkey").alias("ClinicalEncounterID"),
            c("o_orderdate").alias("EncounterDate")),
        "chart": t["customer"].select(
            c("c_nationkey").cast("string").alias("context_id"),
            c("c_custkey").alias("ChartID"), c("c_custkey").alias("EnterpriseID")),
        "medication": t["part"].select(  # the 25 nations share one catalog
            F.explode(F.array(*[F.lit(str(n)) for n in range(25)])).alias("context_id"),
            c("p_partkey").alias("FDBMedID"), c("p_partkey").cast("string").alias("ndc"),
            c("p_name").alias("MedicationName"), c("p_type").alias("HIC3Description")),
        "patient": patient(t),
        "patient_surgery": t["events"].where(c("event_type") == "purchase").join(
            t["customer"].hint("merge"), c("user_id") == c("c_custkey")).select(
            c("c_nationkey").cast("string").alias("context_id"),
            c("user_id").alias("ChartID"), c("ts").alias("surgerydatetime"),
            F.when(c("value") >= 8, c("props")).alias("Procedure"),
            F.when(c("value") >= 4, c("event_type")).alias("Note")),
        "encounter_diagnosis": tenant_orders(t).select(
            "context_id", c("o_orderkey").alias("ClinicalEncounterID"),
            c("o_orderkey").alias("ClinicalEncounterDXID")),
        "encounter_dx_icd10": t["lineitem"].select(
            c("l_orderkey").alias("ClinicalEncounterDXID"), c("l_partkey").alias("IcdCodeID")),
        "icd_code_all": t["part"].select(
            c("p_partkey").alias("IcdCodeID"),
            code_of(c("p_partkey")).alias("DiagnosisCode"),
            F.when(c("p_size") == 50, "ICD9").otherwise("ICD10").alias("DiagnosisCodeSet")),
    }


def fills(t: Tables, cfg: CohortConfig = CFG) -> DataFrame:
    return build_fills(source_tables(t), cfg)


def appointments(t: Tables) -> DataFrame:
    """Shipments as appointments of the order's customer."""
    return tenant_lines(t).select(
        "context_id", c("o_custkey").alias("PatientID"), c("l_shipdate").alias("AppointmentDate"),
        c("l_orderkey").alias("appointmentid"), c("l_partkey").alias("claimid"))


def claims(t: Tables) -> DataFrame:
    """Line items as claims on their shipment; those with an odd number replaced another claim."""
    odd = c("l_linenumber") % 2
    return tenant_lines(t).select(
        "context_id", c("o_custkey").alias("patientid"), (c("l_partkey") + odd).alias("claimid"),
        F.when(odd == 1, c("l_partkey")).alias("originalclaimid"),
        c("l_suppkey").alias("renderingproviderid"), c("l_orderkey").alias("claimappointmentid"),
        c("l_linenumber").alias("servicedepartmentid"),
        F.date_add(c("l_shipdate").cast("date"), (c("l_suppkey") % 45).cast("int"))
        .alias("ChargeFromDate"))


def transactions(t: Tables) -> DataFrame:
    """A charge per line item on its claim, by the year of the charge."""
    return claims(t).select(
        "context_id", "claimid", "ChargeFromDate",
        F.year("ChargeFromDate").alias("charge_year"))


def patient_appointments(t: Tables) -> DataFrame:
    return appointments(t).withColumnRenamed("PatientID", "patientid")


def birth_dates(t: Tables) -> DataFrame:
    """(c_custkey, dob): the first order, moved back by 0 to 69 years."""
    return (
        t["orders"].groupBy(c("o_custkey").alias("c_custkey"))
        .agg(F.min("o_orderdate").alias("first_order"))
        .select("c_custkey", F.add_months(
            c("first_order").cast("date"), (c("c_custkey") % 70 * -12).cast("int")).alias("dob"))
    )


def patient(t: Tables) -> DataFrame:
    places = t["nation"].join(t["region"], c("n_regionkey") == c("r_regionkey"))
    segment = c("c_mktsegment")
    return (
        t["customer"]
        .join(birth_dates(t).hint("merge"), "c_custkey", "left")
        .join(places, c("c_nationkey") == c("n_nationkey"))
        .select(
            c("c_nationkey").cast("string").alias("context_id"),
            c("c_custkey").alias("EnterpriseID"),
            c("c_name").alias("FirstName"),
            F.concat(F.lit(" "), F.lower(segment), F.lit("-x ")).alias("LastName"),
            F.when(c("c_acctbal") < 3000, "F").otherwise("M").alias("Sex"),
            c("dob").alias("DOB"),
            F.nullif(segment, F.lit("BUILDING")).alias("Ethnicity"),
            F.nullif(c("r_name"), F.lit("ASIA")).alias("Race"),
            F.nullif(segment, F.lit("FURNITURE")).alias("MaritalStatus"),
            F.when(c("c_acctbal") < 0, c("dob")).alias("DeceasedDate"),
            c("n_name").alias("City"),
            F.nullif(c("r_name"), F.lit("EUROPE")).alias("state"),
            F.nullif(F.concat(F.substring("c_name", 14, 5), F.lit("-"), c("c_nationkey")),
                     F.lit("00007-1")).alias("Zip"),
            F.nullif(segment, F.lit("MACHINERY")).alias("EmergencyContactRelationship"),
        )
    )


def surgery(t: Tables, cfg: CohortConfig = CFG) -> DataFrame:
    tables = source_tables(t)
    return build_surgery(tables["patient_surgery"], tables["chart"], cfg)


def codes(fill_rows: DataFrame, t: Tables, cfg: CohortConfig = CFG):
    """Diagnosis codes of the encounters: order -> its line items -> their parts' codes."""
    tables = source_tables(t)
    return encounter_codes(fill_rows, tables["encounter_diagnosis"],
                           tables["encounter_dx_icd10"], tables["icd_code_all"], cfg)


def detail(t: Tables, cfg: CohortConfig = CFG) -> DataFrame:
    return detail_from_fills(stage(fills(t, cfg), "fills"), source_tables(t), cfg)


def customer_events(t: Tables) -> DataFrame:
    """Customers and what they did: a row per event, or one for a customer without an event.

    An inner join, which can spread the events of one user over tasks, and the customers that an
    anti-join leaves.
    """
    events = t["events"].select("event_id", "user_id", "event_type", "value", "props")
    people = t["customer"].select("c_custkey")
    same = c("c_custkey") == c("user_id")
    idle = people.join(events.select("user_id").distinct(), same, "left_anti")
    return people.join(events, same).drop("user_id").unionByName(
        idle, allowMissingColumns=True)


def order_fills(t: Tables) -> DataFrame:
    """Every line item as a fill of its order's customer."""
    return t["lineitem"].join(
        t["orders"], c("l_orderkey") == c("o_orderkey")
    ).select(
        c("o_custkey").cast("string").alias("unique_patient"),
        c("o_orderdate").alias("EncounterDate"),
        c("l_partkey").cast("string").alias("ndc"),
        c("l_quantity").alias("prescriptionfillquantity"),
        c("o_orderkey").alias("ClinicalEncounterID"))


def segments(t: Tables) -> DataFrame:
    """A first, coarse stratum: the customer's market segment."""
    return t["customer"].select(
        c("c_custkey").cast("string").alias("unique_patient"),
        c("c_mktsegment").alias("micro_strata"))
