"""Appointments, claims and transactions of the cohort's patients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafill.functions.dates import after_year
from stratafill.functions.predicates import column_in_columns
from stratafill.functions.text import tenant_key
from stratafill.operators.joins import join_reduced, join_within

PATIENT = ("context_id", "patientid")

# Output columns.
LINK_COLUMNS = (
    "context_id", "patientid", "appointmentid", "AppointmentDate", "claimid",
    "renderingproviderid")
CLAIM_COLUMNS = (
    "context_id", "patientid", "unique_patient", "claimid", "renderingproviderid",
    "claimappointmentid", "servicedepartmentid")


def _claims(claims: DataFrame, *more: str) -> DataFrame:
    return claims.select(
        *PATIENT, "claimid", "originalclaimid", "renderingproviderid", *more)


def _appointments(appointments: DataFrame, *more: str) -> DataFrame:
    return appointments.select(
        *PATIENT, "appointmentid", "AppointmentDate", F.col("claimid").alias("_booked"), *more)


def _same_claim() -> Column:
    """The appointment names the claim, or the claim that it replaced."""
    return column_in_columns(F.col("_booked"), [F.col("claimid"), F.col("originalclaimid")])


def link_appointments(
    appointments: DataFrame, claims: DataFrame, fills: DataFrame, after: int = 2017,
    per_document: bool = True,
) -> DataFrame:
    """Appointments after the year ``after`` with their claims, for patients with fills.

    A claim belongs to an appointment of its tenant and patient that it names, if that names the
    claim or its original. With ``per_document`` a link comes once for each document number of
    the patient's fills, as in the source; otherwise once. Null keys link nothing.
    """
    booked = _appointments(appointments).where(after_year(F.col("AppointmentDate"), after))
    linked = booked.join(
        _claims(claims, F.col("claimappointmentid").alias("appointmentid")).hint("merge"),
        [*PATIENT, "appointmentid"]).where(_same_claim())
    wanted = fills.select(*PATIENT, *["documentid"] * per_document).distinct()
    kept = join_reduced(linked, wanted, list(PATIENT), "inner" if per_document else "left_semi")
    return kept.select(*LINK_COLUMNS)


def link_claims_within(
    appointments: DataFrame, claims: DataFrame, *, before: int = 0, after: int = 30,
) -> DataFrame:
    """Links as in :func:`link_appointments` for claims that name no appointment.

    The claim is of the same tenant and patient, and its ``ChargeFromDate`` is on one of the days
    from ``before`` days before the appointment to ``after`` days after it.
    """
    day = F.col("AppointmentDate").cast("date")
    spans = _appointments(
        appointments, F.date_sub(day, before).alias("_from"), F.date_add(day, after).alias("_to"))
    charged = _claims(claims, "ChargeFromDate").withColumn(
        "_charged", F.col("ChargeFromDate").cast("date"))
    linked = join_within(charged, spans, PATIENT, "_charged", "_from", "_to", before + after + 1)
    return linked.where(_same_claim()).select(*LINK_COLUMNS, "ChargeFromDate")


def appointment_records(
    appointments: DataFrame, records: DataFrame, claims: DataFrame, documents: DataFrame, *,
    since: str, until: str | None = None, tenants: Sequence[str] | None = None,
) -> DataFrame:
    """Appointments from ``since`` to ``until`` (None: now) with claims, fill records, documents.

    Rows are one per link of an appointment to a claim, fill record of the patient with a chart,
    and document of that chart.
    """
    to = F.current_timestamp() if until is None else F.lit(until).cast("timestamp")
    at = F.col("AppointmentDate").cast("timestamp")
    booked = _appointments(appointments).where(at.between(F.lit(since).cast("timestamp"), to))
    if tenants is not None:
        booked = booked.where(F.col("context_id").isin(*tenants))
    linked = booked.join(
        _claims(claims, F.col("claimappointmentid").alias("appointmentid")).hint("merge"),
        [*PATIENT, "appointmentid"]).where(_same_claim()).select(*LINK_COLUMNS)
    charted = records.where(F.col("ChartID").isNotNull()).select(
        *PATIENT, "ChartID", F.col("documentid").alias("recordid"))
    # all grow with the data: shuffled, never sent through the driver
    filed = charted.join(
        documents.select(*PATIENT, "ChartID", "documentid").hint("merge"), [*PATIENT, "ChartID"])
    return linked.join(filed.hint("merge"), list(PATIENT)).select(
        *LINK_COLUMNS, "recordid", "ChartID", "documentid")


def claims_by_transactions(
    claims: DataFrame, transactions: DataFrame, after: int = 2016
) -> DataFrame:
    """Claims with the date of each of their transactions after the year ``after``.

    A claim comes once per transaction, as in the source.
    """
    dated = transactions.where(after_year(F.col("ChargeFromDate"), after))
    return _keyed(claims).join(
        dated.select("context_id", "claimid", "ChargeFromDate"), ["context_id", "claimid"]
    ).select(*CLAIM_COLUMNS, "ChargeFromDate")


def _keyed(claims: DataFrame) -> DataFrame:
    return claims.withColumn(
        "unique_patient", tenant_key(F.col("context_id"), F.col("patientid"))
    ).select(*CLAIM_COLUMNS)


def transactions_in_fill_years(transactions: DataFrame, fills: DataFrame) -> DataFrame:
    """Transactions of the years in which the cohort has fills.

    ``transactions`` are partitioned by ``charge_year``; only the partitions of those years are
    read, which is known when the query runs.
    """
    # Spark prunes by a side that has a comparison, which "is not null" is none of
    years = fills.select(F.year("EncounterDate").alias("charge_year")).where(
        "charge_year > 0").distinct()
    # a row per year
    return transactions.join(F.broadcast(years), "charge_year", "left_semi")


def claims_in_fill_years(
    claims: DataFrame, transactions: DataFrame, fills: DataFrame
) -> DataFrame:
    """Claims with transactions as in :func:`transactions_in_fill_years`, once each."""
    wanted = transactions_in_fill_years(transactions, fills).select(
        "context_id", "claimid").distinct()
    return join_reduced(_keyed(claims), wanted, ["context_id", "claimid"], "left_semi")
