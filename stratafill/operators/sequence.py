"""Fills in sequence: number, running quantity, days to the next fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafill.functions.dates import after_year, days_between
from stratafill.functions.text import fill_tiebreaker
from stratafill.operators.ordered import ordered_scan
from stratafill.sources.staging import stage

KEY = "unique_patient"
FILL_KEYS = (KEY, "EncounterDate", "ndc", "prescriptionfillquantity")
# text order of the tiebreaker first; the raw columns settle equal texts
FILL_ORDER = ("tiebreaker", "EncounterDate", "ndc", "prescriptionfillquantity")
GAP_COLUMNS = ("lag_filldate", "current_filldate", "filldatediff", "cumul_filldatediff")
_RUNNING = {"cumul_prescritionfillqty": "prescriptionfillquantity"}

# corrected spellings for callers who want them
CLEAR_NAMES = {
    "cumul_prescritionfillqty": "cumul_prescriptionfillqty",
    "perct80_prescritionfillqty": "perct80_prescriptionfillqty",
}


def distinct_fills(detail: DataFrame, after: int | None = None) -> DataFrame:
    """Distinct (patient, date, ndc, quantity), with the text that orders them."""
    if after is not None:
        detail = detail.where(after_year(F.col("EncounterDate"), after))
    return detail.select(*FILL_KEYS).distinct().withColumn(
        "tiebreaker", fill_tiebreaker(*[F.col(c) for c in FILL_KEYS[1:]]))


def fill_sequence(fills: DataFrame) -> DataFrame:
    """Number each patient's distinct fills from 1 (``rowid_encounter``)."""
    return ordered_scan(fills, KEY, FILL_ORDER, number="rowid_encounter")


def fill_cumulative(fills: DataFrame, strata: DataFrame | None = None) -> DataFrame:
    """Number the fills and accumulate the quantity; ``strata`` adds the patient's stratum."""
    return ordered_scan(
        fills, KEY, FILL_ORDER, number="rowid_encounter", sums=_RUNNING, per_key=strata)


def _gaps(scanned: DataFrame) -> DataFrame:
    """A fill's gap runs to the next fill; the last fill's is 0 and repeats its date.

    Gaps of consecutive rows telescope, so the running gap is measured from the first fill.
    """
    current = F.coalesce(F.col("_next"), F.col("EncounterDate"))
    return scanned.withColumns({
        "lag_filldate": F.col("EncounterDate"),
        "current_filldate": current,
        "filldatediff": days_between(F.col("EncounterDate"), current),
        "cumul_filldatediff": days_between(F.col("_first"), current),
    }).drop("_next", "_first")


def fill_gaps(sequence: DataFrame) -> DataFrame:
    """Append :data:`GAP_COLUMNS` to numbered fills."""
    return _gaps(ordered_scan(
        sequence, KEY, ["rowid_encounter"],
        nexts={"_next": "EncounterDate"}, firsts={"_first": "EncounterDate"}))


def fill_timeline(fills: DataFrame, strata: DataFrame | None = None) -> DataFrame:
    """:func:`fill_cumulative` and :func:`fill_gaps` in one pass over the same windows."""
    return _gaps(ordered_scan(
        fills, KEY, FILL_ORDER, number="rowid_encounter", sums=_RUNNING,
        nexts={"_next": "EncounterDate"}, firsts={"_first": "EncounterDate"},
        per_key=strata))


# --- the same gaps by self-join, for comparison --------------------------------------------


def raw_gaps(sequence: DataFrame) -> DataFrame:
    """Gaps between rows with adjacent numbers; a patient's last fill has none."""
    a = sequence.select(KEY, "rowid_encounter", F.col("EncounterDate").alias("lag_filldate"))
    b = sequence.select(
        KEY, (F.col("rowid_encounter") - 1).alias("rowid_encounter"),
        F.col("EncounterDate").alias("current_filldate"))
    # the days follow from the dates: added after the distinct
    pairs = a.join(b, [KEY, "rowid_encounter"]).select(
        KEY, "lag_filldate", "current_filldate", "rowid_encounter").distinct()
    return pairs.select(
        KEY, "lag_filldate", "current_filldate",
        days_between(F.col("lag_filldate"), F.col("current_filldate")).alias("filldatediff"),
        "rowid_encounter")


def last_fills(sequence: DataFrame, gaps: DataFrame) -> DataFrame:
    """Rows of the sequence without a gap, by both key columns."""
    return sequence.join(gaps, [KEY, "rowid_encounter"], "left_anti")


def gap_reference_form(sequence: DataFrame) -> DataFrame:
    """Self-join, anti-join, union and running sum; equals :func:`fill_gaps`."""
    gaps = stage(raw_gaps(sequence), "raw_gaps")
    # a row per patient, written: to find its ranges the scan reads its rows once before
    last = stage(last_fills(sequence, gaps).select(
        KEY, F.col("EncounterDate").alias("lag_filldate"),
        F.col("EncounterDate").alias("current_filldate"),
        F.lit(0).cast("bigint").alias("filldatediff"), "rowid_encounter"), "last_fills")
    return ordered_scan(
        gaps.unionByName(last), KEY, ["rowid_encounter"],
        sums={"cumul_filldatediff": "filldatediff"})
