"""The two batch steps: source tables -> detail, detail -> cumulative by stratum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratafill.config import CohortConfig
from stratafill.operators.cohort import build_demographics, build_fills
from stratafill.operators.features import (
    DETAIL_COUNTS, DISEASE_COUNTS, SUM_NAMES, build_detail, build_surgery, encounter_codes, encounter_features,
    patient_sums)
from stratafill.operators.sequence import FILL_KEYS, GAP_COLUMNS, distinct_fills, fill_timeline
from stratafill.operators.strata import (
    CUT_FEATURES, DEMOGRAPHIC_PARTS, assign_strata, check_one_stratum, feature_cuts, random_id)
from stratafill.operators.threshold import strata_threshold
from stratafill.sources.publishing import has_rows, publish, publish_version
from stratafill.sources.staging import release, stage, stage_counted, staged_since
from stratafill.sources.tables import collated

# the columns of the detail table that the second step reads
COUNTS_USED = ("diagnosiscode_all_total", *SUM_NAMES, *DISEASE_COUNTS)
CORE_COLUMNS = (
    *FILL_KEYS, "ClinicalEncounterID", "age_cohort", "surg_procs_all", *COUNTS_USED)
# those that sums of every kind read
SUM_COLUMNS = (
    "unique_patient", "ClinicalEncounterID", "age_cohort", *DEMOGRAPHIC_PARTS, "surg_procs_all",
    *DETAIL_COUNTS)

# Output columns.
CUMULATIVE_COLUMNS = (
    "unique_patient", "EncounterDate", "ndc", "prescriptionfillquantity", "randGUID",
    "micro_strata", "rowid_encounter", "cumul_prescritionfillqty", "strata_mems",
    "perct80_prescritionfillqty", "met_exceed_threshold", *GAP_COLUMNS)


@dataclass(frozen=True)
class Profile:
    """Rows of a step and the different patients in them, counted while the step was written."""

    rows: int
    patients: int

    @property
    def excess(self) -> int:
        return self.rows - self.patients


@dataclass(frozen=True)
class Result:
    """``profiles`` has the steps fills, detail and cumulative."""

    fills: DataFrame
    detail: DataFrame
    cumulative: DataFrame
    staged: tuple[DataFrame, ...] = ()
    profiles: Mapping[str, Profile] = field(default_factory=dict)

    def release(self) -> None:
        """Remove the staged files; what was not published cannot be read after that."""
        release(*self.staged)


def detail_from_fills(
    fills: DataFrame, tables: Mapping[str, DataFrame], cfg: CohortConfig,
    patients: DataFrame | None = None,
) -> DataFrame:
    """The detail table; ``fills`` is read three times, so pass it staged.

    ``patients`` are the distinct tenants and local ids of the fills, if they are at hand.
    """
    codes = encounter_codes(
        fills, tables["encounter_diagnosis"], tables["encounter_dx_icd10"],
        tables["icd_code_all"], cfg)
    return build_detail(
        build_demographics(tables["patient"], fills if patients is None else patients, cfg),
        fills,
        build_surgery(tables["patient_surgery"], tables["chart"], cfg),
        encounter_features(codes))


def _strata(detail: DataFrame, cfg: CohortConfig) -> tuple[DataFrame, int]:
    """Strata as in :func:`strata_of`, and the number of patients."""
    totals = list(CUT_FEATURES)
    sums, seen = stage_counted(patient_sums(detail, cfg.feature_mode, COUNTS_USED), "sums")
    cuts = cfg.cuts
    if cuts is None:
        cuts = feature_cuts(sums.groupBy("unique_patient").agg(
            *[F.sum(c).alias(c) for c in totals]))
    strata = assign_strata(sums, cuts)
    check_one_stratum(strata)
    return strata, seen["rows"]


def strata_of(detail: DataFrame, cfg: CohortConfig) -> DataFrame:
    """(unique_patient, micro_strata), checked to be one row per patient."""
    return _strata(detail, cfg)[0]


def _cumulative(detail: DataFrame, cfg: CohortConfig) -> tuple[DataFrame, int, Profile]:
    """The cumulative table, the patients of the detail, and the profile of the table."""
    strata, patients = _strata(detail, cfg)
    fills = stage(distinct_fills(detail, cfg.fills_after_year), "distinct_fills")
    # written once: the rows and the thresholds both read it; each patient has one first fill
    timeline, seen = stage_counted(
        fill_timeline(fills, strata), "timeline", patients=F.count_if(F.col("rowid_encounter") == 1))
    flagged = strata_threshold(timeline, cfg.percentile)
    out = flagged.withColumn(
        "randGUID", random_id(F.col("unique_patient"), cfg.id_seed)).select(*CUMULATIVE_COLUMNS)
    return out, patients, Profile(seen["rows"], seen.get("patients", 0))


def cumulative_by_stratum(detail: DataFrame, cfg: CohortConfig) -> DataFrame:
    """One row per distinct fill with :data:`CUMULATIVE_COLUMNS`; pass ``detail`` staged."""
    return _cumulative(detail, cfg)[0]


def cumulative_from_table(
    spark: SparkSession, detail_table: str, cfg: CohortConfig, cumulative_table: str | None = None,
    **layout,
) -> DataFrame:
    """The second step alone, from a published detail table.

    If that is bucketed by ``unique_patient``, its sums and its distinct fills need no shuffle.
    ``cumulative_table`` is published as a version that moves in place once it has all rows.
    """
    out, _, profile = _cumulative(spark.read.table(detail_table), cfg)
    if cumulative_table is None:
        return out
    return publish_version(out, cumulative_table, [has_rows(profile.rows)], **layout)


def run(
    tables: Mapping[str, DataFrame],
    cfg: CohortConfig,
    detail_table: str | None = None,
    cumulative_table: str | None = None,
    detail_partitions: Sequence[str] | None = None,
    cumulative_partitions: Sequence[str] | None = None,
) -> Result:
    """Both steps; a table name publishes that output, otherwise it is staged / returned.

    The partitions are the columns that a published table is partitioned by. With both tables
    published, what was staged is removed, the fills too.
    """
    if cfg.collation:
        tables = collated(tables, cfg.collation)
    with staged_since() as staged:
        fills, of_fills = stage_counted(build_fills(tables, cfg), "fills")
        keys, of_keys = stage_counted(
            fills.select("context_id", "EnterpriseID").distinct(), "patients")
        detail = detail_from_fills(fills, tables, cfg, keys)
        if detail_table:
            seen = Observation()
            detail = publish(detail.observe(seen, F.count(F.lit(1)).alias("rows")), detail_table,
                             partition_by=detail_partitions)
            of_detail = {"rows": 0, **seen.get}
        else:
            detail, of_detail = stage_counted(detail, "detail")
        cumulative, patients, last = _cumulative(detail, cfg)
        if cumulative_table:
            cumulative = publish(cumulative, cumulative_table, partition_by=cumulative_partitions)
    result = Result(fills, detail, cumulative, tuple(staged), {
        "fills": Profile(of_fills["rows"], of_keys["rows"]),
        "detail": Profile(of_detail["rows"], patients), "cumulative": last})
    if detail_table and cumulative_table:
        result.release()
    return result
