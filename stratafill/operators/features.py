"""Surgery and diagnosis features, the detail table, and sums per patient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafill.config import CohortConfig
from stratafill.functions.buckets import uniqueness_label
from stratafill.functions.dates import years_between
from stratafill.functions.predicates import in_list
from stratafill.functions.rules import DEPRESSION, DISEASE, ONCOLOGY, PAIN
from stratafill.functions.text import first_present, tenant_key
from stratafill.operators.cohort import DEMOGRAPHIC_COLUMNS
from stratafill.operators.joins import join_reduced

# Output column -> label counted, in output order.
GROSS_COUNTS = ("diagnosiscode_all_total", "oncology_visits", "pain_visits", "depression_visits")
DEPRESSION_COUNTS = {
    "depression_single_episode_visits": "Major depressive disorder, single episode",
    "depression_recurrent_visits": "Major depressive disorder, recurrent",
}
PAIN_COUNTS = {
    "unspecified_pain_visits": "pain, unspecified",
    "nec_pain_visits": "acute and chronic pain, not elsewhere classified",
    "abdomen_pain_visits": "abdomen pain",
    "back_pain_visits": "back pain",
    "kidney_stones_visits": "kidney stones",
    "ankle_foot_visits": "ankle/foot injuries",
    "breast_pain_visits": "breast pain",
    "chest_pain_visits": "chest pain",
    "ear_pain_visits": "ear pain",
    "eye_pain_visits": "eye pain",
    "headache_visits": "headache",
    "migrane_visits": "migrane",
    "joint_pain_visits": "joint pain",
    "limb_pain_visits": "limb pain",
    "pelvic_perineal_visits": "pelvic and perineal pain",
    "shoulder_pain_visits": "shoulder pain",
    "spine_pain_visits": "spine pain",
    "throat_pain_visits": "throat pain",
    "tongue_pain_visits": "tongue pain",
    "tooth_pain_visits": "tooth pain",
    "renal_colic_visits": "renal colic",
    "psych_pain_visits": "pain disorders exclusively related to psychological factors",
}
DISEASE_COUNTS = {
    "diabetes_visits": "diabetes",
    "hf_visits": "hf",
    "ischemic_hd_visits": "ischemic hd",
    "kidney_disease_visits": "kidney disease",
    "osteoporosis_visits": "osteoporosis",
    "copd_visits": "copd",
    "stroke_visits": "stroke",
}
DETAIL_NAMES = {  # names that change in the detail table
    "kidney_stones_visits": "kidney_stone_pain_visits",
    "ankle_foot_visits": "ankle_foot_pain_visits",
}
DETAIL_FILL_COLUMNS = (
    "documentid", "EncounterDate", "medicationtype", "ndc", "FBDMedID",
    "prescriptionfillquantity", "numberofrefillsprescribed", "ChartID", "ClinicalEncounterID")
SURGERY_COUNTS = ("surg_procs_all", "surg_procs_distinct")
SURGERY_LABEL = "surgery_uniqueness_ratio"

FEATURE_COUNTS = (*GROSS_COUNTS, *DEPRESSION_COUNTS, *PAIN_COUNTS, *DISEASE_COUNTS)
DETAIL_COUNTS = tuple(DETAIL_NAMES.get(n, n) for n in FEATURE_COUNTS)
DETAIL_COLUMNS = (
    *DEMOGRAPHIC_COLUMNS, *DETAIL_FILL_COLUMNS, *SURGERY_COUNTS, SURGERY_LABEL, *DETAIL_COUNTS)


def build_surgery(surgery: DataFrame, chart: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Per patient: surgeries, different surgeries, and how the two compare."""
    procedures = (
        surgery.where(years_between(F.col("surgerydatetime"), *cfg.surgery_years))
        # charts grow with the data: shuffled, as in build_fills
        .join(chart.select("context_id", "ChartID", "EnterpriseID").hint("merge"),
              ["context_id", "ChartID"])
        .select(
            tenant_key(F.col("context_id"), F.col("EnterpriseID")).alias("unique_patient"),
            first_present(F.col("Procedure"), F.col("Note")).alias("procedure"))
    )
    return procedures.groupBy("unique_patient").agg(
        F.count("procedure").alias("surg_procs_all"),
        F.count_distinct("procedure").alias("surg_procs_distinct"),
    ).withColumn(
        SURGERY_LABEL, uniqueness_label(F.col("surg_procs_all"), F.col("surg_procs_distinct")))


ENCOUNTER = ("context_id", "EnterpriseID", "ClinicalEncounterID")

# rule numbers of a code, see RuleSet.number
RULE_COLUMNS = {
    "oncology_rule": ONCOLOGY,
    "pain_rule": PAIN,
    "depression_rule": DEPRESSION,
    "disease_rule": DISEASE,
}


def number_rules(codes: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Append the number of the rule that each rule set applies to the code."""
    code = F.col("DiagnosisCode")
    return codes.withColumns({
        # the exact oncology codes are written with dots
        name: rules.number(code, cfg.strip_dots and rules is not ONCOLOGY)
        for name, rules in RULE_COLUMNS.items()})


def encounter_codes(
    fills: DataFrame,
    diagnosis: DataFrame,
    dx_icd: DataFrame,
    icd_codes: DataFrame,
    cfg: CohortConfig,
) -> DataFrame:
    """Distinct diagnosis codes of each encounter that has fills, with :data:`RULE_COLUMNS`.

    The fills shrink to their distinct encounters before they meet the diagnoses, and the rules
    run once per code of the code table, after the codes of an encounter are distinct. The code
    table has a row per tenant and code, so it is shuffled; its distinct codes may be broadcast.
    """
    encounters = fills.select(*ENCOUNTER).distinct()
    codes = icd_codes.where(in_list(F.col("DiagnosisCodeSet"), cfg.code_sets, cfg.collation))
    rules = number_rules(codes.select(F.col("DiagnosisCode")).distinct(), cfg)
    dx_on, code_on = ["ClinicalEncounterDXID"], ["IcdCodeID"]
    if cfg.tenant_safe:
        dx_on += [c for c in ("context_id",) if c in dx_icd.columns]
        code_on += [c for c in ("context_id",) if c in dx_icd.columns and c in codes.columns]
    on = ["context_id", "ClinicalEncounterID"]
    return (
        encounters.join(diagnosis.select(*on, "ClinicalEncounterDXID").hint("merge"), on)
        .join(dx_icd.select(*dx_on, "IcdCodeID").hint("merge"), dx_on)
        .join(codes.select(*code_on, F.col("DiagnosisCode").alias("_code")).hint("merge"), code_on)
        .select(*ENCOUNTER, "_code").distinct()
        .join(rules, F.col("_code").eqNullSafe(F.col("DiagnosisCode")))
        .withColumn("unique_patient", tenant_key(F.col("context_id"), F.col("EnterpriseID")))
        .select(*ENCOUNTER, "DiagnosisCode", *RULE_COLUMNS, "unique_patient")
    )


def flag_counts(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Per group and output: the number of rows whose condition holds."""
    return df.groupBy(*keys).agg(*[F.count_if(cond).alias(out) for out, cond in flags.items()])


def encounter_features(codes: DataFrame) -> DataFrame:
    """35 diagnosis counts per (patient, encounter) from :func:`encounter_codes`."""
    flags = {
        "diagnosiscode_all_total": F.col("DiagnosisCode").isNotNull(),
        "oncology_visits": F.col("oncology_rule") != 0,
        "pain_visits": F.col("pain_rule") != 0,
        "depression_visits": F.col("depression_rule") != 0,
    }
    for column, counts in (
        ("depression_rule", DEPRESSION_COUNTS),
        ("pain_rule", PAIN_COUNTS),
        ("disease_rule", DISEASE_COUNTS),
    ):
        rules = RULE_COLUMNS[column]
        flags |= {
            out: F.col(column) == rules.number_of(label)
            for out, label in counts.items()}
    # the key is text made of two of these columns: added after the shuffle
    counts = flag_counts(codes, ENCOUNTER, flags)
    return counts.select(
        tenant_key(F.col("context_id"), F.col("EnterpriseID")).alias("unique_patient"),
        "ClinicalEncounterID", *flags)


def build_detail(
    demographics: DataFrame, fills: DataFrame, surgery: DataFrame, dx: DataFrame
) -> DataFrame:
    """One row per fill record and demographic row of its patient (:data:`DETAIL_COLUMNS`).

    The people are written first, so that a patient with very many fills is split.
    """
    people = demographics.join(surgery.hint("merge"), "unique_patient", "left")
    quantity = F.col("prescriptionfillquantity")
    recorded = fills.select("unique_patient", *DETAIL_FILL_COLUMNS).join(
        dx.hint("merge"), ["unique_patient", "ClinicalEncounterID"], "left")
    return (
        join_reduced(recorded, people, "unique_patient")
        .withColumnsRenamed(DETAIL_NAMES)
        .fillna(0, subset=["numberofrefillsprescribed", *SURGERY_COUNTS, *DETAIL_COUNTS])
        .fillna("no surgery", subset=[SURGERY_LABEL])
        # not by fillna, which would turn NaN into 0 too
        .withColumn("prescriptionfillquantity", F.coalesce(
            quantity, F.lit(0).cast(fills.schema["prescriptionfillquantity"].dataType)))
        .select(*DETAIL_COLUMNS)
    )


# Sums per patient take these columns; the others of DETAIL_COUNTS keep their own name.
SUM_NAMES = {
    "oncology_visits": "oncology_visits_total",
    "pain_visits": "pain_visits_total",
    "depression_visits": "depression_visits_total",
}


def _sums(detail: DataFrame, keys: Sequence[str], mode: str, plain, counts) -> DataFrame:
    """``plain`` aggregates over the rows, sums of ``counts`` over the rows or encounters."""
    if mode == "dedup":
        per_encounter = detail.groupBy(*keys, "ClinicalEncounterID").agg(
            *[first(n).alias(n) for n, (first, _) in plain.items()],
            *[F.max(n).alias(n) for n in counts])
        grouped = per_encounter.groupBy(*keys)
        first_of = {n: again for n, (_, again) in plain.items()}
    elif mode == "reference":
        grouped = detail.groupBy(*keys)
        first_of = {n: once for n, (once, _) in plain.items()}
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return grouped.agg(
        *[f(n).alias(n) for n, f in first_of.items()],
        *[F.sum(n).alias(SUM_NAMES.get(n, n)) for n in counts])


def patient_totals(detail: DataFrame, mode: str = "reference") -> DataFrame:
    """Quantity, first fill and the gross diagnosis counts per patient."""
    counts = ("oncology_visits", "pain_visits", "depression_visits", "diagnosiscode_all_total")
    plain = {"prescriptionfillquantity": (F.sum, F.sum), "EncounterDate": (F.min, F.min)}
    return _sums(detail, ["unique_patient"], mode, plain, counts).withColumnsRenamed({
        "prescriptionfillquantity": "total_opioid_prescribed", "EncounterDate": "min_filldate"})


def patient_sums(
    detail: DataFrame, mode: str = "reference", counts: Sequence[str] = DETAIL_COUNTS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Surgeries and ``counts`` (all 35) summed per (patient, age band) and the columns ``by``."""
    surgery = {"surg_procs_all": (F.sum, F.sum) if mode == "reference" else (F.max, F.max)}
    return _sums(detail, ["unique_patient", "age_cohort", *by], mode, surgery, counts)
