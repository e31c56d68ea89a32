"""Median cut points and the micro-stratum of each patient."""

from __future__ import annotations

import secrets
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafill.functions.buckets import (
    chronic_bucket, median_bucket, micro_stratum, surgery_bucket)
from stratafill.operators.features import DISEASE_COUNTS
from stratafill.operators.ordered import ordered_scan
from stratafill.operators.quantiles import upper_median
from stratafill.sources.staging import stage

# Total column -> short name in the stratum label, in label order.
CUT_FEATURES = {
    "diagnosiscode_all_total": "dx",
    "oncology_visits_total": "onc",
    "pain_visits_total": "pain",
    "depression_visits_total": "depress",
}


def feature_medians(totals: DataFrame, columns: Sequence[str] = tuple(CUT_FEATURES)) -> DataFrame:
    """(feature, cut): the upper median of each column's positive values, in one pass."""
    long = totals.unpivot([], list(columns), "feature", "value").where(F.col("value") > 0)
    return upper_median(long, ["feature"], "value").withColumn("cut", F.col("cut").cast("bigint"))


def feature_cuts(totals: DataFrame, columns: Sequence[str] = tuple(CUT_FEATURES)) -> dict:
    """The medians as numbers, one per column (0 where no value is positive)."""
    found = {r["feature"]: r["cut"] for r in feature_medians(totals, columns).collect()}
    return {c: found.get(c, 0) for c in columns}


def stratum_parts(cuts: Mapping[str, object]) -> list[Column]:
    """The seven parts of the label over the sums per (patient, age band)."""
    return [
        F.col("age_cohort"),
        chronic_bucket([F.col(c) for c in DISEASE_COUNTS]),
        surgery_bucket(F.col("surg_procs_all")),
        *[median_bucket(F.col(c), cuts[c], name) for c, name in CUT_FEATURES.items()],
    ]


# Disease count -> name, and finer count -> (name, cut), of the optional parts.
DISEASE_PARTS = {
    "diabetes_visits": "diabetic",
    "hf_visits": "hf",
    "ischemic_hd_visits": "ischemic hd",
    "kidney_disease_visits": "kidney disease",
    "osteoporosis_visits": "osteo",
    "copd_visits": "copd",
    "stroke_visits": "stroke",
}
DEMOGRAPHIC_PARTS = ("gender", "race", "maritalstatus", "emergency_contact_flag", "CONTEXT_ID")
PAIN_PART_CUTS = {
    "oncology_visits_total": ("onc", 11),
    "depression_single_episode_visits": ("dep single", 10),
    "depression_recurrent_visits": ("dep rec", 11),
    "unspecified_pain_visits": ("unspec pain", 12),
    "back_pain_visits": ("back pain", 9),
    "kidney_stone_pain_visits": ("kidney stone pain", 11),
    "ankle_foot_pain_visits": ("ankle pain", 7),
    "nec_pain_visits": ("nec pain", 10),
    "abdomen_pain_visits": ("abd pain", 9),
    "headache_visits": ("headache", 6),
    "spine_pain_visits": ("spine pain", 10),
    "breast_pain_visits": ("breast pain", 6),
    "chest_pain_visits": ("chest pain", 12),
    "ear_pain_visits": ("ear pain", 6),
    "eye_pain_visits": ("eye pain", 6),
    "joint_pain_visits": ("joint pain", 9),
    "limb_pain_visits": ("limb pain", 8),
    "throat_pain_visits": ("throat pain", 9),
    "tongue_pain_visits": ("tongue pain", 6),
    "tooth_pain_visits": ("tooth pain", 5),
    "renal_colic_visits": ("renal colic", 9),
}


def disease_parts() -> list[Column]:
    """Optional parts: a disease counts from its second visit on; one visit leaves it open."""
    return [
        F.when(F.col(n).isNull() | (F.col(n) == 0), F.lit(f"not {name}"))
        .when(F.col(n) > 1, F.lit(name))
        for n, name in DISEASE_PARTS.items()]


def demographic_parts(columns: Sequence[str] = DEMOGRAPHIC_PARTS) -> list[Column]:
    """Optional parts: columns of the patient, which the sums must be grouped by as well."""
    return [F.col(c).cast("string") for c in columns]


def pain_parts(cuts: Mapping[str, tuple[str, int]]) -> list[Column]:
    """Optional parts: one bucket per finer count."""
    return [median_bucket(F.col(n), cut, name) for n, (name, cut) in cuts.items()]


def assign_strata(
    sums: DataFrame, cuts: Mapping[str, object], parts: Sequence[Column] | None = None
) -> DataFrame:
    """(unique_patient, micro_strata) from the sums per (patient, age band).

    Patients in one age band have one row; the sums are already one row per patient and band,
    so equal rows cannot arise and no further distinct is needed.
    """
    label = micro_stratum(parts if parts is not None else stratum_parts(cuts))
    return sums.select("unique_patient", label.alias("micro_strata"))


def check_one_stratum(strata: DataFrame) -> None:
    """Refuse strata in which a patient appears twice: each fill would be counted twice."""
    if not strata.groupBy("unique_patient").count().where(F.col("count") > 1).isEmpty():
        raise ValueError("a patient has several strata; keep one demographic row per patient")


def random_id(key: Column, seed: str | None) -> Column:
    """An id in random order over the keys.

    Without a seed one is drawn for each call. With one the id is the same on every run, and
    whoever has the seed and a key can compute it; so the seed is a secret of the caller.
    """
    seed = secrets.token_hex(32) if seed is None else seed
    return F.sha2(F.concat_ws("|", F.lit(seed), key), 256)


def in_random_order(patients: DataFrame, seed: str | None = None) -> DataFrame:
    """The distinct patients with randGUID and random_order, 1 to n over all of them by randGUID.

    Patients are dealt to ranges of the id and numbered in each; the ranges' sizes give the rest,
    so no task holds them all. With a seed (see :func:`random_id`) the numbers are the same on
    every run and for any number of partitions.
    """
    drawn = stage(patients.select("unique_patient").distinct().withColumn(
        "randGUID", random_id(F.col("unique_patient"), seed)), "drawn")
    # one key for all: a scan in blocks, however many rows it has
    return ordered_scan(drawn.withColumn("_all", F.lit(0)), "_all", ["randGUID", "unique_patient"],
                        number="random_order").drop("_all")


def random_sample(patients: DataFrame, n: int, seed: str | None = None) -> DataFrame:
    """``n`` distinct patients at random (all, if fewer), by the least randGUID.

    Each task hands on its ``n`` least, so take few.
    """
    drawn = patients.select("unique_patient").distinct().withColumn(
        "randGUID", random_id(F.col("unique_patient"), seed))
    return drawn.orderBy("randGUID", "unique_patient").limit(n)
