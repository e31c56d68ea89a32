"""Parameters of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from stratafill.functions.buckets import AGE_BANDS


@dataclass(frozen=True)
class CohortConfig:
    """What selects the cohort and how strata are cut.

    ``tenants`` None means all tenants. ``cuts`` None means the medians of the data.
    ``feature_mode`` "reference" sums encounter counts once per fill of the encounter,
    "dedup" once per encounter. ``collation`` (``UTF8_LCASE``, ``UTF8_BINARY_RTRIM``, ``UTF8_LCASE_RTRIM``)
    sets how text compares: the tenants in every join and key, the lists, the drug patterns and
    the prefixes, ranges and whole codes of the rules. ``id_seed`` None draws the random ids anew on each run.
    """

    tenants: Sequence[str] | None = None
    fills_after_year: int = 2016
    as_of: str = "2018-12-31"
    surgery_years: tuple[int, int] = (2015, 2018)
    percentile: float = 0.8
    cuts: Mapping[str, int] | None = None
    feature_mode: str = "reference"
    collation: str | None = None
    strip_dots: bool = False
    tenant_safe: bool = False
    drop_incomplete: bool = False
    id_seed: str | None = None
    age_bands: Sequence[tuple] = AGE_BANDS

    # Record types, code set, drug classes and drug names.
    medication_types: Sequence[str] = ("CLINICALPRESCRIPTION",)
    code_sets: Sequence[str] = ("ICD10",)
    excluded_classes: Sequence[str] = ("NARCOTIC WITHDRAWAL THERAPY AGENTS",)
    excluded_names: Sequence[str] = ("buprenorphine-naloxone", "Suboxone")
    drug_words: Mapping[str, Sequence[str]] = field(default_factory=lambda: {
        "HIC3Description": ("METHADONE", "NARCOTIC"),
        "MedicationName": (
            "AVINZA", "BUTRANS", "DOLOPHINE", "DURAGESIC", "EMBEDA", "EXALGO", "KADIAN",
            "MS CONTIN", "OPANA ER", "ORAMORPH", "TRAMADOL", "OXYCONTIN"),
    })


# Cut points read off a past run, usable as ``cuts``.
PAST_CUTS = {"diagnosiscode_all_total": 4, "oncology_visits_total": 1,
             "pain_visits_total": 2, "depression_visits_total": 1}
