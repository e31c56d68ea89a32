"""Time the headline queries on ``$BENCH_SF_DIR`` and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from stratafill.analogues.queries import QUERIES
from stratafill.session import local_session

HEADLINE = (
    "cohort_fills", "demographics", "surgery_features", "encounter_features", "detail_wide",
    "patient_totals", "upper_median", "micro_strata", "fill_sequence", "fill_cumulative",
    "strata_threshold", "fill_gaps", "flagship_cumul_strata", "classify_pain", "profile",
    "duplicate_detail", "multi_encounter_days",
)


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    timed(spark, "profile", folder)  # starts the executor and reads the files once
    seconds = {name: round(timed(spark, name, folder), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
