"""The quantity threshold of each stratum and the fills that reach it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafill.functions.buckets import met_flag
from stratafill.operators.quantiles import quantile_cont, quantile_sketch


def strata_cuts(
    cumulative: DataFrame, p: float = 0.8, by: str = "micro_strata", accuracy: int | None = None
) -> DataFrame:
    """Per stratum: its patients and the ``p`` quantile of their highest running quantity.

    Exact and interpolated; with ``accuracy`` the value of a sketch, whose rank is off by the
    ``accuracy``-th part of the patients at most.
    """
    per_patient = cumulative.groupBy("unique_patient", by).agg(
        F.max("cumul_prescritionfillqty").alias("_max"))
    names = ("perct80_prescritionfillqty", "strata_mems")
    if accuracy is not None:
        return quantile_sketch(per_patient, [by], "_max", p, *names, accuracy)
    return quantile_cont(per_patient, [by], "_max", p, *names)


def strata_threshold(
    cumulative: DataFrame, p: float = 0.8, by: str = "micro_strata", accuracy: int | None = None
) -> DataFrame:
    """Append the stratum's size, its threshold, and whether the running quantity reaches it.

    The comparison is with the threshold as it is, not rounded. How the thresholds reach the rows
    is left to adaptive execution, which knows their size.
    """
    cuts = strata_cuts(cumulative, p, by, accuracy).withColumnRenamed(by, "_stratum")
    # null-safe, so that no filter splits the two readers of the cumulative rows' shuffle
    return cumulative.join(cuts, F.col(by).eqNullSafe(F.col("_stratum"))).withColumn(
        "met_exceed_threshold",
        met_flag(F.col("cumul_prescritionfillqty"), F.col("perct80_prescritionfillqty"))
    ).drop("_stratum")
