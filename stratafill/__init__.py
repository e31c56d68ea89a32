"""Cohort, micro-strata and fill-sequence analytics as PySpark DataFrame operators."""
