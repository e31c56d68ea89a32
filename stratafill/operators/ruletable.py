"""Rule sets as a table: loaded like any other data, applied by joins on prefixes.

A row of the table is one test: a prefix, a whole code, or a range of prefixes, with the label it
earns and the priority of its rule; the least priority that matches gives the label, as the first
branch of a CASE does. Sets may be long and may change without a change of code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafill.functions.rules import RuleSet
from stratafill.operators.joins import join_reduced

SCHEMA = ("rule_set string, priority int, label string, kind string, length int, low string, "
          "high string")
#: rule rows that are broadcast: some 10 MB
BROADCAST_RULES = 100_000


def rule_rows(sets: Mapping[str, RuleSet]) -> list[tuple]:
    """The rows of :data:`SCHEMA` for rule sets written in code."""
    rows = []
    for name, rules in sets.items():
        for i, rule in enumerate(rules.rules, 1):
            rows += [(name, i, rule.label, "prefix", len(p), p, p) for p in rule.prefixes]
            rows += [(name, i, rule.label, "exact", len(x), x, x) for x in rule.exact]
            if rule.span:
                low, high = rule.span
                rows.append((name, i, rule.label, "range", len(low), low, high))
    return rows


def rule_table(spark: SparkSession, sets: Mapping[str, RuleSet]) -> DataFrame:
    return spark.createDataFrame(rule_rows(sets), SCHEMA)


def _matches(codes: DataFrame, rules: DataFrame) -> DataFrame:
    """(code, rule_set, priority, label) of every test of ``rules`` that a code passes."""
    # a row per kind and length of a prefix, which codes bound
    lengths = sorted(r[0] for r in rules.where("kind <> 'exact'").select("length").distinct().collect())
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    sided = F.broadcast if small else (lambda df: df)
    found = codes.join(
        sided(rules.where("kind = 'exact'")), F.col("code") == F.col("low"))
    if lengths:
        starts = codes.withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths]))).withColumn(
            "start", F.substring("code", F.lit(1), F.col("n")))
        prefixes, ranges = (rules.where(F.col("kind") == k) for k in ("prefix", "range"))
        same = F.col("n") == F.col("length")
        for more in (
            starts.join(sided(prefixes), same & (F.col("start") == F.col("low"))),
            starts.join(sided(ranges), same & F.col("start").between(F.col("low"), F.col("high"))),
        ):
            found = found.select("code", "rule_set", "priority", "label").unionByName(
                more.select("code", "rule_set", "priority", "label"))
    return found.select("code", "rule_set", "priority", "label")


def apply_rules(
    rows: DataFrame, rules: DataFrame, defaults: Mapping[str, str], code: str = "DiagnosisCode",
    strip_dots: bool = False,
) -> DataFrame:
    """Append to ``rows`` a column per rule set of ``defaults`` with the label of the code.

    A code that no test of a set matches, or that is null, gets the set's default. The tests run
    once per distinct code; a code that very many rows have is split over tasks. ``rules`` has
    the columns of :data:`SCHEMA`; rules of other sets are left out.
    """
    plain = F.translate(F.col(code), ".", "") if strip_dots else F.col(code)
    rules = rules.where(F.col("rule_set").isin(*defaults))
    codes = rows.select(plain.alias("code")).where("code IS NOT NULL").distinct()
    first = F.struct("priority", "label")
    labels = _matches(codes, rules).groupBy(F.col("code").alias("_code")).agg(*[
        F.min(F.when(F.col("rule_set") == name, first)).alias(f"_of_{i}")
        for i, name in enumerate(defaults)])
    kept = [c for c in rows.columns if c not in defaults]
    return join_reduced(
        rows.select(*kept, plain.alias("_code")), labels, "_code", "left").select(*kept, *[
            F.coalesce(F.col(f"_of_{i}")["label"], F.lit(default)).alias(name)
            for i, (name, default) in enumerate(defaults.items())])


def shadowed(rules: DataFrame) -> DataFrame:
    """Prefixes and whole codes that never give a label, with the earlier rule that covers them."""
    later = rules.where("kind <> 'range'").select(
        F.col("low").alias("code"), F.col("rule_set").alias("_set"),
        F.col("priority").alias("_priority"), F.col("label").alias("_label"),
        F.col("kind").alias("_kind"))
    covering = rules.where("kind <> 'exact'")
    found = _matches(later.select("code").distinct(), covering).join(later, "code").where(
        (F.col("rule_set") == F.col("_set")) & (F.col("priority") < F.col("_priority")))
    return found.groupBy("rule_set", F.col("_label").alias("label"), F.col("code").alias("low")).agg(
        F.min_by("label", "priority").alias("covered_by"))
