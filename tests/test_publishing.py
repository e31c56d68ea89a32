"""Layout, replacing, versions, counts while writing, random order, rule tables, sketches."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from stratafill.functions.rules import DEPRESSION, DISEASE, ONCOLOGY, PAIN, Rule, RuleSet
from stratafill.operators import quality, ruletable, strata
from stratafill.operators.features import patient_sums
from stratafill.operators.sequence import distinct_fills
from stratafill.operators.threshold import strata_cuts
from stratafill.plans import workflow
from stratafill.sources import (
    has_rows, publish, publish_version, replace_partitions, stage, stage_counted)
from stratafill.sources.publishing import versions
from tests.fixtures import CFG, source_tables
from tests.test_plans import plan


@pytest.fixture(scope="module")
def result(spark):
    return workflow.run(source_tables(spark), CFG)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_second_step_reads_a_bucketed_table_without_a_shuffle(spark, result):
    publish(result.detail, "bucketed_detail", bucket_by=["unique_patient"], buckets=4)
    table = spark.read.table("bucketed_detail")
    assert rows(table) == rows(result.detail)
    for step in (patient_sums(table), distinct_fills(table, 2016)):
        assert "Exchange" not in plan(step)
    plain = stage(result.detail, "plain")
    assert "Exchange" in plan(patient_sums(plain))
    files = {re.search(r"_(\d{5})\.c", f).group(1) for f in table.inputFiles()}
    assert len(table.inputFiles()) == len(files)  # one file per bucket
    out = workflow.cumulative_from_table(spark, "bucketed_detail", CFG)
    assert rows(out.drop("randGUID")) == rows(result.cumulative.drop("randGUID"))


def files_of(spark, table, tenant):
    return {f: os.stat(f.removeprefix("file://").removeprefix("file:")).st_mtime_ns
            for f in spark.read.table(table).inputFiles() if f"CONTEXT_ID={tenant}/" in f}


def test_only_the_rerun_tenants_are_replaced(spark, result):
    replace_partitions(result.detail, "by_tenant", ["CONTEXT_ID"])
    before = rows(spark.read.table("by_tenant").select(*result.detail.columns))
    assert before == rows(result.detail)
    others, own = files_of(spark, "by_tenant", "T2"), files_of(spark, "by_tenant", "T1")
    again = result.detail.where("CONTEXT_ID = 'T1'").withColumn("Zip", F.lit("new"))
    got = replace_partitions(again, "by_tenant", ["CONTEXT_ID"], ["T1"])
    assert files_of(spark, "by_tenant", "T2") == others
    assert not set(files_of(spark, "by_tenant", "T1")) & set(own)
    assert {(r.CONTEXT_ID, r.zip == "new") for r in got.collect()} == {("T1", True), ("T2", False)}
    with pytest.raises(ValueError):
        replace_partitions(result.detail, "by_tenant", ["CONTEXT_ID"], ["T1"])
    gone = replace_partitions(result.detail.where("false"), "by_tenant", ["CONTEXT_ID"], ["T1"])
    assert {r.CONTEXT_ID for r in gone.collect()} == {"T2"}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_a_failing_check_leaves_the_old_version(spark):
    publish_version(spark.range(5), "numbers", [has_rows(5)])
    with pytest.raises(ValueError):
        publish_version(spark.range(7), "numbers", [has_rows(8)])
    assert spark.read.table("numbers").count() == 5
    assert len(versions(spark, "numbers")) == 1
    for n in (6, 7, 8):
        publish_version(spark.range(n), "numbers", [has_rows(n)], keep=1)
    assert spark.read.table("numbers").count() == 8
    assert len(versions(spark, "numbers")) == 2
    publish(spark.range(1), "plain_numbers")
    with pytest.raises(ValueError):
        publish_version(spark.range(2), "plain_numbers")


def test_run_counts_while_it_writes(spark, result):
    for step, df in (("fills", result.fills), ("detail", result.detail),
                     ("cumulative", result.cumulative)):
        want = quality.profile(df, "unique_patient").first()
        found = result.profiles[step]
        assert (found.rows, found.patients, found.excess) == tuple(want), step


def test_counts_of_an_empty_table(spark):
    staged, seen = stage_counted(spark.range(0), "none", odd=F.count_if(F.col("id") % 2 == 1))
    assert staged.count() == 0 and seen["rows"] == 0
    staged, seen = stage_counted(spark.range(9), "some", odd=F.count_if(F.col("id") % 2 == 1))
    assert seen == {"rows": 9, "odd": 4}


def test_random_order_does_not_depend_on_partitions(spark):
    names = [f"T{i % 3} - {i}" for i in range(500)] + ["T0 - 0"] * 50
    want = None
    for parts in (1, 4, 64):
        df = spark.createDataFrame([(n,) for n in names], "unique_patient string").repartition(parts)
        got = rows(strata.in_random_order(df, "s"))
        assert sorted(r[-1] for r in got) == list(range(1, 501))
        assert want is None or got == want
        want = got
    by_id = sorted(want, key=lambda r: r[1])
    assert [r[-1] for r in by_id] == list(range(1, 501))
    sample = rows(strata.random_sample(df, 20, "s"))
    assert sample == sorted((r[0], r[1]) for r in by_id[:20])
    assert strata.in_random_order(df.limit(0)).count() == 0
    assert len({r[1] for r in strata.in_random_order(df).collect()}) == 500


def test_sketched_thresholds_are_near_in_rank(spark):
    rng = random.Random(1)
    data = [(f"p{i}", f"s{i % 2}", rng.lognormvariate(3, 1)) for i in range(8000)]
    df = spark.createDataFrame(
        data, "unique_patient string, micro_strata string, cumul_prescritionfillqty double")
    for r in strata_cuts(df, 0.8, accuracy=200).collect():
        values = sorted(v for _, s, v in data if s == r.micro_strata)
        assert r.strata_mems == len(values) == 4000
        at = sum(v <= r.perct80_prescritionfillqty for v in values)
        assert abs(at - 0.8 * 4000) <= 4000 / 200 + 1


SETS = {"oncology": ONCOLOGY, "pain": PAIN, "depression": DEPRESSION, "disease": DISEASE}


def test_rule_table_equals_the_case_chain(spark):
    rng = random.Random(6)
    heads = [r[5] for r in ruletable.rule_rows(SETS)]
    codes = {h[:rng.randint(1, 7)] + "".join(rng.choices("0159AMRS.", k=rng.randint(0, 3)))
             for h in rng.choices(heads, k=60_000)}
    codes |= {"".join(rng.choices("0159AMRS.", k=rng.randint(0, 6))) for _ in range(60_000)}
    codes = [(c,) for c in sorted(codes)] + [(None,), ("",), ("S9",), ("S9z",), ("r52",)] * 2
    assert len(codes) > 30_000
    df = spark.createDataFrame(codes, "DiagnosisCode string").withColumn("pain", F.lit("old"))
    for strip in (False, True):
        got = ruletable.apply_rules(
            df, ruletable.rule_table(spark, SETS), {n: r.default for n, r in SETS.items()},
            strip_dots=strip)
        want = df.select("DiagnosisCode", *[
            r.label(F.col("DiagnosisCode"), strip).alias(n) for n, r in SETS.items()])
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rules_beyond_the_broadcast_bound_agree(spark, monkeypatch):
    df = spark.createDataFrame([("S95",), ("M549",), (None,), ("R52",)], "DiagnosisCode string")
    table = ruletable.rule_table(spark, {"pain": PAIN})
    want = rows(ruletable.apply_rules(df, table, {"pain": PAIN.default}))
    monkeypatch.setattr(ruletable, "BROADCAST_RULES", 3)
    assert rows(ruletable.apply_rules(df, table, {"pain": PAIN.default})) == want
    assert ("S95", "ankle/foot injuries") in want


def test_shadowed_rules(spark):
    made = RuleSet("none", (Rule("a", ("A1",)), Rule("b", ("A12", "B"), exact=("A10", "C")),
                            Rule("r", span=("D10", "D19")), Rule("c", ("D15", "D2"))))
    got = rows(ruletable.shadowed(ruletable.rule_table(spark, {"x": made})).select(
        "label", "low", "covered_by"))
    assert got == [("b", "A10", "a"), ("b", "A12", "a"), ("c", "D15", "r")]
    found = ruletable.shadowed(ruletable.rule_table(spark, SETS))
    assert {r.low for r in found.collect()} == {"R102", "M2551"}
