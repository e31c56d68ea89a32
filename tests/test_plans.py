"""Physical plans that the operators are meant to have."""

import contextlib
import io
import re

import pytest

from stratafill.analogues import adapters as on
from stratafill.analogues.queries import QUERIES
from stratafill.operators import sequence
from stratafill.operators.quantiles import upper_median
from stratafill.operators.threshold import strata_threshold
from stratafill.sources import Tables, stage
from tests.fixtures import CFG, source_tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def staged(spark):
    return stage(sequence.distinct_fills(on.order_fills(Tables(spark, FOLDER))), "fills")


def test_year_range_reaches_the_scan(spark):
    text = plan(QUERIES["after_year"](spark, FOLDER))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(o_orderdate", text)
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_windows_are_per_block(spark, staged):
    text = plan(sequence.fill_timeline(staged))
    windows = re.findall(r"Arguments: .*windowspecdefinition\((.*)", text)
    rows = [w for w in windows if "rowid" in w or "tiebreaker" in w]
    assert rows and all("_block#" in w.split(" ASC")[0] for w in rows)
    # one shuffle of all rows: the others read a row per edge of a block
    assert len(re.findall(r"hashpartitioning\(unique_patient#\d+, _block#\d+", text)) <= 2


def test_threshold_leaves_the_join_to_adaptive_execution(spark, staged):
    cumulative = sequence.fill_cumulative(staged, on.segments(Tables(spark, FOLDER)))
    assert "ResolvedHint" not in plan(strata_threshold(cumulative))


def test_no_python_on_the_executors_and_no_products(spark):
    for name in ("flagship_cumul_strata", "detail_wide", "upper_median", "count_delta"):
        text = plan(QUERIES[name](spark, FOLDER))
        for operator in ("Python", "CartesianProduct", "NestedLoop"):
            assert operator not in text, (name, operator)


def test_source_filters_reach_the_scans(spark, tmp_path):
    from stratafill.operators.cohort import live_prescriptions

    records = source_tables(spark)["patient_medication"]
    records.write.parquet(str(tmp_path / "patient_medication.parquet"))
    tables = Tables(spark, str(tmp_path))
    text = plan(live_prescriptions(tables["patient_medication"], CFG))
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    for part in ("IsNull(DeletedDatetime)", "EqualTo(medicationtype", "In(context_id",
                 "IsNotNull(prescriptionfillquantity)"):
        assert part in pushed


def test_catalog_tables_and_shared_folder(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("three_rows")
    assert Tables(spark)["three_rows"].count() == 3
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in stage(spark.range(3), "x").inputFiles())


def test_drugs_and_charts_are_not_sent_through_the_driver(spark, tmp_path):
    """Small files can hold many rows: a list repeats them, and equal values take no room."""
    from pyspark.sql import functions as F

    from stratafill.operators.cohort import build_fills
    from stratafill.operators.features import build_surgery

    tables = source_tables(spark)
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    stored = Tables(spark, str(tmp_path))
    stored["medication"] = stored["medication"].drop("context_id").distinct().withColumn(
        "context_id", F.explode(F.array(*[F.lit(f"T{i}") for i in range(25)])))
    text = simple_plan(build_fills(stored, CFG))
    assert re.search(r"SortMergeJoin \[context_id#\d+, FBDMedID#\d+", text)
    assert re.search(r"SortMergeJoin \[context_id#\d+, ChartID#\d+", text)
    assert re.search(r"SortMergeJoin \[context_id#\d+, ChartID#\d+", simple_plan(
        build_surgery(stored["patient_surgery"], stored["chart"], CFG)))
    assert {tuple(r) for r in build_fills(stored, CFG).collect()} >= {
        tuple(r) for r in build_fills(tables, CFG).collect()}


def test_customers_of_orders_are_not_sent_through_the_driver(spark):
    t = Tables(spark, FOLDER)
    assert "Broadcast" not in simple_plan(on.tenant_orders(t))
    assert "Broadcast" not in simple_plan(on.source_tables(t)["patient_surgery"])


def test_scan_of_the_reference_form_joins_nothing_again(spark, staged, monkeypatch):
    """The ranges of a scan are found by reading its rows once more, so these are written."""
    numbered = stage(sequence.fill_sequence(staged), "numbered")
    scan, scanned = sequence.ordered_scan, []

    def watched(rows, *args, **kwargs):
        scanned.append(simple_plan(rows))
        return scan(rows, *args, **kwargs)
    monkeypatch.setattr(sequence, "ordered_scan", watched)
    form = sequence.gap_reference_form(numbered)
    assert len(scanned) == 1 and "Join" not in scanned[0]
    assert form.count() == numbered.count()


def test_tables_that_grow_are_not_sent_through_the_driver(spark):
    """However small their files; nations, years and the distinct codes may be broadcast."""
    from stratafill.operators import cohort
    from stratafill.operators.joins import join_reduced

    t = Tables(spark, FOLDER)
    rows = on.fills(t)
    people = spark.range(9).withColumnRenamed("id", "o_custkey")
    assert "Broadcast" not in simple_plan(rows)
    assert "Broadcast" not in simple_plan(cohort.attach_appointments(rows, on.appointments(t)))
    assert "Broadcast" not in simple_plan(QUERIES["appointment_records"](spark, FOLDER))
    assert "Broadcast" not in simple_plan(join_reduced(t["orders"], people, "o_custkey"))
    places = r"BroadcastHashJoin \[(n_regionkey|c_nationkey)#"
    for df, fixed in ((QUERIES["demographics"](spark, FOLDER), places),
                      (on.codes(rows, t), r"BroadcastHashJoin \[coalesce\(_code#"),
                      (QUERIES["detail_wide"](spark, FOLDER), places + r"|BroadcastHashJoin \[coalesce\(_code#")):
        text = simple_plan(df)
        assert len(re.findall("BroadcastHashJoin", text)) == len(re.findall(fixed, text)), text


def simple_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_values_are_not_sent_through_the_driver(spark):
    rows = spark.range(1000).selectExpr("cast(id % 3 as string) AS g", "id AS v")
    found = upper_median(rows, ["g"], "v")
    assert "Broadcast" not in simple_plan(found)
    assert {r.g: r.cut for r in found.collect()} == {"0": 501, "1": 499, "2": 500}
