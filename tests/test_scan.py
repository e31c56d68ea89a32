"""Running totals and quantiles over few and many blocks."""

import datetime as dt
import math
import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafill.operators import sequence
from stratafill.operators.ordered import ordered_scan
from stratafill.operators.quantiles import quantile_cont, upper_median


@pytest.fixture(scope="module")
def fills(spark):
    """One patient holds most rows, many on one day; others a few hundred, one has no key."""
    rng = random.Random(5)
    start = dt.datetime(2017, 1, 1)
    rows = []
    for key, n, days in (("hot", 3000, 3), ("warm", 300, 200), (None, 900, 40), ("a", 1, 9),
                         ("b", 9, 5)):
        for _ in range(n):
            rows.append((key, start + dt.timedelta(days=rng.randrange(days)),
                         str(rng.randrange(5000)), rng.randrange(1, 5000) / 7))
    df = spark.createDataFrame(
        rows, "unique_patient string, EncounterDate timestamp_ntz, ndc string, "
        "prescriptionfillquantity double")
    return sequence.distinct_fills(df).cache()


@pytest.fixture
def blocks(spark):
    """Sets the number of blocks."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": None}
    before = {k: spark.conf.get(k) for k in keys}

    def use(n):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def as_set(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_rows_do_not_depend_on_the_blocks(spark, fills, blocks):
    strata = fills.select("unique_patient").distinct().withColumn(
        "micro_strata", F.upper("unique_patient"))
    found = []
    for n in (1, 4, 64):
        blocks(n)
        found.append(as_set(sequence.fill_timeline(fills)))
        if n != 4:
            found[-1].append(as_set(sequence.fill_timeline(fills, strata)))
        else:
            found[-1].append(found[0][-1])
    assert found[0] == found[1] == found[2]


def test_sums_are_exact_and_null_is_a_key(spark, fills, blocks):
    blocks(16)
    got = {}
    for r in sequence.fill_cumulative(fills).orderBy("rowid_encounter").collect():
        got.setdefault(r["unique_patient"], []).append(r)
    assert set(got) == {"hot", "warm", None, "a", "b"}
    for rows in got.values():
        rows.sort(key=lambda r: r["rowid_encounter"])
        assert [r["rowid_encounter"] for r in rows] == list(range(1, len(rows) + 1))
        total = Decimal(0)
        for r in rows:
            total += Decimal(repr(r["prescriptionfillquantity"])).quantize(
                Decimal("1e-12"), ROUND_HALF_UP)
            assert r["cumul_prescritionfillqty"] == float(total)


def test_a_hot_key_is_cut_into_blocks(spark, fills, blocks):
    blocks(16)
    ranged = fills.repartitionByRange(F.col("unique_patient"), F.col("tiebreaker"))
    per_block = ranged.where("unique_patient = 'hot'").groupBy(F.spark_partition_id()).count()
    sizes = [r[1] for r in per_block.collect()]
    assert len(sizes) > 4 and max(sizes) < 1000


def test_values_that_no_decimal_holds(spark, blocks):
    blocks(3)
    rows = [("k", i, v) for i, v in enumerate([1.5, 1e300, 2.5, math.inf, 1.0, math.nan])]
    rows += [("m", i, v) for i, v in enumerate([None, 1e-9, None, 0.25])]
    df = spark.createDataFrame(rows, "key string, i int, v double")
    out = ordered_scan(df, "key", ["i"], sums={"s": "v"}).orderBy("key", "i").collect()
    got = [r["s"] for r in out]
    assert got[:5] == [1.5, 1e300, 1e300, math.inf, math.inf] and math.isnan(got[5])
    assert got[6:] == [None, 1e-9, 1e-9, 0.250000001]


def test_next_of_a_null_value(spark, blocks):
    rows = [("k", i, None if i % 3 == 0 else i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, i int, v int")
    args = dict(number="n", sums={"s": "v"}, nexts={"nx": "v"}, firsts={"fs": "v"})
    blocks(1)
    one = as_set(ordered_scan(df, "key", ["i"], **args))
    blocks(9)
    assert one == as_set(ordered_scan(df, "key", ["i"], **args))


def test_properties_of_the_timeline(spark, fills):
    out = sequence.fill_timeline(fills)
    per = out.groupBy("unique_patient").agg(
        F.count(F.lit(1)).alias("n"), F.max("rowid_encounter").alias("top"),
        F.count_distinct("rowid_encounter").alias("numbers"),
        F.sum("prescriptionfillquantity").alias("qty"),
        F.max("cumul_prescritionfillqty").alias("run"),
        F.sum("filldatediff").alias("gaps"), F.max("cumul_filldatediff").alias("running_gap"),
        F.datediff(F.max("EncounterDate"), F.min("EncounterDate")).alias("span")).collect()
    for r in per:
        assert r["n"] == r["top"] == r["numbers"] and r["qty"] == pytest.approx(r["run"])
        assert r["gaps"] == r["running_gap"] == r["span"]


def test_two_forms_of_gaps(spark, fills, blocks):
    blocks(8)
    numbered = sequence.fill_sequence(fills.where("unique_patient is not null"))
    columns = ["unique_patient", "rowid_encounter", *sequence.GAP_COLUMNS]
    direct = sequence.fill_gaps(numbered).select(columns)
    assert as_set(direct) == as_set(sequence.gap_reference_form(numbered).select(columns))
    gaps = sequence.raw_gaps(numbered)
    patients = numbered.select("unique_patient").distinct().count()
    assert gaps.count() == numbered.count() - patients
    assert sequence.last_fills(numbered, gaps).count() == patients


def test_text_order_of_quantities(spark):
    day = dt.datetime(2018, 1, 1)
    rows = [("p", day, "7", 9.0), ("p", day, "7", 10.0), ("p", day, "7", 10.0)]
    df = spark.createDataFrame(
        rows, "unique_patient string, EncounterDate timestamp_ntz, ndc string, "
        "prescriptionfillquantity double")
    out = sequence.fill_cumulative(sequence.distinct_fills(df)).orderBy("rowid_encounter")
    assert [(r["prescriptionfillquantity"], r["cumul_prescritionfillqty"])
            for r in out.collect()] == [(10.0, 10.0), (9.0, 19.0)]


def exact_quantile(values, p):
    spot = (len(values) - 1) * Fraction(p)
    low = int(spot)
    part = spot - low
    if not part or values[low] == values[low + 1]:
        return values[low]
    return values[low] + (values[low + 1] - values[low]) * (
        (spot.numerator % spot.denominator) / spot.denominator)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.one_of(
    st.integers(-1000, 10**6).map(float), st.floats(-5, 5, allow_nan=False),
    st.sampled_from([1e-7, 2e-7, 4e-7, -1e-300, 5e-324, 1e300, math.inf, -math.inf]))),
    min_size=1, max_size=80))
def test_quantiles_are_exact(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["p80"]) for r in quantile_cont(
        df, ["g"], "v", 0.8, "p80", "n").collect()}
    cut = {r["g"]: r["cut"] for r in upper_median(df, ["g"], "v").collect()}
    for g in {g for g, _ in rows}:
        values = sorted(v for k, v in rows if k == g)
        want = exact_quantile(values, "0.8")
        assert got[g][0] == len(values)
        assert got[g][1] == want or (math.isnan(want) and math.isnan(got[g][1]))
        top = sorted(values, reverse=True)[:-(-len(values) // 2)]
        assert cut[g] == min(top)


def test_quantiles_with_nan_and_tiny_values(spark):
    df = spark.createDataFrame(
        [("n", 1.0), ("n", math.nan), ("t", 1e-7), ("t", 2e-7), ("t", 4e-7)], "g string, v double")
    cut = {r["g"]: r["cut"] for r in upper_median(df, ["g"], "v").collect()}
    assert math.isnan(cut["n"]) and cut["t"] == 2e-7
    p = {r["g"]: r["p"] for r in quantile_cont(df, ["g"], "v", 0.8, "p", "n").collect()}
    assert p["t"] == exact_quantile([1e-7, 2e-7, 4e-7], "0.8") and math.isnan(p["n"])


def test_threshold_of_three_patients(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", 2.0), ("s", 4.0), ("t", 7.0)], "g string, v double")
    out = {r["g"]: r["p"] for r in quantile_cont(df, ["g"], "v", 0.8, "p", "n").collect()}
    assert out == {"s": 3.2, "t": 7.0}
