"""Registered queries: one per operator, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafill.analogues import adapters as on
from stratafill.analogues import sql
from stratafill.functions import buckets, dates, predicates, text
from stratafill.functions.rules import DEPRESSION, DISEASE, ONCOLOGY, PAIN
from stratafill.operators import claims, cohort, features, quality, ruletable, sequence, strata, threshold
from stratafill.operators.features import DISEASE_COUNTS
from stratafill.plans import workflow
from stratafill.sources.staging import stage
from stratafill.sources.tables import Tables

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def register(oracle: str | None = None, *needs: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf: fn(Tables(spark, sf))
        if oracle is not None:
            ORACLES[fn.__name__] = sql.query(oracle, *needs)
        return fn
    return add


# --- exploration ---------------------------------------------------------------------------


@register("SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1")
def distinct_values(t):
    return quality.distinct_values(t["orders"], "o_orderpriority")


@register("""SELECT DISTINCT p_name, p_type FROM part WHERE upper(p_name) LIKE '%ANVIL%'
OR upper(p_name) LIKE '%GIZMO%' OR upper(p_name) LIKE '%RED W%'""")
def drug_lookup(t):
    return quality.lookup_contains(
        t["part"], {"p_name": ("anvil", "gizmo", "red w")}, "p_name", "p_type")


@register("SELECT event_type, count(*) AS freq FROM events GROUP BY event_type")
def freq_table(t):
    return quality.freq(t["events"], "event_type")


# --- predicates ----------------------------------------------------------------------------


@register("""SELECT o_orderkey, o_orderstatus, l_partkey, l_quantity
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
WHERE nullif(o_orderstatus, 'F') IS NOT NULL AND l_quantity IS NOT NULL""")
def live_records(t):
    both = t["orders"].join(
        t["lineitem"], c("o_orderkey") == c("l_orderkey"), "left")
    return both.where(
        F.nullif(c("o_orderstatus"), F.lit("F")).isNotNull() & c("l_quantity").isNotNull()
    ).select("o_orderkey", "o_orderstatus", "l_partkey", "l_quantity")


@register("""SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def in_list(t):
    return t["orders"].where(
        predicates.in_list(c("o_orderpriority"), ("1-URGENT", "5-LOW"))
    ).select("o_orderkey", "o_orderpriority")


@register("""SELECT p_partkey, p_name, p_type FROM part
WHERE nullif(p_type, 'PROMO') NOT IN ('SMALL', 'LARGE') OR p_name NOT IN ('red anvil', 'blue bolt')
""")
def exclude_pair(t):
    return t["part"].where(predicates.exclude_pair(
        F.nullif(c("p_type"), F.lit("PROMO")), ("SMALL", "LARGE"),
        c("p_name"), ("red anvil", "blue bolt"))).select("p_partkey", "p_name", "p_type")


@register("""SELECT p_partkey, p_name, p_type FROM part WHERE upper(p_name) LIKE '%ANVIL%'
OR upper(p_name) LIKE '%OLD G%' OR upper(p_name) LIKE '%PLATE%' OR upper(p_type) LIKE '%ECON%'""")
def contains_any(t):
    words = {"p_name": ("anvil", "old g", "plate"), "p_type": ("econ",)}
    return t["part"].where(predicates.contains_any(words)).select(
        "p_partkey", "p_name", "p_type")


@register("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) > 1998")
def after_year(t):
    return t["orders"].where(dates.after_year(c("o_orderdate"), 1998)).select(
        "o_orderkey", "o_orderdate")


@register("""SELECT o_orderkey, o_orderdate FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1998""")
def years_between(t):
    return t["orders"].where(
        dates.years_between(c("o_orderdate"), 1996, 1998)).select("o_orderkey", "o_orderdate")


# --- text ----------------------------------------------------------------------------------


@register("""SELECT c_custkey, concat(nullif(c_nationkey, 3), ' - ', c_custkey) AS unique_key
FROM customer""")
def tenant_key(t):
    return t["customer"].select(
        "c_custkey",
        text.tenant_key(F.nullif(c("c_nationkey"), F.lit(3)), c("c_custkey"))
        .alias("unique_key"))


@register("""SELECT c_custkey, concat(n_name, ' - ', nullif(c_mktsegment, 'BUILDING')) AS place
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def city_state_label(t):
    return t["customer"].join(
        t["nation"], c("c_nationkey") == c("n_nationkey")
    ).select("c_custkey", text.label_join(
        [c("n_name"), F.nullif(c("c_mktsegment"), F.lit("BUILDING"))], " - ").alias("place"))


@register("""SELECT c_custkey,
upper(trim(replace(replace(concat(' ', c_name, '-x '), ' ', ''), '-', ''))) AS name2 FROM customer""")
def normalize_name(t):
    name = F.concat(F.lit(" "), c("c_name"), F.lit("-x "))
    return t["customer"].select(
        "c_custkey", text.normalize_name(name).alias("name2"))


@register("""SELECT c_custkey, concat(upper(trim(replace(replace(c_name, ' ', ''), '-', ''))), '|',
nullif(c_mktsegment, 'BUILDING'), '|', strftime(CAST(dob AS DATE), '%m/%d/%Y')) AS person
FROM customer LEFT JOIN births ON c_custkey = o_custkey""", "births")
def match_key(t):
    people = t["customer"].join(on.birth_dates(t), "c_custkey", "left")
    return people.select("c_custkey", text.match_key(
        text.normalize_name(c("c_name")), F.nullif(c("c_mktsegment"), F.lit("BUILDING")),
        dates.fmt_date(c("dob"), 101)).alias("person"))


@register("""SELECT c_custkey, coalesce(substr(nullif(c_name, 'Customer#000000007'), 1, 5), '99999')
AS zip FROM customer""")
def zip5(t):
    return t["customer"].select("c_custkey", text.zip5(
        F.nullif(c("c_name"), F.lit("Customer#000000007"))).alias("zip"))


@register("""SELECT c_custkey, coalesce(event_type, 'NA') AS event_type,
coalesce(event_id, 0) AS event_id, coalesce(value, 0) AS value FROM customer_events""",
          "customer_events")
def null_defaults(t):
    rows = on.customer_events(t).drop("props")
    return text.default_null(rows, {"event_type": "NA", "event_id": 0, "value": 0})


@register("""SELECT c_custkey, event_id, CASE WHEN event_type IS NULL THEN 'No Event'
ELSE 'Event' END AS event_flag FROM customer_events""", "customer_events")
def presence_flag(t):
    return on.customer_events(t).select(
        "c_custkey", "event_id",
        text.presence_flag(c("event_type"), "Event", "No Event").alias("event_flag"))


@register("""SELECT c_custkey, event_id, CASE WHEN nullif(event_type, 'click') IS NULL
THEN props ELSE event_type END AS what FROM customer_events""", "customer_events")
def first_present(t):
    return on.customer_events(t).select("c_custkey", "event_id", text.first_present(
        F.nullif(c("event_type"), F.lit("click")), c("props")).alias("what"))


# --- dates ---------------------------------------------------------------------------------


@register("""SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS style101,
strftime(o_orderdate, '%Y.%m.%d') AS style102 FROM orders""")
def date_styles(t):
    return t["orders"].select(
        "o_orderkey", dates.fmt_date(c("o_orderdate"), 101).alias("style101"),
        dates.fmt_date(c("o_orderdate"), 102).alias("style102"))


@register("""SELECT o_orderkey, CASE WHEN d IS NULL THEN '2099-12-31'
ELSE concat(year(d), '-', month(d), '-', day(d)) END AS deceased
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS d FROM orders)""")
def deceased_date_text(t):
    day = F.when(c("o_orderstatus") == "F", c("o_orderdate"))
    return t["orders"].select(
        "o_orderkey", dates.unpadded_date(day, "2099-12-31").alias("deceased"))


@register("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m,
day(o_orderdate) AS d FROM orders""")
def date_parts(t):
    return t["orders"].select("o_orderkey", *dates.date_parts(c("o_orderdate")))


@register("""SELECT l_orderkey, l_partkey, l_suppkey,
datediff('day', o_orderdate, l_shipdate) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def days_between(t):
    return t["lineitem"].join(
        t["orders"], c("l_orderkey") == c("o_orderkey")
    ).select("l_orderkey", "l_partkey", "l_suppkey",
             dates.days_between(c("o_orderdate"), c("l_shipdate")).alias("days"))


@register(f"SELECT o_custkey AS c_custkey, {sql.age_sql('dob')} AS age FROM births", "births")
def age_years(t):
    return on.birth_dates(t).select(
        "c_custkey", dates.age_years(c("dob"), on.CFG.as_of).alias("age"))


@register(f"""SELECT c_custkey, {sql.band_sql('age')} AS age_cohort FROM (
SELECT c_custkey, {sql.age_sql("CASE WHEN c_mktsegment <> 'BUILDING' THEN dob END")} AS age
FROM customer LEFT JOIN births ON c_custkey = o_custkey)""", "births")
def age_band(t):
    people = t["customer"].join(on.birth_dates(t), "c_custkey", "left")
    known = F.when(c("c_mktsegment") != "BUILDING", c("dob"))
    return people.select(
        "c_custkey", buckets.age_band(dates.age_years(known, on.CFG.as_of)).alias("age_cohort"))


# --- rule sets -----------------------------------------------------------------------------


def _classified(name: str, rules) -> None:
    code = sql.code_sql("p_partkey")

    def classify(t):
        return t["part"].select(
            "p_partkey", on.code_of(c("p_partkey")).alias("code"),
            rules.label(on.code_of(c("p_partkey"))).alias("label"))

    classify.__name__ = name
    register(f"SELECT p_partkey, {code} AS code, {sql.label_sql(rules, code)} AS label FROM part")(
        classify)


_classified("classify_exact", ONCOLOGY)
_classified("classify_pain", PAIN)
_classified("classify_prefix", DEPRESSION)
_classified("classify_disease", DISEASE)


_SETS = {"oncology": ONCOLOGY, "pain": PAIN, "depression": DEPRESSION, "disease": DISEASE}


@register(f"""SELECT p_partkey, code, {', '.join(
    f"{sql.label_sql(rules, 'code')} AS {name}" for name, rules in _SETS.items())}
FROM (SELECT p_partkey, {sql.code_sql('p_partkey')} AS code FROM part)""")
def classify_by_table(t):
    codes = t["part"].select("p_partkey", on.code_of(c("p_partkey")).alias("code"))
    return ruletable.apply_rules(
        codes, ruletable.rule_table(t.spark, _SETS),
        {name: rules.default for name, rules in _SETS.items()}, "code")


def _core(t):
    return stage(on.detail(t).select(*workflow.CORE_COLUMNS), "detail")


def _detail(t):
    # written first: the rows of one patient then meet as sums, not as rows
    return stage(on.detail(t).select(*workflow.SUM_COLUMNS), "detail")


# --- cohort, features, detail --------------------------------------------------------------


@register("SELECT * FROM fills", "fills")
def cohort_fills(t):
    return on.fills(t)


@register("SELECT * FROM demographics", "demographics")
def demographics(t):
    return cohort.build_demographics(on.patient(t), on.fills(t), on.CFG)


@register("SELECT * FROM surgery", "surgery")
def surgery_features(t):
    return on.surgery(t)


@register(f"SELECT *, {sql.rule_numbers_sql('DiagnosisCode')} FROM codes", "codes")
def encounter_codes(t):
    return on.codes(on.fills(t), t)


@register("SELECT * FROM dx", "dx")
def encounter_features(t):
    return features.encounter_features(on.codes(on.fills(t), t))


@register("SELECT * FROM detail", "detail")
def detail_wide(t):
    return on.detail(t)


_TOP = ("unique_patient", "EncounterDate", "documentid", "FBDMedID", "prescriptionfillquantity")


@register(f"SELECT {', '.join(_TOP)}, pain_visits FROM detail ORDER BY {', '.join(_TOP)} LIMIT 100",
          "detail")
def top_n_detail(t):
    return quality.top_n(on.detail(t).select(*_TOP, "pain_visits"), 100, *_TOP)


@register("SELECT * FROM totals", "totals")
def patient_totals(t):
    return features.patient_totals(_core(t))


@register("SELECT * FROM sums", "sums")
def patient_sums(t):
    return features.patient_sums(_detail(t))


# --- strata --------------------------------------------------------------------------------


@register("""SELECT 'diagnosiscode_all_total' AS feature, cut_dx AS cut FROM cuts
UNION ALL SELECT 'oncology_visits_total', cut_onc FROM cuts
UNION ALL SELECT 'pain_visits_total', cut_pain FROM cuts
UNION ALL SELECT 'depression_visits_total', cut_depress FROM cuts""", "cuts")
def upper_median(t):
    return strata.feature_medians(features.patient_totals(_core(t)))


@register(f"""SELECT unique_patient, {sql.bucket_sql('pain_visits_total', 'cut_pain', 'pain')}
AS pain_bucket, {sql.bucket_sql('oncology_visits_total', 1, 'onc')} AS onc_bucket
FROM totals, cuts""", "totals", "cuts")
def median_bucket(t):
    totals = stage(features.patient_totals(_core(t)), "totals")
    cuts = strata.feature_cuts(totals, ["pain_visits_total"])
    return totals.select(
        "unique_patient",
        buckets.median_bucket(c("pain_visits_total"), cuts["pain_visits_total"], "pain")
        .alias("pain_bucket"),
        buckets.median_bucket(c("oncology_visits_total"), 1, "onc").alias("onc_bucket"))


@register(f"SELECT unique_patient, age_cohort, {sql.chronic_sql()} AS chronic FROM sums", "sums")
def chronic_bucket(t):
    return features.patient_sums(_core(t), counts=workflow.COUNTS_USED).select(
        "unique_patient", "age_cohort",
        buckets.chronic_bucket([c(n) for n in DISEASE_COUNTS]).alias("chronic"))


@register("SELECT * FROM strata", "strata")
def micro_strata(t):
    return workflow.strata_of(_core(t), on.CFG)


@register(sql.strata_sql(4, 1, 2, 1).replace("FROM sums, cuts", "FROM sums"), "sums")
def micro_strata_literal_cuts(t):
    cuts = {"diagnosiscode_all_total": 4, "oncology_visits_total": 1,
            "pain_visits_total": 2, "depression_visits_total": 1}
    sums = features.patient_sums(_core(t), counts=workflow.COUNTS_USED)
    return strata.assign_strata(sums, cuts)


@register(sql.fine_strata_sql(), "sums")
def micro_strata_fine(t):
    sums = features.patient_sums(_detail(t))
    parts = [c("age_cohort"), *strata.disease_parts(), *strata.pain_parts(strata.PAIN_PART_CUTS)]
    return strata.assign_strata(sums, {}, parts)


@register("""SELECT DISTINCT concat(c_nationkey, ' - ', c_custkey) AS unique_patient,
sha256(concat('example|', c_nationkey, ' - ', c_custkey)) AS randGUID FROM customer""")
def random_order_id(t):
    keys = t["customer"].select(
        text.tenant_key(c("c_nationkey"), c("c_custkey")).alias("unique_patient")).distinct()
    return keys.withColumn("randGUID", strata.random_id(c("unique_patient"), on.CFG.id_seed))


@register("""SELECT unique_patient, randGUID, row_number() OVER (
ORDER BY randGUID, unique_patient) AS random_order
FROM (SELECT DISTINCT concat(c_nationkey, ' - ', c_custkey) AS unique_patient,
  sha256(concat('example|', c_nationkey, ' - ', c_custkey)) AS randGUID FROM customer)""")
def patients_in_random_order(t):
    return strata.in_random_order(t["customer"].select(
        text.tenant_key(c("c_nationkey"), c("c_custkey")).alias("unique_patient")), on.CFG.id_seed)


# --- fills in sequence ---------------------------------------------------------------------

_SEQ = "unique_patient, EncounterDate, ndc, prescriptionfillquantity"


def _order_fills(t):
    return stage(sequence.distinct_fills(on.order_fills(t)), "order_fills")


@register(f"SELECT {_SEQ}, tiebreaker FROM seq", "seq")
def distinct_fills(t):
    return sequence.distinct_fills(on.order_fills(t))


@register("SELECT * FROM seq", "seq")
def fill_sequence(t):
    return sequence.fill_sequence(_order_fills(t))


@register("SELECT * FROM cum", "cum")
def fill_cumulative(t):
    return sequence.fill_cumulative(
        _order_fills(t), on.segments(t)).drop("tiebreaker")


@register("SELECT * FROM thr", "thr")
def strata_threshold(t):
    cumulative = sequence.fill_cumulative(_order_fills(t), on.segments(t)).drop("tiebreaker")
    return threshold.strata_threshold(stage(cumulative, "cumulative"))


@register(f"""SELECT {_SEQ}, number AS rowid_encounter, EncounterDate AS lag_filldate,
coalesce(next_date, EncounterDate) AS current_filldate,
coalesce(datediff('day', EncounterDate, next_date), 0) AS filldatediff,
datediff('day', first_date, coalesce(next_date, EncounterDate)) AS cumul_filldatediff
FROM (SELECT *, row_number() OVER w AS number, lead(EncounterDate) OVER w AS next_date,
        first_value(EncounterDate) OVER w AS first_date
      FROM (SELECT DISTINCT {_SEQ},
              concat(strftime(EncounterDate, '%Y.%m.%d'), ndc, prescriptionfillquantity) AS tied
            FROM order_fills)
      WINDOW w AS (PARTITION BY unique_patient
                   ORDER BY tied, EncounterDate, ndc, prescriptionfillquantity))""",
          "order_fills")
def fill_gaps(t):
    # number and gaps in one scan
    return sequence.fill_timeline(sequence.distinct_fills(on.order_fills(t))).drop(
        "tiebreaker", "cumul_prescritionfillqty")


@register("SELECT * FROM gaps", "gaps")
def gap_reference_form(t):
    # the columns that its joins read
    numbered = stage(sequence.fill_sequence(_order_fills(t)).select(
        "unique_patient", "EncounterDate", "rowid_encounter"), "numbered")
    return sequence.gap_reference_form(numbered)


@register("""SELECT * EXCLUDE (top) FROM (
SELECT *, max(rowid_encounter) OVER (PARTITION BY unique_patient) AS top FROM seq)
WHERE rowid_encounter = top""", "seq")
def last_fill_anti(t):
    numbered = stage(sequence.fill_sequence(_order_fills(t)), "numbered")
    return sequence.last_fills(numbered, sequence.raw_gaps(numbered))


@register("SELECT * FROM cumulative", "cumulative")
def flagship_cumul_strata(t):
    return workflow.run(on.source_tables(t), on.CFG).cumulative


# --- checks --------------------------------------------------------------------------------


@register("""SELECT count(*) AS freq, count(DISTINCT unique_patient) AS distinct_mems,
count(*) - count(DISTINCT unique_patient) AS error_num FROM fills""", "fills")
def profile(t):
    return quality.profile(on.fills(t), "unique_patient")


@register("""SELECT count(*) AS freq, count(DISTINCT unique_patient) AS distinct_mems,
count(*) - count(DISTINCT unique_patient) AS error_num,
count(DISTINCT micro_strata) AS micro_strata_ct FROM strata""", "strata")
def profile_strata(t):
    labels = workflow.strata_of(_core(t), on.CFG)
    return quality.profile(labels, "unique_patient", {"micro_strata_ct": "micro_strata"})


@register("""SELECT new_ct, old_ct, new_ct - old_ct AS ct_delta, new_mems, old_mems,
new_mems - old_mems AS mem_delta
FROM (SELECT count(*) AS new_ct, count(DISTINCT unique_patient) AS new_mems FROM gaps_raw),
  (SELECT count(*) AS old_ct, count(DISTINCT unique_patient) AS old_mems FROM seq)""",
          "gaps_raw", "seq")
def count_delta(t):
    numbered = stage(sequence.fill_sequence(_order_fills(t)), "numbered")
    return quality.reconcile(sequence.raw_gaps(numbered), numbered, "unique_patient")


@register("""SELECT count(*) AS freq, count(DISTINCT l_orderkey) AS distinct_mems,
CAST(count(*) // count(DISTINCT l_orderkey) AS BIGINT) AS rows_per_mem FROM lineitem""")
def profile_ratio(t):
    sizes = quality.profile(t["lineitem"], "l_orderkey")
    return sizes.select("freq", "distinct_mems", quality.ratio(
        c("freq"), c("distinct_mems")).alias("rows_per_mem"))


@register("""SELECT new_ct, old_ct, new_ct - old_ct AS ct_delta, new_mems, old_mems,
new_mems - old_mems AS mem_delta, CAST(new_ct // new_mems AS BIGINT) AS new_ratio,
CAST(old_ct // old_mems AS BIGINT) AS old_ratio
FROM (SELECT count(*) AS new_ct, count(DISTINCT unique_patient) AS new_mems FROM seq),
  (SELECT count(*) AS old_ct, count(DISTINCT unique_patient) AS old_mems FROM order_fills)""",
          "seq", "order_fills")
def count_delta_ratio(t):
    rows = stage(on.order_fills(t), "order_rows")
    return quality.reconcile_ratio(sequence.distinct_fills(rows), rows, "unique_patient")


@register("""SELECT l_orderkey, l_linenumber, count(*) AS freq FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys(t):
    return quality.duplicates(t["lineitem"], ["l_orderkey", "l_linenumber"])


@register("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber
                     HAVING count(*) > 1)""")
def duplicate_detail(t):
    lines = t["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return quality.rows_of_duplicates(lines, ["l_orderkey", "l_linenumber"], "l_orderkey")


@register("""SELECT * FROM order_fills WHERE unique_patient IN (
SELECT unique_patient FROM (SELECT DISTINCT unique_patient, EncounterDate, ClinicalEncounterID
                            FROM order_fills)
GROUP BY unique_patient, EncounterDate HAVING count(*) > 1)""", "order_fills")
def multi_encounter_days(t):
    return quality.multi_encounter_days(on.order_fills(t))


@register("""SELECT micro_strata, count(DISTINCT unique_patient) AS mem_count FROM strata
GROUP BY micro_strata""", "strata")
def strata_histogram(t):
    return quality.entities_per_group(
        workflow.strata_of(_core(t), on.CFG), "micro_strata", "unique_patient")


@register(f"""SELECT {', '.join('s.' + x for x in _SEQ.split(', '))}, s.rowid_encounter,
lag_filldate, current_filldate, filldatediff, cumul_filldatediff FROM seq s
JOIN gaps g ON s.unique_patient = g.unique_patient AND s.rowid_encounter = g.rowid_encounter
WHERE s.unique_patient = '42' ORDER BY s.rowid_encounter""", "seq", "gaps")
def trace_entity(t):
    # the numbers of a patient's fills depend on no other patient
    own = sequence.distinct_fills(on.order_fills(t).where(c("unique_patient") == "42"))
    numbered = stage(sequence.fill_sequence(own).drop("tiebreaker"), "numbered")
    return quality.trace(sequence.fill_gaps(numbered), "unique_patient", "42", "rowid_encounter")


# --- joins that the steps above do not need ------------------------------------------------


@register("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders
JOIN lineitem ON o_orderkey = l_orderkey AND o_custkey IN (l_partkey, l_suppkey)""")
def column_in_columns(t):
    return t["orders"].join(
        t["lineitem"],
        (c("o_orderkey") == c("l_orderkey"))
        & predicates.column_in_columns(c("o_custkey"), [c("l_partkey"), c("l_suppkey")])
    ).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("""SELECT o_orderkey, l_partkey, l_shipdate FROM orders
LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate = o_orderdate + INTERVAL 10 DAY""")
def attach_left(t):
    shipped = t["lineitem"].select(
        c("l_orderkey").alias("o_orderkey"), "l_partkey", "l_shipdate",
        (c("l_shipdate") - F.expr("INTERVAL 10 DAYS")).alias("o_orderdate"))
    return t["orders"].join(
        shipped, ["o_orderkey", "o_orderdate"], "left"
    ).select("o_orderkey", "l_partkey", "l_shipdate")


@register("""SELECT f.*, l_orderkey AS appointmentid, l_shipdate AS AppointmentDate,
l_partkey AS claimid FROM fills f LEFT JOIN (
  SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey) a
ON f.context_id = CAST(a.c_nationkey AS VARCHAR) AND f.patientid = a.o_custkey
  AND f.EncounterDate = a.l_shipdate""", "fills")
def attach_appointments(t):
    return cohort.attach_appointments(on.fills(t), on.appointments(t))


@register(sql.demographic_strata_sql(), "sums_by_demographics")
def micro_strata_demographic(t):
    sums = features.patient_sums(
        _detail(t), counts=workflow.COUNTS_USED, by=strata.DEMOGRAPHIC_PARTS)
    return strata.assign_strata(sums, {}, [c("age_cohort"), *strata.demographic_parts()])


@register("""SELECT concat(c_nationkey, ' - ', c_custkey) AS unique_patient, l_orderkey, l_partkey,
l_suppkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey WHERE year(l_shipdate) > 1998""")
def claims_after_year(t):
    return (
        t["lineitem"].where(dates.after_year(c("l_shipdate"), 1998))
        .join(t["orders"], c("l_orderkey") == c("o_orderkey"))
        .join(t["customer"], c("o_custkey") == c("c_custkey"))
        .select(text.tenant_key(c("c_nationkey"), c("c_custkey")).alias("unique_patient"),
                "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"))


_LINK = ("a.context_id, a.patientid, a.appointmentid, AppointmentDate, c.claimid, "
         "renderingproviderid")


@register(f"""SELECT {_LINK} FROM appointments a JOIN claims c ON a.context_id = c.context_id
AND a.patientid = c.patientid AND a.appointmentid = c.claimappointmentid
JOIN (SELECT DISTINCT context_id, patientid, documentid FROM fills) r
ON a.context_id = r.context_id AND a.patientid = r.patientid
WHERE a.claimid IN (c.claimid, c.originalclaimid) AND year(AppointmentDate) > 1999""",
          "appointments", "claims", "fills")
def appointment_claims(t):
    return claims.link_appointments(
        on.patient_appointments(t), on.claims(t), stage(on.fills(t), "fills"), after=1999)


@register(f"""SELECT {_LINK}, ChargeFromDate FROM appointments a JOIN claims c
ON a.context_id = c.context_id AND a.patientid = c.patientid
AND a.claimid IN (c.claimid, c.originalclaimid)
AND ChargeFromDate BETWEEN CAST(AppointmentDate AS DATE) - 5 AND CAST(AppointmentDate AS DATE) + 25
""", "appointments", "claims")
def claims_near_appointments(t):
    return claims.link_claims_within(
        on.patient_appointments(t), on.claims(t), before=5, after=25)


@register(f"""SELECT {_LINK}, r.documentid AS recordid, r.ChartID, d.documentid
FROM appointments a JOIN claims c ON a.context_id = c.context_id
AND a.patientid = c.patientid AND a.appointmentid = c.claimappointmentid
JOIN fills r ON a.context_id = r.context_id AND a.patientid = r.patientid
JOIN (SELECT context_id, o_custkey AS patientid, o_custkey AS ChartID,
        (l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey AS documentid FROM tenant_lines) d
ON r.context_id = d.context_id AND r.patientid = d.patientid AND r.ChartID = d.ChartID
WHERE a.claimid IN (c.claimid, c.originalclaimid)
AND AppointmentDate BETWEEN TIMESTAMP '2001-09-20' AND TIMESTAMP '2002-01-01'""",
          "appointments", "claims", "fills", "tenant_lines")
def appointment_records(t):
    return claims.appointment_records(
        on.patient_appointments(t), on.fills(t), on.claims(t), on.source_tables(t)["document"],
        since="2001-09-20", until="2002-01-01")


_CLAIM = """a.context_id, a.patientid, concat(a.context_id, ' - ', a.patientid) AS unique_patient,
a.claimid, a.renderingproviderid, a.claimappointmentid, a.servicedepartmentid"""


@register(f"""SELECT {_CLAIM}, b.ChargeFromDate FROM claims a JOIN claims b
ON a.context_id = b.context_id AND a.claimid = b.claimid WHERE year(b.ChargeFromDate) > 2000""",
          "claims")
def claims_by_transactions(t):
    return claims.claims_by_transactions(on.claims(t), on.transactions(t), after=2000)


@register(f"""SELECT {_CLAIM} FROM claims a SEMI JOIN (
  SELECT context_id, claimid FROM claims
  WHERE year(ChargeFromDate) IN (SELECT year(EncounterDate) FROM fills)) b
ON a.context_id = b.context_id AND a.claimid = b.claimid""", "claims", "fills")
def claims_in_fill_years(t):
    charged = stage(on.transactions(t), "transactions", ["charge_year"])
    return claims.claims_in_fill_years(on.claims(t), charged, on.fills(t))
