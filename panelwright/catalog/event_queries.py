"""Event cleaning, audits, corrections, joins and order-dependent verbs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelwright.catalog import standins as S
from panelwright.catalog.registry import query, table
from panelwright.functions.dates import treated_flag
from panelwright.operators import grouping, joins, numbering, order, reshape
from panelwright.plans import areas, events

CLEAN = "WITH" + S.EVENTS_SQL


def _clean(spark, sf):
    columns = ["violationid", "boroid", "zip", "inspectiondate", "ordernumber"]
    return events.clean_events(S.events(spark, sf), columns)


@query(
    "JOB1 P1 D1 D2 D3 J1 M9 D5",
    CLEAN
    + ","
    + S.ROLLOUT_SQL
    + """
SELECT e.*, COALESCE(cohort, 5) AS cohort,
       COALESCE(rtc_treat_date, DATE '2001-09-11') AS rtc_treat_date,
       CASE WHEN COALESCE(rtc_treat_date, DATE '2001-09-11') > inspectiondate THEN 0 ELSE 1 END AS treated
FROM events_clean e LEFT JOIN rollout r ON r.zip = e.zip""",
)
def clean_events(spark, sf):
    return events.tag_treatment(_clean(spark, sf), S.rollout(spark, sf), last_date=S.LAST_DATE)


@query(
    "JOB2 A2 O2",
    CLEAN
    + """
SELECT zip, COUNT(DISTINCT id) + MAX(CASE WHEN id IS NULL THEN 1 ELSE 0 END) AS n_violations
FROM (SELECT zip, CASE WHEN ordernumber = '503' THEN NULL ELSE violationid END AS id FROM events_raw)
GROUP BY zip""",
)
def key_audit(spark, sf):
    some_missing = F.when(F.col("ordernumber") != "503", F.col("violationid"))
    return events.audit_keys(S.events(spark, sf).withColumn("violationid", some_missing))


@query(
    "JOB2 F3 S13",
    CLEAN
    + """
SELECT violationid, boroid, zip, inspectiondate FROM events_clean
WHERE zip IN ('2015', '2016', '112226', '111010') OR zip IS NULL""",
)
def faulty_records(spark, sf):
    columns = ["violationid", "boroid", "zip", "inspectiondate"]
    return events.faulty_records(_clean(spark, sf), columns=columns)


@query(
    "JOB2 F7 A1",
    "WITH"
    + S.PANEL_SQL
    + """
SELECT variable, zip, COUNT(*) AS records FROM (
  SELECT 'n_violations_per_1k_units' AS variable, zip FROM panel WHERE n_violations_per_1k_units IS NULL
  UNION ALL SELECT 'evict_rate_17', zip FROM panel WHERE evict_rate_17 IS NULL
  UNION ALL SELECT 'rs_rate_17', zip FROM panel WHERE rs_rate_17 IS NULL
) GROUP BY 1, 2""",
)
def missing_by_unit(spark, sf):
    columns = ["n_violations_per_1k_units", "evict_rate_17", "rs_rate_17"]
    return events.missing_by_unit(S.panel(spark, sf), "zip", columns)


CORRECT_SQL = (
    CLEAN
    + ","
    + S.FIXES_SQL
    + """, kept AS (
  SELECT violationid, zip, inspectiondate, ordernumber, inspection_yr_mo FROM events_clean e
  WHERE zip IS NOT NULL AND zip <> '2016' AND inspectiondate <= DATE '2000-02-29' {anti}
), corrected AS (
  SELECT * FROM kept UNION ALL
  SELECT violationid, zip, inspectiondate, NULL,
         CAST(date_trunc('month', inspectiondate) AS DATE) FROM fixes
)
SELECT violationid, CASE zip WHEN '5' THEN '6' WHEN '17' THEN '71' ELSE zip END AS zip,
       inspectiondate, ordernumber, inspection_yr_mo
FROM corrected"""
)
ANTI = "AND NOT EXISTS (SELECT 1 FROM fixes f WHERE f.violationid = e.violationid)"
CORRECT_COLUMNS = ["violationid", "zip", "inspectiondate", "ordernumber", "inspection_yr_mo"]


def _corrected(spark, sf, anti_join):
    out = events.correct_events(
        _clean(spark, sf),
        S.fixes(spark, sf),
        until=dt.date(2000, 2, 29),
        recode={"5": "6", "17": "71"},
        anti_join=anti_join,
    )
    return out.select(*CORRECT_COLUMNS)


@query("JOB3 R3 U1 M7 F2", CORRECT_SQL.replace("{anti}", ANTI))
def apply_corrections(spark, sf):
    return _corrected(spark, sf, True)


@query("JOB3 R3", CORRECT_SQL.replace("{anti}", ""))
def apply_corrections_by_key(spark, sf):
    return _corrected(spark, sf, False)


@query(
    "J2",
    "WITH"
    + S.ANNUAL_SQL
    + """
SELECT o_orderkey, o.year, o.zip, renter_occ_units, pct_pov FROM (
  SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey AS VARCHAR) AS zip FROM orders
) o LEFT JOIN annual a ON a.year = o.year AND a.zip = o.zip""",
)
def left_join_composite(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("year"),
        F.col("o_custkey").cast("string").alias("zip"),
    )
    annual = S.annual(spark, sf).select("year", "zip", "renter_occ_units", "pct_pov")
    return joins.lookup(orders, joins.shuffled(annual), ["year", "zip"])


@query(
    "J3",
    """SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer
       ON o_custkey = c_custkey AND c_acctbal > 0""",
)
def left_join_renamed_key(spark, sf):
    customer = table(spark, sf, "customer").where(F.col("c_acctbal") > 0)
    return joins.lookup(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
        customer.select("c_custkey", "c_mktsegment"),
        {"o_custkey": "c_custkey"},
    )


NULL_KEY_SQL = """
WITH l AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS k FROM orders),
r AS (SELECT k, COUNT(*) AS n FROM l WHERE o_orderkey >= 0 GROUP BY k)
SELECT o_orderkey, l.k AS k, n FROM l LEFT JOIN r ON """


def _null_keyed(spark, sf):
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    left = table(spark, sf, "orders").select("o_orderkey", key.alias("k"))
    return left, left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("J1", NULL_KEY_SQL + "l.k = r.k")
def left_join_null_keys(spark, sf):
    left, right = _null_keyed(spark, sf)
    return joins.lookup(left, right, "k")


@query("J1", NULL_KEY_SQL + "l.k IS NOT DISTINCT FROM r.k")
def left_join_null_safe(spark, sf):
    left, right = _null_keyed(spark, sf)
    return joins.lookup(left, right, "k", null_safe=True)


@query("J1", NULL_KEY_SQL + "l.k = r.k")
def left_join_salted(spark, sf):
    left, right = _null_keyed(spark, sf)
    return joins.lookup(left, right, "k", spread_by=["o_orderkey"], salts=8)


@query(
    "J4 J7",
    """SELECT o_orderkey, o_custkey, TRUE AS listed FROM orders
         WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')
       UNION ALL
       SELECT o_orderkey, o_custkey, FALSE FROM orders
         WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""",
)
def listed_and_unlisted(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer")
    on = {"o_custkey": "c_custkey"}
    listed = joins.keep_listed(orders, customer.where(F.col("c_mktsegment") == "BUILDING"), on)
    missing = joins.keep_unlisted(orders, customer.where(F.col("c_acctbal") > 0), on)
    return listed.withColumn("listed", F.lit(True)).unionByName(
        missing.withColumn("listed", F.lit(False))
    )


@query(
    "U1",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def union_missing_columns(spark, sf):
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    supplier = table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")
    )
    return reshape.union_all([customer, supplier])


# --- crosswalk -------------------------------------------------------------------

RATIO_SQL = """
WITH pairs AS (
  SELECT l_partkey AS tract, l_suppkey AS zip, SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2
), totals AS (SELECT tract, SUM(q) AS total FROM pairs GROUP BY tract
), ratios AS (
  SELECT p.tract, zip, q / total AS res_ratio FROM pairs p JOIN totals t ON t.tract = p.tract
), flagged AS (
  SELECT r.*, CASE WHEN s_nationkey < 10 THEN 1 ELSE 0 END AS treated
  FROM ratios r JOIN supplier ON s_suppkey = zip
), facts AS (
  SELECT *, MAX(res_ratio) OVER (PARTITION BY tract) AS max_res,
         MIN(treated) OVER (PARTITION BY tract) <> MAX(treated) OVER (PARTITION BY tract) AS impacted,
         ROW_NUMBER() OVER (PARTITION BY tract ORDER BY res_ratio DESC, zip) AS rn
  FROM flagged
)"""


def _ratios(spark, sf):
    pairs = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("tract"), F.col("l_suppkey").alias("zip"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    totals = pairs.groupBy("tract").agg(F.sum("q").alias("total"))
    # A source may hold a large part of all pairs: divide its rows over several tasks.
    return joins.lookup(pairs, totals, "tract", spread_by=["zip"], salts=8).select(
        "tract", "zip", (F.col("q") / F.col("total")).alias("res_ratio")
    )


def _treated_areas(spark, sf):
    supplier = table(spark, sf, "supplier").where(F.col("s_nationkey") < 10)
    return supplier.select(F.col("s_suppkey").alias("zip"))


@query(
    "JOB7 W1 W2 W3 J3 P12",
    RATIO_SQL + " SELECT tract, zip, res_ratio, impacted FROM facts WHERE rn = 1 AND res_ratio > 0",
)
def crosswalk_argmax(spark, sf):
    return areas.assign_area(_ratios(spark, sf), _treated_areas(spark, sf))


@query(
    "JOB7 W1 W3",
    RATIO_SQL + " SELECT tract, zip, res_ratio, impacted FROM facts WHERE res_ratio = max_res",
)
def crosswalk_ties(spark, sf):
    found = areas.assign_area(_ratios(spark, sf), _treated_areas(spark, sf), ties="all")
    return found.select("tract", "zip", "res_ratio", "impacted")


@query(
    "W2",
    RATIO_SQL + " SELECT tract, BOOL_OR(impacted) AS impacted, COUNT(*) AS n FROM facts GROUP BY tract",
)
def mixed_treatment_flag(spark, sf):
    listed = _treated_areas(spark, sf).withColumn("treated", F.lit(1))
    flagged = joins.lookup(_ratios(spark, sf), listed, "zip").fillna({"treated": 0})
    return flagged.groupBy("tract").agg(
        (F.min("treated") != F.max("treated")).alias("impacted"), grouping.n_rows().alias("n")
    )


@query(
    "JOB7 F4 X8",
    """WITH r AS (SELECT lpad(CAST(36000000000 + l_partkey * 7919 % 100000000000 AS VARCHAR), 11, '0') AS tract,
              l_suppkey AS zip, MAX(l_quantity) / 50 AS res_ratio FROM lineitem GROUP BY 1, 2)
       SELECT tract, zip, res_ratio, substr(tract, 1, 2) AS state_code,
              substr(tract, 3, 3) AS county_code, substr(tract, 6, 6) AS tract_code
       FROM r WHERE substr(tract, 1, 2) = '36' AND substr(tract, 3, 3) IN ('000', '005', '010', '015')""",
)
def crosswalk_city_rows(spark, sf):
    code = (F.lit(36000000000) + F.col("l_partkey") * 7919 % 100000000000).cast("string")
    ratios = (
        table(spark, sf, "lineitem")
        .groupBy(F.lpad(code, 11, "0").alias("tract"), F.col("l_suppkey").alias("zip"))
        .agg((F.max("l_quantity") / 50).alias("res_ratio"))
    )
    return areas.city_ratios(ratios, counties=["000", "005", "010", "015"])


@query(
    "JOB7 JOB14 J1",
    RATIO_SQL
    + """, rollout AS (SELECT s_suppkey AS zip, CAST(1 + s_nationkey % 5 AS INTEGER) AS cohort,
            DATE '1997-08-11' AS rtc_treat_date FROM supplier WHERE s_nationkey < 10)
SELECT f.zip AS tract_treat_zip, tract AS geoid, COALESCE(cohort, 5) AS cohort,
       COALESCE(rtc_treat_date, DATE '2001-09-11') AS rtc_treat_date
FROM facts f LEFT JOIN rollout r ON r.zip = f.zip WHERE rn = 1 AND res_ratio > 0""",
)
def tract_cohorts(spark, sf):
    supplier = table(spark, sf, "supplier").where(F.col("s_nationkey") < 10)
    listed = supplier.select(
        F.col("s_suppkey").alias("zip"),
        (1 + F.col("s_nationkey") % 5).alias("cohort"),
        F.lit(dt.date(1997, 8, 11)).alias("rtc_treat_date"),
    )
    return areas.tract_cohorts(
        areas.assign_area(_ratios(spark, sf)), listed, last_date=S.LAST_DATE
    )


@query(
    "JOB14 X9",
    """SELECT DISTINCT lpad(CAST(36000000000 + l_partkey AS VARCHAR), 11, '0') AS geoid_tract_20,
              lpad(CAST(36000000000 + l_suppkey AS VARCHAR), 11, '0') AS geoid_tract_10,
              right(lpad(CAST(36000000000 + l_suppkey AS VARCHAR), 11, '0'), 6) AS census_tract_10,
              right(lpad(CAST(36000000000 + l_partkey AS VARCHAR), 11, '0'), 6) AS census_tract_20
       FROM lineitem""",
)
def tract_vintages(spark, sf):
    def area(c):
        return F.lpad((F.lit(36000000000) + F.col(c)).cast("string"), 11, "0")

    relation = table(spark, sf, "lineitem").select(
        area("l_partkey").alias("GEOID_TRACT_20"), area("l_suppkey").alias("GEOID_TRACT_10")
    )
    return areas.tract_vintages(relation.distinct())


# --- order-dependent verbs ----------------------------------------------------------


@query(
    "W8",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders
       ) WHERE rn = 1""",
)
def first_row_per_key(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"
    )
    return order.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "W4 W9",
    """SELECT o_orderkey, rn AS row_number, CAST(floor((rn - 1) / 1000) + 1 AS BIGINT) AS batch FROM (
         SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS rn FROM orders)""",
)
def batch_numbers(spark, sf):
    numbered = numbering.number_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return numbered.withColumn(
        "batch", (F.floor((F.col("row_number") - 1) / 1000) + 1).cast("long")
    )


SPARSE_SQL = "WITH" + S.ANNUAL_SQL + """, sparse AS (
  SELECT zip, year, med_hh_inc_rou,
         CASE WHEN year IN (1996, 1999) THEN pct_pov END AS pct FROM annual
)"""


def _sparse(spark, sf):
    pct = F.when(F.col("year").isin(1996, 1999), F.col("pct_pov"))
    return S.annual(spark, sf).select("zip", "year", "med_hh_inc_rou", pct.alias("pct"))


@query(
    "W5",
    SPARSE_SQL
    + """ SELECT zip, year,
  LAST_VALUE(med_hh_inc_rou IGNORE NULLS) OVER w AS med_hh_inc_rou,
  LAST_VALUE(pct IGNORE NULLS) OVER w AS pct
FROM sparse WINDOW w AS (PARTITION BY zip ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def ffill_unit(spark, sf):
    return order.ffill(_sparse(spark, sf), "zip", "year", ["med_hh_inc_rou", "pct"])


@query(
    "W6",
    SPARSE_SQL
    + """ SELECT zip, year,
  COALESCE(FIRST_VALUE(med_hh_inc_rou IGNORE NULLS) OVER up, LAST_VALUE(med_hh_inc_rou IGNORE NULLS) OVER down) AS med_hh_inc_rou,
  COALESCE(FIRST_VALUE(pct IGNORE NULLS) OVER up, LAST_VALUE(pct IGNORE NULLS) OVER down) AS pct
FROM sparse
WINDOW down AS (PARTITION BY zip ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       up AS (PARTITION BY zip ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def fill_updown(spark, sf):
    return order.fill_updown(_sparse(spark, sf), "zip", "year", ["med_hh_inc_rou", "pct"])


@query(
    "J6",
    """WITH first AS (SELECT o_custkey, MIN(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
       second AS (SELECT o_custkey, MIN(o_orderdate) AS d2 FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey, COALESCE(d, d2) AS geoid FROM customer
LEFT JOIN first f ON f.o_custkey = c_custkey LEFT JOIN second s ON s.o_custkey = c_custkey""",
)
def coalesce_lookup(spark, sf):
    orders = table(spark, sf, "orders")

    def earliest(status, name):
        return (
            orders.where(F.col("o_orderstatus") == status)
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.min("o_orderdate").alias(name))
        )

    customer = table(spark, sf, "customer").select("c_custkey")
    found = joins.lookup(customer, earliest("F", "geoid"), "c_custkey")
    return joins.fill_from(found, earliest("O", "other"), "c_custkey", "geoid", "other")


@query(
    "D5 A12",
    "WITH"
    + S.ROLLOUT_SQL
    + """ SELECT DISTINCT cohort, CASE WHEN rtc_treat_date > DATE '1998-11-01' THEN 0 ELSE 1 END AS treated
          FROM rollout""",
)
def distinct_cohorts(spark, sf):
    cohorts = S.rollout(spark, sf).select("cohort", "rtc_treat_date").distinct()
    at = F.lit(dt.date(1998, 11, 1))
    return cohorts.select(
        "cohort", treated_flag("rtc_treat_date", at, grain="day").alias("treated")
    ).distinct()
