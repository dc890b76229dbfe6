"""The entities of the domain, derived from the test tables.

Orders play the event records, customers the units (ZIP codes), parts the tax
lots, and (part, supplier) quantity shares the area crosswalk. Every stand-in is
written twice: as a Spark table and as a SQL common table expression. Missing and
faulty values are planted by arithmetic on the keys, since the tables have none.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.catalog.registry import table
from panelwright.functions import constants as K
from panelwright.operators.panel import by_unit
from panelwright.sources.scan import literal_table

YEARS = list(range(1995, 2002))
BASELINE = 1996
FIRST_IDX, LAST_IDX = 1995 * 12 + 1, 2001 * 12 + 8
LAST_DATE = dt.date(2001, 9, 11)
TREAT_DATES = {
    1: dt.date(1997, 8, 11),
    2: dt.date(1997, 10, 1),
    3: dt.date(1998, 11, 1),
    4: dt.date(1999, 12, 1),
    5: LAST_DATE,
}
TREAT_IDX = {c: d.year * 12 + d.month for c, d in TREAT_DATES.items()}

# Street names that meet every spelling rule, and some that meet none.
STREETS = [
    "HOR HARDING EXPRESSWAY SR NORTH", "HOR HARDING EXPRESSWAY SR SOUTH", "ST NICHOLAS PLACE",
    "9 AVENUE", "WEST 181 STREET", "FREDERICK DOUGAL BOULEVARD", "MANH AVENUE",
    "EAST 6 STREET", "EAST 12 STREET", "EAST 13 STREET", "EAST 14 STREET", "EAST 15 STREET",
    "EAST 31 STREET", "EAST 39 STREET", "EAST 57 STREET", "EAST 132 STREET", "EAST 174 STREET",
    "EAST 176 STREET", "EAST 187 STREET", "EAST 238 STREET", "MC BRIDE STREET",
    "ADAM C POWELL BOULEVARD", "ADAM C POWELL JR BOULEVARD", "HUTCH RIVER PARKWAY",
    "OCEAN PARKWAY", "BROADWAY", "EAST 61 STREET", "WALTON AVENUE", "19 AVENUE", "GRAND CONCOURSE",
]
MESSY_STREETS = [
    "Gipson Stree t, Middle Rm", "Walton Av Enue #2", "Flatbush Ave. 3rd Fl", "Grand Conc Ourse",
    "Ocean P arkway", "Beach 40th S Treet", "Liberty Ave Apt#4", "Hopkinson Aven ue (rear)",
    "Clinton St. 1/2", "Pelham Parkw ay", "UNION STREE", "NA", "Eastern Pkwy",
]


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def pick(values, index) -> Column:
    """Element of a literal list by a zero-based index expression."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# --- units and roll-out --------------------------------------------------------

ROLLOUT_SQL = """
rollout AS (
  SELECT CAST(n_regionkey + 1 AS INTEGER) AS cohort,
         CASE n_regionkey WHEN 0 THEN DATE '1997-08-11' WHEN 1 THEN DATE '1997-10-01'
              WHEN 2 THEN DATE '1998-11-01' WHEN 3 THEN DATE '1999-12-01' END AS rtc_treat_date,
         CAST(c_custkey AS VARCHAR) AS zip
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE n_regionkey < 4
)"""


def rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort and treat date per unit, cohorts 1 to 4; the others are never listed."""
    regions = literal_table(
        spark,
        [(c - 1, c, d) for c, d in TREAT_DATES.items() if c < K.LAST_COHORT],
        "n_regionkey INT, cohort INT, rtc_treat_date DATE",
    )
    nation = table(spark, sf_dir, "nation").join(regions, "n_regionkey")
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        "cohort", "rtc_treat_date", F.col("c_custkey").cast("string").alias("zip")
    )


# --- events --------------------------------------------------------------------

EVENTS_SQL = """
events_raw AS (
  SELECT o_orderkey AS violationid,
         CAST(1 + o_custkey % 5 AS INTEGER) AS boroid,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
              WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN '2016'
              WHEN o_orderstatus = 'F' AND o_totalprice > 480000 THEN '112226'
              ELSE CAST(o_custkey AS VARCHAR) END AS zip,
         o_orderdate AS inspectiondate,
         {codes}[CAST(1 + o_orderkey % 12 AS INTEGER)] AS ordernumber,
         'HPD' AS agency
  FROM orders
), events_clean AS (
  SELECT violationid, boroid, zip, CAST(inspectiondate AS DATE) AS inspectiondate, ordernumber,
         CAST(year(inspectiondate) AS INTEGER) AS inspection_yr,
         CAST(month(inspectiondate) AS INTEGER) AS inspection_mo,
         CAST(date_trunc('month', inspectiondate) AS DATE) AS inspection_yr_mo,
         CAST(year(inspectiondate) * 12 + month(inspectiondate) AS INTEGER) AS month_idx
  FROM events_raw
)"""
CODES = [*K.ORDER_CODES, "501", "502", "503"]
EVENTS_SQL = EVENTS_SQL.replace("{codes}", sql_list(CODES))


def _missing_zip() -> Column:
    return (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")


def _faulty_zip() -> Column:
    return (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    zip_code = (
        F.when(_missing_zip(), F.lit(None).cast("string"))
        .when(_faulty_zip(), "2016")
        .when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 480000), "112226")
        .otherwise(F.col("o_custkey").cast("string"))
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("violationid"),
        (1 + F.col("o_custkey") % 5).cast("int").alias("boroid"),
        zip_code.alias("zip"),
        F.col("o_orderdate").alias("inspectiondate"),
        pick(CODES, key % 12).alias("ordernumber"),
        F.lit("HPD").alias("agency"),
    )


# Corrected records: the events with a missing or '2016' key, re-keyed, plus a few others.
FIXES_SQL = """
fixes AS (
  SELECT o_orderkey AS violationid, CAST(o_custkey AS VARCHAR) AS zip,
         CAST(o_orderdate AS DATE) AS inspectiondate
  FROM orders
  WHERE (o_orderstatus = 'P' AND o_orderpriority IN ('5-LOW', '1-URGENT')) OR o_totalprice > 499000
)"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .where(_missing_zip() | _faulty_zip() | (F.col("o_totalprice") > 499000))
        .select(
            key.alias("violationid"),
            F.col("o_custkey").cast("string").alias("zip"),
            F.col("o_orderdate").cast("date").alias("inspectiondate"),
        )
    )


# Events with a sound unit, as the panel takes them.
UNIT_EVENTS_SQL = """
unit_events AS (
  SELECT o_orderkey AS violationid, CAST(o_custkey AS VARCHAR) AS zip,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS inspection_yr_mo
  FROM orders
)"""


def unit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("violationid"),
        F.col("o_custkey").cast("string").alias("zip"),
        F.trunc("o_orderdate", "month").alias("inspection_yr_mo"),
    )


# --- annual covariates, evictions, stabilised units ------------------------------

ANNUAL_SQL = """
annual AS (
  SELECT CAST(y AS INTEGER) AS year, CAST(c_custkey AS VARCHAR) AS zip,
         CASE WHEN c_custkey % 53 = 0 THEN 0
              ELSE CAST(10 + c_custkey % 37 + (y - 1995) * (c_custkey % 3) AS INTEGER)
         END AS renter_occ_units,
         CASE WHEN c_custkey % 29 = 0 AND y = 1999 THEN NULL
              ELSE c_acctbal + 100 * (y - 1995) END AS med_hh_inc_rou,
         CAST(c_custkey % 11 + (y - 1995) AS DOUBLE) / 24 AS pct_pov,
         CAST(c_custkey % 7 AS DOUBLE) / 7 AS pct_wh_rou,
         CAST(c_custkey % 5 AS DOUBLE) / 5 AS pct_bl_rou
  FROM customer CROSS JOIN range(1995, 2002) AS r(y)
)"""


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, y = F.col("c_custkey"), F.col("year")
    years = F.explode(F.array(*[F.lit(v) for v in YEARS])).alias("year")
    # Dealt out before the years multiply the rows: the file is small enough for a single task.
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", key.cast("string").alias("zip"))
    base = by_unit(base, "zip").select("c_custkey", "c_acctbal", "zip", years)
    return base.select(
        "year",
        "zip",
        F.when(key % 53 == 0, 0)
        .otherwise((10 + key % 37 + (y - 1995) * (key % 3)).cast("int"))
        .alias("renter_occ_units"),
        F.when((key % 29 == 0) & (y == 1999), None)
        .otherwise(F.col("c_acctbal") + 100 * (y - 1995))
        .alias("med_hh_inc_rou"),
        ((key % 11 + (y - 1995)).cast("double") / 24).alias("pct_pov"),
        ((key % 7).cast("double") / 7).alias("pct_wh_rou"),
        ((key % 5).cast("double") / 5).alias("pct_bl_rou"),
    )


UNIT_FACTS_SQL = """
evictions AS (
  SELECT CAST(o_custkey AS VARCHAR) AS zip, COUNT(*) AS evicts_17
  FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1996 GROUP BY o_custkey
), stabilised AS (
  SELECT CAST(c_custkey AS VARCHAR) AS zip, c_custkey % 23 AS rs_17
  FROM customer WHERE c_acctbal > 0
)"""


def evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return (
        orders.where((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == BASELINE))
        .groupBy(F.col("o_custkey").cast("string").alias("zip"))
        .agg(F.count(F.lit(1)).alias("evicts_17"))
    )


def stabilised(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .where(F.col("c_acctbal") > 0)
        .select(key.cast("string").alias("zip"), (key % 23).alias("rs_17"))
    )


# --- the zip panel ---------------------------------------------------------------

PANEL_SQL = (
    UNIT_EVENTS_SQL
    + ","
    + ANNUAL_SQL
    + ","
    + UNIT_FACTS_SQL
    + ","
    + ROLLOUT_SQL
    + """,
cells AS (
  SELECT u.zip, m.inspection_yr_mo
  FROM (SELECT DISTINCT zip FROM unit_events) u
  CROSS JOIN (SELECT DISTINCT inspection_yr_mo FROM unit_events) m
), counts AS (
  SELECT zip, inspection_yr_mo, COUNT(DISTINCT violationid) AS n
  FROM unit_events GROUP BY 1, 2
), base AS (
  SELECT zip, renter_occ_units AS units0, pct_pov AS pct_pov_17, pct_wh_rou AS pct_wh_17
  FROM annual WHERE year = 1996
), panel AS (
  SELECT c.zip, c.inspection_yr_mo, COALESCE(n, 0) AS n_violations,
         COALESCE(n, 0) / NULLIF(CAST(renter_occ_units AS DOUBLE), 0) * 1000
           AS n_violations_per_1k_units,
         renter_occ_units, med_hh_inc_rou, pct_pov, pct_wh_rou, pct_bl_rou,
         evicts_17, rs_17,
         evicts_17 / NULLIF(CAST(units0 AS DOUBLE), 0) AS evict_rate_17,
         rs_17 / NULLIF(CAST(units0 AS DOUBLE), 0) AS rs_rate_17,
         pct_pov_17, pct_wh_17,
         COALESCE(cohort, 5) AS cohort,
         COALESCE(rtc_treat_date, DATE '2001-09-11') AS rtc_treat_date,
         CASE WHEN date_trunc('month', COALESCE(rtc_treat_date, DATE '2001-09-11'))
                   > c.inspection_yr_mo THEN 0 ELSE 1 END AS treated
  FROM cells c
  LEFT JOIN counts k ON k.zip = c.zip AND k.inspection_yr_mo = c.inspection_yr_mo
  LEFT JOIN annual a ON a.zip = c.zip AND a.year = year(c.inspection_yr_mo)
  LEFT JOIN evictions e ON e.zip = c.zip
  LEFT JOIN stabilised s ON s.zip = c.zip
  LEFT JOIN base b ON b.zip = c.zip
  LEFT JOIN rollout r ON r.zip = c.zip
)"""
)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelwright.plans.panels import zip_panel

    return zip_panel(
        unit_events(spark, sf_dir),
        annual(spark, sf_dir),
        evictions(spark, sf_dir),
        stabilised(spark, sf_dir),
        rollout(spark, sf_dir),
        baseline_year=BASELINE,
        last_date=LAST_DATE,
    )
