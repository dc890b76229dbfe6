"""Panels: counts, completion, rates, baselines and the full analytic table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog import standins as S
from panelwright.catalog.registry import query, table
from panelwright.operators import panel as P
from panelwright.plans import panels

COUNTS = "WITH" + S.UNIT_EVENTS_SQL + """, counts AS (
  SELECT zip, inspection_yr_mo, COUNT(DISTINCT violationid) AS n_violations
  FROM unit_events GROUP BY 1, 2
)"""


@query("JOB4 A2 A10", COUNTS + " SELECT * FROM counts")
def panel_counts(spark, sf):
    return P.unit_period_counts(
        S.unit_events(spark, sf), "zip", "inspection_yr_mo", "violationid", "n_violations"
    )


@query(
    "R1 J5",
    COUNTS
    + """ SELECT u.zip, m.inspection_yr_mo, COALESCE(n_violations, 0) AS n_violations
FROM (SELECT DISTINCT zip FROM counts) u CROSS JOIN (SELECT DISTINCT inspection_yr_mo FROM counts) m
LEFT JOIN counts c ON c.zip = u.zip AND c.inspection_yr_mo = m.inspection_yr_mo""",
)
def panel_complete(spark, sf):
    return panels.count_panel(S.unit_events(spark, sf))


FAULTY_COUNTS = "WITH" + S.EVENTS_SQL + """, counts AS (
  SELECT zip, inspection_yr_mo, COUNT(DISTINCT violationid) AS n FROM events_clean GROUP BY 1, 2
)"""


@query(
    "R1",
    FAULTY_COUNTS
    + """ SELECT u.zip, m.inspection_yr_mo, COALESCE(n, 0) AS n_violations
FROM (SELECT DISTINCT zip FROM counts) u CROSS JOIN (SELECT DISTINCT inspection_yr_mo FROM counts) m
LEFT JOIN counts c ON c.zip IS NOT DISTINCT FROM u.zip AND c.inspection_yr_mo = m.inspection_yr_mo""",
)
def panel_with_missing_unit(spark, sf):
    events = S.events(spark, sf).withColumn(
        "inspection_yr_mo", F.trunc("inspectiondate", "month")
    )
    return panels.count_panel(events)


@query(
    "R1 D3",
    """WITH e AS (SELECT l_suppkey AS zip, CAST(date_trunc('month', l_shipdate) AS DATE) AS mo, l_orderkey
         FROM lineitem),
       m AS (SELECT CAST(unnest(generate_series((SELECT MIN(mo) FROM e), (SELECT MAX(mo) FROM e), INTERVAL 1 MONTH)) AS DATE) AS mo),
       k AS (SELECT zip, mo, COUNT(DISTINCT l_orderkey) AS n FROM e GROUP BY 1, 2)
SELECT u.zip, m.mo AS inspection_yr_mo, COALESCE(n, 0) AS n_violations
FROM (SELECT DISTINCT zip FROM e) u CROSS JOIN m LEFT JOIN k ON k.zip = u.zip AND k.mo = m.mo""",
)
def panel_calendar(spark, sf):
    events = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("zip"),
        F.trunc("l_shipdate", "month").alias("inspection_yr_mo"),
        F.col("l_orderkey").alias("violationid"),
    )
    return panels.count_panel(events, calendar=True)


PANEL = "WITH" + S.PANEL_SQL


@query(
    "JOB4 M2 M11",
    PANEL + " SELECT zip, inspection_yr_mo, n_violations, n_violations_per_1k_units FROM panel",
)
def panel_rates(spark, sf):
    return S.panel(spark, sf).select(
        "zip", "inspection_yr_mo", "n_violations", "n_violations_per_1k_units"
    )


@query("JOB4 J1 J2 W7 D5", PANEL + " SELECT * FROM panel")
def analytic_panel(spark, sf):
    return S.panel(spark, sf)


@query(
    "W7 W6",
    PANEL
    + """ SELECT zip, inspection_yr_mo,
  MAX(CASE WHEN year(inspection_yr_mo) = 1996 THEN evicts_17 / NULLIF(CAST(renter_occ_units AS DOUBLE), 0) END)
    OVER (PARTITION BY zip) AS evict_rate,
  MAX(CASE WHEN year(inspection_yr_mo) = 1996 THEN pct_pov END) OVER (PARTITION BY zip) AS pct_pov_base
FROM panel""",
)
def baseline_covariates(spark, sf):
    from panelwright.functions.scalars import safe_ratio

    found = P.panel_baseline(
        S.panel(spark, sf).select(
            "zip", "inspection_yr_mo", "evicts_17", "renter_occ_units", "pct_pov"
        ),
        "zip",
        F.year("inspection_yr_mo"),
        S.BASELINE,
        {"evict_rate": safe_ratio("evicts_17", "renter_occ_units"), "pct_pov_base": F.col("pct_pov")},
    )
    return found.select("zip", "inspection_yr_mo", "evict_rate", "pct_pov_base")


@query(
    "JOB4 D7 D8",
    PANEL
    + """ SELECT zip, CAST(year(inspection_yr_mo) * 12 + month(inspection_yr_mo) AS INTEGER) AS month_idx,
  CAST(CASE WHEN rtc_treat_date > DATE '1999-05-31' THEN 0
       ELSE year(rtc_treat_date) * 12 + month(rtc_treat_date) END AS INTEGER) AS treat_idx,
  n_violations
FROM panel WHERE inspection_yr_mo BETWEEN DATE '1996-01-01' AND DATE '1999-05-01'""",
)
def study_panel(spark, sf):
    found = panels.study_panel(S.panel(spark, sf), 1996 * 12 + 1, 1999 * 12 + 5)
    return found.select("zip", "month_idx", "treat_idx", "n_violations")


TRACT_SQL = """
WITH ev AS (
  SELECT l_suppkey AS geoid, CAST(date_trunc('month', l_shipdate) AS DATE) AS mo,
         l_orderkey * 10 + l_linenumber AS id FROM lineitem
), k AS (SELECT geoid, mo, COUNT(DISTINCT id) AS n FROM ev GROUP BY 1, 2
), cells AS (
  SELECT u.geoid, m.mo FROM (SELECT DISTINCT geoid FROM ev) u CROSS JOIN (SELECT DISTINCT mo FROM ev) m
), acs AS (
  SELECT s_suppkey AS geoid, CAST(y AS INTEGER) AS year,
         CAST(20 + s_suppkey % 41 + (y - 1995) AS INTEGER) AS renter_occ_units,
         CASE WHEN s_acctbal < 0 THEN 0 ELSE 1900 + s_nationkey END AS med_yr_blt_rou,
         s_suppkey % 11 / CAST(11 AS DOUBLE) AS pct_pov, s_suppkey % 7 / CAST(7 AS DOUBLE) AS pct_wh_rou,
         s_suppkey % 5 / CAST(5 AS DOUBLE) AS pct_bl_rou
  FROM supplier CROSS JOIN range(1995, 2002) AS r(y)
), evict AS (
  SELECT l_suppkey AS geoid, COUNT(DISTINCT l_orderkey) AS evictions_per_tract FROM lineitem
  WHERE l_returnflag = 'R' AND year(l_shipdate) = 1996 GROUP BY 1
), rs AS (SELECT s_suppkey AS geoid, s_suppkey % 23 AS rs_17_count FROM supplier WHERE s_acctbal > 0
), zips AS (
  SELECT s_suppkey AS geoid, s_nationkey AS tract_treat_zip,
         CAST(1 + n_regionkey AS INTEGER) AS cohort FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE n_regionkey < 4
)
SELECT c.geoid, c.mo AS inspection_yr_mo, COALESCE(n, 0) AS n_violations,
       COALESCE(n, 0) / CAST(a.renter_occ_units AS DOUBLE) * 1000 AS n_violations_per_1k_units,
       a.renter_occ_units, NULLIF(a.med_yr_blt_rou, 0) AS med_yr_blt_rou,
       a.pct_pov, a.pct_wh_rou, a.pct_bl_rou,
       evictions_per_tract, rs_17_count,
       evictions_per_tract / CAST(b.renter_occ_units AS DOUBLE) AS evict_rate_17,
       rs_17_count / CAST(b.renter_occ_units AS DOUBLE) AS rs_rate_17,
       b.pct_pov AS pct_pov_17, b.pct_wh_rou AS pct_wh_17, b.pct_bl_rou AS pct_bl_17,
       tract_treat_zip, cohort
FROM cells c LEFT JOIN k ON k.geoid = c.geoid AND k.mo = c.mo
LEFT JOIN acs a ON a.geoid = c.geoid AND a.year = year(c.mo)
LEFT JOIN acs b ON b.geoid = c.geoid AND b.year = 1996
LEFT JOIN evict e ON e.geoid = c.geoid LEFT JOIN rs ON rs.geoid = c.geoid
LEFT JOIN zips z ON z.geoid = c.geoid"""


@query("JOB4 JOB10 M10", TRACT_SQL)
def tract_panel(spark, sf):
    lines = table(spark, sf, "lineitem")
    supplier = table(spark, sf, "supplier")
    nation = table(spark, sf, "nation")
    key, y = F.col("s_suppkey"), F.col("year")
    events = lines.select(
        F.col("l_suppkey").alias("geoid"),
        F.trunc("l_shipdate", "month").alias("inspection_yr_mo"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("violationid"),
    )
    annual = supplier.select("*", F.explode(F.array(*[F.lit(v) for v in S.YEARS])).alias("year"))
    annual = annual.select(
        key.alias("geoid"),
        "year",
        (20 + key % 41 + (y - 1995)).cast("int").alias("renter_occ_units"),
        F.when(F.col("s_acctbal") < 0, 0).otherwise(1900 + F.col("s_nationkey")).alias("med_yr_blt_rou"),
        (key % 11 / F.lit(11.0)).alias("pct_pov"),
        (key % 7 / F.lit(7.0)).alias("pct_wh_rou"),
        (key % 5 / F.lit(5.0)).alias("pct_bl_rou"),
    )
    evicted = (
        lines.where((F.col("l_returnflag") == "R") & (F.year("l_shipdate") == S.BASELINE))
        .groupBy(F.col("l_suppkey").alias("geoid"))
        .agg(F.count_distinct("l_orderkey").alias("evictions_per_tract"))
    )
    kept = supplier.where(F.col("s_acctbal") > 0)
    stabilised = kept.select(key.alias("geoid"), (key % 23).alias("rs_17_count"))
    zips = supplier.join(
        nation.where(F.col("n_regionkey") < 4), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        key.alias("geoid"),
        F.col("s_nationkey").alias("tract_treat_zip"),
        (1 + F.col("n_regionkey")).alias("cohort"),
    )
    return panels.tract_panel(events, annual, evicted, stabilised, zips, baseline_year=S.BASELINE)


@query(
    "JOB4",
    COUNTS
    + """ SELECT (SELECT COUNT(DISTINCT zip) FROM counts) * (SELECT COUNT(DISTINCT inspection_yr_mo) FROM counts) AS n_rows,
  (SELECT COUNT(DISTINCT zip) FROM counts) AS n_units,
  (SELECT COUNT(DISTINCT inspection_yr_mo) FROM counts) AS n_periods""",
)
def panel_invariants(spark, sf):
    return P.panel_facts(panels.count_panel(S.unit_events(spark, sf)), "zip", "inspection_yr_mo")
