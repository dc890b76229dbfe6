"""Chart-ready aggregates and summary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog import standins as S
from panelwright.catalog.registry import query, table
from panelwright.operators import filters, grouping, schema_ops
from panelwright.plans import charts, events, tables
from panelwright.session import materialise

PANEL = "WITH" + S.PANEL_SQL


def rounded(df, *columns):
    """Sums of doubles depend on order in the last digits; show six."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "JOB11 JOB4 A6 A10",
    PANEL
    + """ SELECT cohort, inspection_yr_mo, ROUND(AVG(n_violations_per_1k_units), 6) AS avg_monthly_intensity,
  ROUND(AVG(treated), 6) AS treated FROM panel GROUP BY 1, 2""",
)
def rate_by_cohort_month(spark, sf):
    return rounded(
        charts.rate_by_cohort_month(S.panel(spark, sf)), "avg_monthly_intensity", "treated"
    )


@query(
    "JOB11 A4",
    PANEL
    + " SELECT inspection_yr_mo, CAST(SUM(n_violations) AS BIGINT) AS n_violations FROM panel GROUP BY 1",
)
def monthly_total(spark, sf):
    return charts.monthly_total(S.panel(spark, sf))


@query("JOB11", PANEL + " SELECT cohort, inspection_yr_mo, n_violations FROM panel")
def unit_series(spark, sf):
    return charts.unit_series(S.panel(spark, sf))


EVENTS = (
    "WITH"
    + S.EVENTS_SQL
    + ","
    + S.ROLLOUT_SQL
    + """, tagged AS (
  SELECT e.*, COALESCE(cohort, 5) AS cohort,
         CASE WHEN COALESCE(rtc_treat_date, DATE '2001-09-11') > inspectiondate THEN 0 ELSE 1 END AS treated
  FROM events_clean e LEFT JOIN rollout r ON r.zip = e.zip
)"""
)


def _tagged(spark, sf):
    cleaned = events.clean_events(S.events(spark, sf), ["violationid", "zip", "inspectiondate"])
    return events.tag_treatment(cleaned, S.rollout(spark, sf), last_date=S.LAST_DATE)


@query(
    "JOB11 A3",
    EVENTS + " SELECT inspection_yr, COUNT(DISTINCT violationid) AS tot_violations FROM tagged GROUP BY 1",
)
def events_by_year(spark, sf):
    return charts.events_by(_tagged(spark, sf), "inspection_yr")


@query(
    "JOB11 A3 A10",
    EVENTS
    + """ SELECT cohort, inspection_yr, treated, COUNT(DISTINCT violationid) AS tot_violations
FROM tagged GROUP BY 1, 2, 3""",
)
def events_by_cohort_year_treated(spark, sf):
    return charts.events_by(_tagged(spark, sf), "cohort", "inspection_yr", "treated")


@query(
    "JOB11 A3",
    EVENTS
    + " SELECT treated, inspection_yr, COUNT(DISTINCT violationid) AS tot_violations FROM tagged GROUP BY 1, 2",
)
def events_by_treated_year(spark, sf):
    return charts.events_by(_tagged(spark, sf), "treated", "inspection_yr")


@query(
    "JOB11 A3",
    EVENTS
    + " SELECT cohort, inspection_yr, COUNT(DISTINCT violationid) AS tot_violations FROM tagged GROUP BY 1, 2",
)
def events_by_cohort_year(spark, sf):
    return charts.events_by(_tagged(spark, sf), "cohort", "inspection_yr")


@query(
    "JOB11 A6",
    PANEL
    + """ SELECT cohort, CAST(year(inspection_yr_mo) AS INTEGER) AS inspection_yr,
  ROUND(AVG(n_violations_per_1k_units), 6) AS avg_yr_intensity FROM panel GROUP BY 1, 2""",
)
def rate_by_cohort_year(spark, sf):
    return rounded(charts.rate_by_cohort_year(S.panel(spark, sf)), "avg_yr_intensity")


@query(
    "JOB11 D6 A6",
    PANEL
    + """ SELECT CASE WHEN cohort < 5 THEN 1 ELSE 0 END AS ever_treated, inspection_yr_mo,
  ROUND(AVG(n_violations_per_1k_units), 6) AS avg_monthly_intensity FROM panel GROUP BY 1, 2""",
)
def ever_treated_month(spark, sf):
    return rounded(charts.rate_by_ever_treated(S.panel(spark, sf)), "avg_monthly_intensity")


MEANS = {
    "violation_rate": "n_violations_per_1k_units",
    "evict_rate": "evict_rate_17",
    "rs_rate": "rs_rate_17",
    "pct_pov": "pct_pov_17",
    "hh_inc": "med_hh_inc_rou",
    "pct_wh": "pct_wh_rou",
    "pct_bl": "pct_bl_rou",
}
MEANS_SQL = ", ".join(f"ROUND(AVG({c}), 6) AS {n}" for n, c in MEANS.items())


@query(
    "JOB12 A6 A9 A3 M6",
    PANEL + f" SELECT cohort, COUNT(DISTINCT zip) AS units, {MEANS_SQL} FROM panel GROUP BY cohort",
)
def cohort_profile(spark, sf):
    found = tables.cohort_profile(
        S.panel(spark, sf), means=MEANS, units=grouping.n_distinct("zip")
    )
    return rounded(found, *MEANS)


@query("JOB12 A8 A9", PANEL + f" SELECT {MEANS_SQL} FROM panel")
def global_profile(spark, sf):
    return rounded(tables.cohort_profile(S.panel(spark, sf), by=(), means=MEANS), *MEANS)


@query(
    "JOB12 A9 A10",
    PANEL
    + f""" SELECT cohort, zip, CAST(SUM(n_violations) AS BIGINT) AS violations, {MEANS_SQL}
FROM panel GROUP BY cohort, zip""",
)
def unit_profile(spark, sf):
    found = tables.cohort_profile(
        S.panel(spark, sf),
        by=("cohort", "zip"),
        means=MEANS,
        violations=grouping.sum_strict("n_violations"),
    )
    return rounded(found, *MEANS)


@query(
    "A7 A6",
    PANEL
    + """ SELECT cohort, MAX(n_violations) AS max_vios, MAX(n_violations_per_1k_units) AS max_per_1k,
  ROUND(AVG(n_violations_per_1k_units), 6) AS mean_per_1k FROM panel GROUP BY cohort""",
)
def cohort_maxima(spark, sf):
    found = S.panel(spark, sf).groupBy("cohort").agg(
        F.max("n_violations").alias("max_vios"),
        F.max("n_violations_per_1k_units").alias("max_per_1k"),
        F.avg("n_violations_per_1k_units").alias("mean_per_1k"),
    )
    return rounded(found, "mean_per_1k")


MONTHS_SQL = (
    PANEL
    + """, counted AS (
  SELECT cohort, treated, COUNT(DISTINCT inspection_yr_mo) AS m, COUNT(DISTINCT zip) AS n_units
  FROM panel GROUP BY 1, 2
), wide AS (
  SELECT cohort, n_units, COALESCE(MAX(CASE WHEN treated = 0 THEN m END), 0) AS "0",
         COALESCE(MAX(CASE WHEN treated = 1 THEN m END), 0) AS "1",
         CASE cohort WHEN 1 THEN 'Aug. 2017' WHEN 2 THEN 'Oct. 2017' WHEN 3 THEN 'Nov. 2018'
              WHEN 4 THEN 'Dec. 2019' WHEN 5 THEN 'May 2021' END AS rtc_date
  FROM counted GROUP BY cohort, n_units
)"""
)


@query("R2 JOB12 M7", MONTHS_SQL + ' SELECT cohort, n_units, "0", "1", rtc_date FROM wide')
def cohort_months_pivot(spark, sf):
    return tables.cohort_months(S.panel(spark, sf), total=False)


@query(
    "A11 R2 JOB12",
    MONTHS_SQL
    + """ SELECT CAST(cohort AS VARCHAR) AS cohort, rtc_date, "0", "1", n_units FROM wide
UNION ALL SELECT 'Total', NULL, NULL, NULL, CAST(SUM(n_units) AS BIGINT) FROM wide""",
)
def totals_row(spark, sf):
    return tables.cohort_months(S.panel(spark, sf))


@query(
    "F10 A2 A11 JOB12",
    PANEL
    + """, c AS (SELECT cohort, COUNT(DISTINCT zip) AS n_units FROM panel WHERE pct_wh_17 {op} 0.5 GROUP BY 1)
SELECT 'above' AS side, CAST(cohort AS VARCHAR) AS cohort, n_units FROM c
UNION ALL SELECT 'above', 'Total', CAST(SUM(n_units) AS BIGINT) FROM c""".replace("{op}", ">")
    + """
UNION ALL
SELECT 'below', CAST(cohort AS VARCHAR), COUNT(DISTINCT zip) FROM panel WHERE pct_wh_17 < 0.5 GROUP BY cohort
UNION ALL SELECT 'below', 'Total', COUNT(DISTINCT zip) FROM panel WHERE pct_wh_17 < 0.5""",
)
def majority_subset_counts(spark, sf):
    panel = S.panel(spark, sf).select("cohort", "zip", "pct_wh_17")
    sides = [
        tables.units_by(filters.majority(panel, "pct_wh_17", above=above), "cohort", "zip")
        .select(F.lit(name).alias("side"), "cohort", "n_units")
        for name, above in (("above", True), ("below", False))
    ]
    return sides[0].unionByName(sides[1])


@query(
    "A4 A5",
    """WITH v AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS k FROM orders)
SELECT o_custkey, CASE WHEN COUNT(k) = COUNT(*) THEN CAST(SUM(k) AS BIGINT) END AS strict_sum,
       COALESCE(CAST(SUM(k) AS BIGINT), 0) AS present_sum FROM v GROUP BY 1""",
)
def strict_and_present_sums(spark, sf):
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))
    values = table(spark, sf, "orders").select("o_custkey", key.alias("k"))
    return values.groupBy("o_custkey").agg(
        grouping.sum_strict("k").alias("strict_sum"), grouping.sum_or_zero("k").alias("present_sum")
    )


@query(
    "A1 A10",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS records FROM lineitem GROUP BY 1, 2""",
)
def counts_by_keys(spark, sf):
    return grouping.count_by(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


VARIABLES = ["n_violations", "n_violations_per_1k_units", "rs_17", "evict_rate_17", "pct_pov_17"]


def _stats_sql(group=""):
    select, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    parts = [
        f"""SELECT {select}'{v}' AS variable, COUNT({v}) AS n, ROUND(AVG({v}), 6) AS mean,
  ROUND(STDDEV_SAMP({v}), 6) AS sd, CAST(MIN({v}) AS DOUBLE) AS min,
  ROUND(QUANTILE_CONT(CAST({v} AS DOUBLE), 0.25), 6) AS pctile_25,
  ROUND(QUANTILE_CONT(CAST({v} AS DOUBLE), 0.75), 6) AS pctile_75,
  CAST(MAX({v}) AS DOUBLE) AS max FROM panel{by}"""
        for v in VARIABLES
    ]
    return PANEL + " " + "\nUNION ALL ".join(parts)


def _landed(spark, sf):
    """The columns of the table, written once: quartiles take a second pass."""
    return materialise(S.panel(spark, sf).select("cohort", *VARIABLES))


@query("A13 JOB12", _stats_sql())
def sumtable(spark, sf):
    found = tables.sumtable(_landed(spark, sf), VARIABLES)
    return rounded(found, "mean", "sd", "pctile_25", "pctile_75")


@query("A14 JOB12", _stats_sql("cohort"))
def sumtable_by_group(spark, sf):
    found = tables.sumtable(_landed(spark, sf), VARIABLES, by="cohort")
    return rounded(found, "mean", "sd", "pctile_25", "pctile_75")


@query(
    "A14",
    PANEL
    + ", long AS ("
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, cohort, CAST({v} AS DOUBLE) AS x FROM panel WHERE {v} IS NOT NULL"
        for v in VARIABLES
    )
    + """), g AS (SELECT variable, cohort, COUNT(*) AS n, AVG(x) AS m, VAR_POP(x) * COUNT(*) AS ssw
  FROM long GROUP BY 1, 2
), a AS (SELECT variable, AVG(x) AS grand, COUNT(*) AS total FROM long GROUP BY 1)
SELECT g.variable, COUNT(*) - 1 AS df_between, MAX(total) - COUNT(*) AS df_within,
  ROUND((SUM(n * (m - grand) * (m - grand)) / (COUNT(*) - 1)) / (SUM(ssw) / (MAX(total) - COUNT(*))), 4) AS f_statistic
FROM g JOIN a ON a.variable = g.variable GROUP BY g.variable""",
)
def group_test_statistic(spark, sf):
    found = tables.group_test(S.panel(spark, sf), VARIABLES, "cohort").drop("p_value")
    return found.withColumn("f_statistic", F.round("f_statistic", 4))


@query("A14")
def group_test_p_values(spark, sf):
    return tables.group_test(S.panel(spark, sf), VARIABLES, "cohort")


@query(
    "A14",
    """WITH t AS (SELECT c_mktsegment AS v, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT v, g, COUNT(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT v, COUNT(*) AS rn FROM t GROUP BY 1),
k AS (SELECT g, COUNT(*) AS kn FROM t GROUP BY 1), a AS (SELECT COUNT(*) AS total FROM t)
SELECT 'c_mktsegment' AS variable, ROUND(SUM(POWER(COALESCE(n, 0) - rn * kn / CAST(total AS DOUBLE), 2)
         / (rn * kn / CAST(total AS DOUBLE))), 6) AS chi2,
       (COUNT(DISTINCT r.v) - 1) * (COUNT(DISTINCT k.g) - 1) AS df
FROM r CROSS JOIN k CROSS JOIN a LEFT JOIN c ON c.v = r.v AND c.g = k.g""",
)
def category_test_statistic(spark, sf):
    nation = table(spark, sf, "nation")
    customer = table(spark, sf, "customer")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    found = tables.category_test(joined, "c_mktsegment", "n_regionkey").drop("p_value")
    return rounded(found, "chi2")


@query(
    "A14 A16",
    """SELECT n_regionkey, c_mktsegment, COUNT(*) AS n,
       ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY n_regionkey) AS DOUBLE), 6) AS share
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def category_shares(spark, sf):
    nation = table(spark, sf, "nation")
    customer = table(spark, sf, "customer")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return rounded(tables.category_shares(joined, "c_mktsegment", "n_regionkey"), "share")


@query("P9 P10", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def numeric_columns(spark, sf):
    customer = table(spark, sf, "customer")
    return customer.select(*schema_ops.numeric_columns(customer))
