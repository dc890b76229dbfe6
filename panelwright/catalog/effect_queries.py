"""Staggered difference-in-differences on the stand-in panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright import effects as E
from panelwright.catalog import standins as S
from panelwright.catalog.registry import query, table
from panelwright.effects.result_tables import side_by_side, tidy_groups
from panelwright.plans import models, panels
from panelwright.session import materialise

RATE = "n_violations_per_1k_units"
KEYS = ("zip", "month_idx", "treat_idx")
COHORT_LABELS = {S.TREAT_IDX[c]: f"Cohort {c}" for c in (1, 2, 3, 4)}


def _study(spark, sf, *columns):
    """The study panel, written once: estimation reads it several times."""
    found = panels.study_panel(S.panel(spark, sf), S.FIRST_IDX, S.LAST_IDX)
    return materialise(found.select(*KEYS, "cohort", RATE, *columns))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Month pairs of every cell with its cut-off, for a calendar without gaps.
CELLS_SQL = """, y AS (
  SELECT zip, CAST(year(inspection_yr_mo) * 12 + month(inspection_yr_mo) AS INTEGER) AS t,
         CASE WHEN cohort = 5 THEN 999999 ELSE CAST(year(rtc_treat_date) * 12 + month(rtc_treat_date) AS INTEGER) END AS g,
         n_violations_per_1k_units AS y, CASE WHEN pct_bl_rou > 0.5 THEN 1 ELSE 0 END AS x2
  FROM panel WHERE n_violations_per_1k_units IS NOT NULL
), months AS (SELECT DISTINCT t FROM y), cohorts AS (SELECT DISTINCT g FROM y WHERE g < 999999
), gt AS (
  SELECT g, t, CASE WHEN t >= g THEN g - 1 ELSE {pre} END AS b FROM cohorts CROSS JOIN months
  WHERE CASE WHEN t >= g THEN g - 1 ELSE {pre} END >= (SELECT MIN(t) FROM months)
), thr AS (SELECT *, GREATEST(t, b) AS h FROM gt)"""
VARYING = "WITH" + S.PANEL_SQL + CELLS_SQL.replace("{pre}", "t - 1")
UNIVERSAL = "WITH" + S.PANEL_SQL + CELLS_SQL.replace("{pre}", "g - 1")

MEANS_SQL = """, m AS (SELECT g, t, SUM(y) AS s, COUNT(y) AS n FROM y GROUP BY 1, 2
), att AS (
  SELECT c.g, c.t, c.b,
         (SUM(CASE WHEN m.g = c.g AND m.t = c.t THEN s END) / MAX(CASE WHEN m.g = c.g AND m.t = c.t THEN n END)
          - SUM(CASE WHEN m.g = c.g AND m.t = c.b THEN s END) / MAX(CASE WHEN m.g = c.g AND m.t = c.b THEN n END))
         - (SUM(CASE WHEN m.g <> c.g AND m.t = c.t THEN s END) / SUM(CASE WHEN m.g <> c.g AND m.t = c.t THEN n END)
            - SUM(CASE WHEN m.g <> c.g AND m.t = c.b THEN s END) / SUM(CASE WHEN m.g <> c.g AND m.t = c.b THEN n END))
           AS att,
         MAX(CASE WHEN m.g = c.g AND m.t = c.t THEN n END) AS n1,
         SUM(CASE WHEN m.g <> c.g AND m.t = c.t THEN n END) AS n0
  FROM thr c JOIN m ON (m.t = c.t OR m.t = c.b) AND (m.g = c.g OR {control})
  GROUP BY c.g, c.t, c.b
), sizes AS (SELECT g, COUNT(DISTINCT zip) AS size FROM y GROUP BY g)"""
LATER = "m.g > c.h"
NEVER_ONLY = "m.g = 999999"
ATT_SQL = """ SELECT g AS "group", t AS time, b AS base, t >= g AS post, ROUND(att, 6) AS att,
  COALESCE(CAST(n1 AS BIGINT), 0) AS n_treated, COALESCE(CAST(n0 AS BIGINT), 0) AS n_control,
  CASE WHEN n1 IS NULL THEN 'no treated units' WHEN n0 IS NULL THEN 'no control units'
       WHEN att IS NULL THEN 'no rows in the base month' END AS note FROM att"""
PLAIN = VARYING + MEANS_SQL.replace("{control}", LATER)


@query("C1 J9 JOB13", PLAIN + ATT_SQL)
def att_gt(spark, sf):
    return rounded(E.att_gt(_study(spark, sf), RATE, *KEYS), "att")


@query("C1 C4", UNIVERSAL + MEANS_SQL.replace("{control}", LATER) + ATT_SQL)
def att_gt_universal(spark, sf):
    return rounded(E.att_gt(_study(spark, sf), RATE, *KEYS, base="universal"), "att")


@query("C1", VARYING + MEANS_SQL.replace("{control}", NEVER_ONLY) + ATT_SQL)
def att_gt_never_treated(spark, sf):
    return rounded(E.att_gt(_study(spark, sf), RATE, *KEYS, control="nevertreated"), "att")


PAIRS_SQL = """, d AS (
  SELECT c.g AS cg, c.t, c.b, a.zip, a.x2, CASE WHEN a.g = c.g THEN 1 ELSE 0 END AS d, a.y - z.y AS dy
  FROM thr c JOIN y a ON a.t = c.t AND (a.g = c.g OR a.g > c.h)
  JOIN y z ON z.zip = a.zip AND z.t = c.b
)"""


@query(
    "C1 C9 J8",
    VARYING
    + PAIRS_SQL
    + """ SELECT cg AS "group", t AS time, b AS base, t >= cg AS post,
  ROUND(AVG(CASE WHEN d = 1 THEN dy END) - AVG(CASE WHEN d = 0 THEN dy END), 6) AS att,
  ROUND(SQRT(VAR_POP(CASE WHEN d = 1 THEN dy END) / SUM(d) + VAR_POP(CASE WHEN d = 0 THEN dy END) / SUM(1 - d)), 6)
    AS std_error,
  CAST(SUM(d) AS BIGINT) AS n_treated, CAST(SUM(1 - d) AS BIGINT) AS n_control, CAST(NULL AS VARCHAR) AS note
FROM d GROUP BY 1, 2, 3""",
)
def att_gt_std_errors(spark, sf):
    return rounded(E.att_std_errors(_study(spark, sf), RATE, *KEYS), "att", "std_error")


def _average(spark, sf, kind):
    return rounded(models.effects_and_averages(_study(spark, sf))[kind], "att")


@query(
    "C5 A15",
    PLAIN
    + """ SELECT 'simple' AS kind, CAST(NULL AS INTEGER) AS level,
  ROUND(SUM(att * size) / SUM(size), 6) AS att FROM att JOIN sizes USING (g) WHERE t >= g""",
)
def agg_simple(spark, sf):
    return _average(spark, sf, "simple")


@query(
    "C6 A15",
    PLAIN
    + """, lv AS (SELECT g, AVG(att) AS a FROM att WHERE t >= g GROUP BY g)
SELECT 'group' AS kind, g AS level, ROUND(a, 6) AS att FROM lv
UNION ALL SELECT 'group', NULL, ROUND(SUM(a * size) / SUM(size), 6) FROM lv JOIN sizes USING (g)""",
)
def agg_group(spark, sf):
    return _average(spark, sf, "group")


@query(
    "C7 A15",
    PLAIN
    + """, lv AS (SELECT t - g AS e, SUM(att * size) / SUM(size) AS a FROM att JOIN sizes USING (g) GROUP BY 1)
SELECT 'dynamic' AS kind, e AS level, ROUND(a, 6) AS att FROM lv
UNION ALL SELECT 'dynamic', NULL, ROUND(AVG(a), 6) FROM lv WHERE e >= 0""",
)
def agg_dynamic(spark, sf):
    return _average(spark, sf, "dynamic")


@query(
    "C8 A15",
    PLAIN
    + """, lv AS (SELECT t, SUM(att * size) / SUM(size) AS a FROM att JOIN sizes USING (g) WHERE t >= g GROUP BY 1)
SELECT 'calendar' AS kind, t AS level, ROUND(a, 6) AS att FROM lv
UNION ALL SELECT 'calendar', NULL, ROUND(AVG(a), 6) FROM lv""",
)
def agg_calendar(spark, sf):
    return _average(spark, sf, "calendar")


# With one 0/1 covariate both models are saturated: every method is the average of
# the differences within its two levels, weighted by the treated.
STRATA_SQL = """, st AS (
  SELECT cg, t, b, x2, SUM(d) AS n1, SUM(1 - d) AS n0, AVG(CASE WHEN d = 1 THEN dy END) AS m1,
         AVG(CASE WHEN d = 0 THEN dy END) AS m0 FROM d GROUP BY 1, 2, 3, 4
) SELECT cg AS "group", t AS time, b AS base, t >= cg AS post,
  ROUND(SUM(n1 * (m1 - m0)) / SUM(n1), 6) AS att, CAST(SUM(n1) AS BIGINT) AS n_treated,
  CAST(SUM(n0) AS BIGINT) AS n_control, CAST(NULL AS VARCHAR) AS note
FROM st GROUP BY 1, 2, 3"""


def _binary(spark, sf, method):
    panel = _study(spark, sf, "pct_bl_rou")
    panel = panel.withColumn("x2", F.when(F.col("pct_bl_rou") > 0.5, 1).otherwise(0))
    return rounded(E.att_gt(panel, RATE, *KEYS, covariates=["x2"], method=method), "att")


@query("C2 JOB13", VARYING + PAIRS_SQL + STRATA_SQL)
def att_gt_dr(spark, sf):
    return _binary(spark, sf, "dr")


@query("C3", VARYING + PAIRS_SQL + STRATA_SQL)
def att_gt_ipw(spark, sf):
    return _binary(spark, sf, "ipw")


@query("C3", VARYING + PAIRS_SQL + STRATA_SQL)
def att_gt_reg(spark, sf):
    return _binary(spark, sf, "reg")


@query(
    "C3",
    VARYING.replace("CASE WHEN pct_bl_rou > 0.5 THEN 1 ELSE 0 END", "pct_wh_rou")
    + PAIRS_SQL
    + """ SELECT cg AS "group", t AS time, b AS base, t >= cg AS post,
  ROUND(AVG(CASE WHEN d = 1 THEN dy END)
        - (REGR_INTERCEPT(CASE WHEN d = 0 THEN dy END, CASE WHEN d = 0 THEN x2 END)
           + REGR_SLOPE(CASE WHEN d = 0 THEN dy END, CASE WHEN d = 0 THEN x2 END) * AVG(CASE WHEN d = 1 THEN x2 END)), 6)
    AS att,
  CAST(SUM(d) AS BIGINT) AS n_treated, CAST(SUM(1 - d) AS BIGINT) AS n_control, CAST(NULL AS VARCHAR) AS note
FROM d GROUP BY 1, 2, 3""",
)
def att_gt_reg_continuous(spark, sf):
    panel = _study(spark, sf, "pct_wh_rou")
    found = E.att_gt(panel, RATE, *KEYS, covariates=["pct_wh_rou"], method="reg")
    return rounded(found, "att")


THREE = ["evict_rate_17", "rs_rate_17", "pct_pov_17"]


@query("C2 C12 JOB13")
def att_gt_dr_three_covariates(spark, sf):
    return E.att_gt(_study(spark, sf, *THREE), RATE, *KEYS, covariates=THREE)


@query(
    "C12 JOB2",
    "WITH"
    + S.PANEL_SQL
    + """ SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE n_violations_per_1k_units IS NULL OR
  evict_rate_17 IS NULL OR rs_rate_17 IS NULL OR pct_pov_17 IS NULL) AS n_dropped FROM panel""",
)
def dropped_rows(spark, sf):
    return E.dropped_rows(S.panel(spark, sf), [RATE, *THREE])


@query(
    "C1 C12",
    "WITH"
    + S.PANEL_SQL
    + """, r AS (SELECT zip, COALESCE(cohort = 1, FALSE) AS early, n_violations_per_1k_units IS NULL OR
  evict_rate_17 IS NULL OR rs_rate_17 IS NULL OR pct_pov_17 IS NULL AS missing FROM panel)
SELECT 'treated in the first month' AS reason, COUNT(*) FILTER (WHERE early) AS n_rows,
  COUNT(DISTINCT CASE WHEN early THEN zip END) AS n_units FROM r
UNION ALL SELECT 'missing value', COUNT(*) FILTER (WHERE NOT early AND missing),
  COUNT(DISTINCT CASE WHEN NOT early AND missing THEN zip END) FROM r""",
)
def left_out_rows(spark, sf):
    """What an estimation leaves out if the first cohort is treated from the first month on."""
    found = panels.study_panel(S.panel(spark, sf), S.FIRST_IDX, S.LAST_IDX)
    found = found.withColumn("treat_idx", F.when(F.col("cohort") == 1, S.FIRST_IDX).otherwise(F.col("treat_idx")))
    return E.left_out(found, RATE, *KEYS, covariates=THREE)


# --- unbalanced panel: mean discount of a supplier's lines in a month ---------------

UNBALANCED_SQL = """
WITH y AS (
  SELECT l_suppkey AS unit, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS t,
         CASE n_regionkey WHEN 0 THEN 23972 WHEN 1 THEN 23974 WHEN 2 THEN 23987 WHEN 3 THEN 24000 ELSE 999999 END AS g,
         AVG(l_discount) AS y, CASE WHEN s_acctbal > 4500 THEN 1 ELSE 0 END AS x2
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  GROUP BY ALL
), months AS (SELECT DISTINCT t FROM y), cohorts AS (SELECT DISTINCT g FROM y WHERE g < 999999
), gt AS (SELECT g, t, CASE WHEN t >= g THEN g - 1 ELSE t - 1 END AS b FROM cohorts CROSS JOIN months
  WHERE t > (SELECT MIN(t) FROM months)
), thr AS (SELECT *, GREATEST(t, b) AS h FROM gt)"""


def _unbalanced(spark, sf):
    lines = table(spark, sf, "lineitem")
    supplier = table(spark, sf, "supplier")
    nation = table(spark, sf, "nation")
    means = lines.groupBy(
        F.col("l_suppkey").alias("unit"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("t"),
    ).agg(F.avg("l_discount").alias("y"))
    dates = F.element_at(
        F.array(*[F.lit(S.TREAT_IDX[c] if c < 5 else 0) for c in range(1, 6)]),
        F.col("n_regionkey") + 1,
    )
    units = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("unit"),
        dates.alias("g"),
        F.when(F.col("s_acctbal") > 4500, 1).otherwise(0).alias("x2"),
    )
    return materialise(means.join(units, "unit"))


@query("C1 C4", UNBALANCED_SQL + MEANS_SQL.replace("{control}", LATER).replace("DISTINCT zip", "DISTINCT unit") + ATT_SQL)
def att_gt_unbalanced(spark, sf):
    return rounded(E.att_gt(_unbalanced(spark, sf), "y", "unit", "t", "g"), "att")


@query(
    "C1 J8",
    UNBALANCED_SQL
    + PAIRS_SQL.replace("zip", "unit")
    + """ SELECT c.g AS "group", c.t AS time, c.b AS base, c.t >= c.g AS post,
  ROUND(AVG(CASE WHEN d = 1 THEN dy END) - AVG(CASE WHEN d = 0 THEN dy END), 6) AS att,
  COALESCE(CAST(SUM(d) AS BIGINT), 0) AS n_treated, COALESCE(CAST(SUM(1 - d) AS BIGINT), 0) AS n_control,
  CASE WHEN COALESCE(SUM(d), 0) = 0 THEN 'no treated units' WHEN SUM(1 - d) = 0 THEN 'no control units' END AS note
FROM gt c LEFT JOIN d ON d.cg = c.g AND d.t = c.t AND d.b = c.b GROUP BY 1, 2, 3""",
)
def att_gt_unbalanced_pairs(spark, sf):
    found = E.att_gt(_unbalanced(spark, sf), "y", "unit", "t", "g", panel_mode="panel")
    return rounded(found.drop("std_error"), "att")


@query("C2")
def att_gt_dr_unbalanced(spark, sf):
    return E.att_gt(_unbalanced(spark, sf), "y", "unit", "t", "g", covariates=["x2"])


# --- errors, bands, tests ------------------------------------------------------------


def _estimate(spark, sf, covariates=(), **options):
    return E.estimate(_study(spark, sf, *covariates), RATE, *KEYS, covariates=covariates, **options)


@query("C9")
def att_bands(spark, sf):
    return _estimate(spark, sf, THREE).bands()


@query("C9 C7")
def dynamic_bands(spark, sf):
    return _estimate(spark, sf).bands("dynamic")


@query("C13 X11")
def group_table(spark, sf):
    return tidy_groups(_estimate(spark, sf).bands("group"), COHORT_LABELS)


@query("C10")
def pretest_wald(spark, sf):
    return _estimate(spark, sf, draws=0).pretest_wald()


FIRST_TREATED = S.TREAT_IDX[1]


@query(
    "C10",
    VARYING
    + f""", w AS (
  SELECT zip, t, y, CASE WHEN g = {FIRST_TREATED} THEN 1 ELSE 0 END AS d FROM y
  WHERE g IN ({FIRST_TREATED}, 999999) AND t BETWEEN {FIRST_TREATED - 3} AND {FIRST_TREATED - 1}
), p AS (
  SELECT a.d, b.y - a.y AS d1, c.y - b.y AS d2 FROM w a JOIN w b ON b.zip = a.zip AND b.t = a.t + 1
  JOIN w c ON c.zip = a.zip AND c.t = a.t + 2
), m AS (SELECT d, COUNT(*) AS n, AVG(d1) AS m1, AVG(d2) AS m2 FROM p GROUP BY d
), v AS (
  SELECT SUM(POWER((d1 - m1) / n, 2)) AS v11, SUM((d1 - m1) * (d2 - m2) / (n * n)) AS v12, SUM(POWER((d2 - m2) / n, 2)) AS v22
  FROM p JOIN m USING (d)
), a AS (
  SELECT SUM(CASE WHEN d = 1 THEN m1 ELSE -m1 END) AS a1, SUM(CASE WHEN d = 1 THEN m2 ELSE -m2 END) AS a2 FROM m
), s AS (SELECT (a1 * a1 * v22 - 2 * a1 * a2 * v12 + a2 * a2 * v11) / (v11 * v22 - v12 * v12) AS s FROM v CROSS JOIN a)
SELECT ROUND(s, 6) AS statistic, 2 AS df, 2 AS rank, ROUND(EXP(-s / 2), 6) AS p_value, CAST(NULL AS VARCHAR) AS note FROM s""",
)
def pretest_wald_two_cells(spark, sf):
    """The Wald test of the first cohort's two cells before treatment in a window of four months, against units never treated."""
    study = _study(spark, sf).where(F.col("cohort").isin(1, 5) & F.col("month_idx").between(FIRST_TREATED - 3, FIRST_TREATED))
    return rounded(E.estimate(study, RATE, *KEYS, draws=0).pretest_wald(), "statistic", "p_value")


@query("C14 JOB13")
def model_comparison(spark, sf):
    formulas = {"plain": (), "three": tuple(THREE)}
    stacked = models.compare_models(_study(spark, sf, *THREE), formulas)
    return side_by_side(stacked, ["level"], ["estimate", "std_error"], list(formulas))


CVM_SQL = """, n AS (SELECT COUNT(DISTINCT zip) AS n FROM y), share AS (
  SELECT x2 AS u, COUNT(DISTINCT zip) / CAST((SELECT n FROM n) AS DOUBLE) AS w FROM y GROUP BY x2
), st AS (
  SELECT cg, t, x2, SUM(d) AS n1, AVG(CASE WHEN d = 1 THEN dy END) AS m1, AVG(CASE WHEN d = 0 THEN dy END) AS m0
  FROM d WHERE t < cg GROUP BY 1, 2, 3
), j AS (
  SELECT st.cg, st.t, u, SUM(CASE WHEN x2 <= u THEN st.n1 * (m1 - m0) ELSE 0 END) / SUM(st.n1) AS j
  FROM st CROSS JOIN share GROUP BY 1, 2, 3
) SELECT ROUND(SUM((SELECT n FROM n) * j * j * w), 6) AS statistic, (SELECT n FROM n) AS n_units,
  CAST(COUNT(DISTINCT (cg, t)) AS INTEGER) AS n_cells, COUNT(DISTINCT u) AS n_points
FROM j JOIN share USING (u)"""


@query("C11", VARYING + PAIRS_SQL + CVM_SQL)
def pretest_statistic(spark, sf):
    panel = _study(spark, sf, "pct_bl_rou")
    panel = panel.withColumn("x2", F.when(F.col("pct_bl_rou") > 0.5, 1).otherwise(0))
    found = E.pretest(panel, RATE, *KEYS, covariates=["x2"])
    return rounded(found.select("statistic", "n_units", "n_cells", "n_points"), "statistic")


@query("C11")
def pretest_three_covariates(spark, sf):
    """The conditional test with three continuous covariates, all points and 1,000 draws."""
    return E.pretest(_study(spark, sf, *THREE), RATE, *KEYS, covariates=THREE)


@query("C11 C15")
def pretest_cvm(spark, sf):
    """Test rows of two covariate lists with critical values and p-values."""
    panel = _study(spark, sf, "pct_wh_17")
    formulas = {"without covariates": (), "share white": ("pct_wh_17",)}
    return models.compare_pretests(panel, formulas, unit="zip")
