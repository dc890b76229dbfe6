"""String, numeric, null and date scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog import standins as S
from panelwright.catalog.registry import query, table
from panelwright.functions import constants as K
from panelwright.functions import dates, scalars, text
from panelwright.plans.census import inflate
from panelwright.sources.scan import literal_table

AREA_SQL = """
WITH areas AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') END
           AS county_fips,
         lpad(CAST(l_partkey % 1000000 AS VARCHAR), 6, '0') AS census_tract
  FROM lineitem
)"""


def _areas(spark, sf):
    county = F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") != "R", county).alias("county_fips"),
        F.lpad((F.col("l_partkey") % 1000000).cast("string"), 6, "0").alias("census_tract"),
    )


@query(
    "X2 X8 X9 M10",
    AREA_SQL
    + """
SELECT l_orderkey, l_linenumber, '36' || county_fips || census_tract AS geoid,
       substr(census_tract, 1, 2) AS head, right('36' || census_tract, 6) AS tail
FROM areas""",
)
def area_ids(spark, sf):
    return _areas(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        text.area_id("county_fips", "census_tract", K.STATE_CODE).alias("geoid"),
        text.first_chars("census_tract", 2).alias("head"),
        text.last_chars(F.concat(F.lit("36"), "census_tract"), 6).alias("tail"),
    )


@query(
    "X1",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END
                || ' ' || o_orderpriority AS address,
              COALESCE(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END, 'NA')
                || ' ' || o_orderpriority AS address_na,
              CAST(o_custkey AS VARCHAR) || o_orderstatus AS joined
       FROM orders""",
)
def pasted_text(spark, sf):
    number = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text.join_text(number, "o_orderpriority").alias("address"),
        text.join_text(number, "o_orderpriority", null_as="NA").alias("address_na"),
        text.join_text("o_custkey", "o_orderstatus", sep="").alias("joined"),
    )


@query(
    "X6 F5",
    """SELECT p_partkey, p_type, regexp_matches(p_type, '^(?:E|P)') AS hit
       FROM part WHERE NOT regexp_matches(p_name, '^(?:s|b)')""",
)
def prefix_filters(spark, sf):
    part = table(spark, sf, "part").where(~text.has_prefix("p_name", ["s", "b"]))
    return part.select("p_partkey", "p_type", text.has_prefix("p_type", ["E", "P"]).alias("hit"))


@query(
    "X7",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996
                THEN regexp_replace('36' || CAST(o_custkey AS VARCHAR), '^36', '')
                ELSE '36' || CAST(o_custkey AS VARCHAR) END AS geoid
       FROM orders""",
)
def stripped_prefix(spark, sf):
    geoid = F.concat(F.lit("36"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text.strip_prefix_for(geoid, "36", F.year("o_orderdate") == 1996).alias("geoid"),
    )


@query(
    "X11 X12",
    """SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'Cohort 1' WHEN 1 THEN 'Cohort 2'
                WHEN 2 THEN 'Cohort 3' ELSE CAST(n_regionkey AS VARCHAR) END AS cohort,
              regexp_replace(n_name, '_1\\b', ' one') AS name
       FROM nation""",
)
def labelled_values(spark, sf):
    labels = {0: "Cohort 1", 1: "Cohort 2", 2: "Cohort 3"}
    return table(spark, sf, "nation").select(
        "n_nationkey",
        text.label("n_regionkey", labels).alias("cohort"),
        F.regexp_replace("n_name", r"_1\b", " one").alias("name"),
    )


RATIO_SQL = """
WITH sizes AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS n,
         CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END AS units
  FROM lineitem
)"""


@query(
    "M1 M2 M6 M11",
    RATIO_SQL
    + """
SELECT l_orderkey, l_linenumber, n / NULLIF(units, 0) AS ratio,
       n / NULLIF(units, 0) * 1000 AS per_1k,
       CASE WHEN n = 0 AND units = 0 THEN 0.0 ELSE n / NULLIF(units, 0) END AS ratio_zero,
       n / NULLIF(units, 0) * 100 AS pct
FROM sizes""",
)
def safe_ratios(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("n"),
        F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_linenumber")).alias("units"),
    )
    ratio = scalars.safe_ratio("n", "units")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        ratio.alias("ratio"),
        scalars.rate_per("n", "units").alias("per_1k"),
        scalars.safe_ratio("n", "units", zero_over_zero=0).alias("ratio_zero"),
        scalars.percent(ratio).alias("pct"),
    )


@query(
    "M3 M4",
    """SELECT c_custkey, ROUND(c_acctbal / 7.3, 2) AS two_digits,
              ROUND(c_acctbal / 1) * 1 AS whole, ROUND(c_acctbal / 25) * 25 AS by_25
       FROM customer""",
)
def rounded_values(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.round(F.col("c_acctbal") / 7.3, 2).alias("two_digits"),
        scalars.round_to_nearest("c_acctbal", 1).alias("whole"),
        scalars.round_to_nearest("c_acctbal", 25).alias("by_25"),
    )


PRICE_INDEX = [(y, 100.0 + 3 * (y - 1995)) for y in S.YEARS]


@query(
    "M5 M4",
    "WITH"
    + S.ANNUAL_SQL
    + """, idx AS (SELECT y AS year, 100.0 + 3 * (y - 1995) AS i FROM range(1995, 2002) AS r(y))
SELECT zip, a.year, med_hh_inc_rou,
       ROUND(med_hh_inc_rou * (CAST(118.0 AS DOUBLE) / CAST(i AS DOUBLE)), 6) AS med_hh_inc_2001_adj
FROM annual a LEFT JOIN idx ON idx.year = a.year""",
)
def inflation_adjust(spark, sf):
    index = literal_table(spark, PRICE_INDEX, "year INT, idx DOUBLE")
    annual = S.annual(spark, sf).select("zip", "year", "med_hh_inc_rou")
    adjusted = inflate(annual, {"med_hh_inc_2001_adj": "med_hh_inc_rou"}, index, to=2001)
    return adjusted.withColumn("med_hh_inc_2001_adj", F.round("med_hh_inc_2001_adj", 6))


@query(
    "M7 M9 M10",
    "WITH"
    + S.EVENTS_SQL
    + """
SELECT violationid,
       CASE zip WHEN '5' THEN '6' WHEN '17' THEN '71' ELSE zip END AS zip_recoded,
       COALESCE(zip, 'unknown') AS zip_filled,
       NULLIF(zip, '2016') AS zip_clean,
       CASE WHEN boroid = 1 THEN 'low' WHEN boroid = 5 THEN 'high' END AS band
FROM events_raw""",
)
def recoded_values(spark, sf):
    boroid = F.col("boroid")
    return S.events(spark, sf).select(
        "violationid",
        scalars.recode("zip", {"5": "6", "17": "71"}).alias("zip_recoded"),
        scalars.null_default("zip", "unknown").alias("zip_filled"),
        scalars.null_if("zip", "2016").alias("zip_clean"),
        scalars.choose((boroid == 1, F.lit("low")), (boroid == 5, F.lit("high"))).alias("band"),
    )


@query(
    "M12",
    """WITH b AS (SELECT s_suppkey, ['MN', 'BX', 'BK', 'QN', 'SI', '??'][CAST(1 + s_nationkey % 6 AS INTEGER)] AS abbr,
         ['MANHATTAN', 'BRONX', 'BROOKLYN', 'QUEENS', 'STATEN ISLAND', 'NONE'][CAST(1 + s_nationkey % 6 AS INTEGER)] AS name
       FROM supplier)
SELECT s_suppkey,
       CASE abbr WHEN 'MN' THEN 1 WHEN 'BX' THEN 2 WHEN 'BK' THEN 3 WHEN 'QN' THEN 4 WHEN 'SI' THEN 5 END AS by_abbr,
       CASE name WHEN 'MANHATTAN' THEN 1 WHEN 'BRONX' THEN 2 WHEN 'BROOKLYN' THEN 3
                 WHEN 'QUEENS' THEN 4 WHEN 'STATEN ISLAND' THEN 5 END AS by_name
FROM b""",
)
def borough_codes(spark, sf):
    abbr = S.pick(["MN", "BX", "BK", "QN", "SI", "??"], F.col("s_nationkey") % 6)
    name = S.pick([*K.BOROUGH_BY_NAME, "NONE"], F.col("s_nationkey") % 6)
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        scalars.map_values(abbr, K.BOROUGH_BY_ABBREVIATION).alias("by_abbr"),
        scalars.map_values(name, K.BOROUGH_BY_NAME).alias("by_name"),
    )


@query(
    "D1 D2 D3 D4",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS yr,
              CAST(month(o_orderdate) AS INTEGER) AS mo,
              CAST(date_trunc('month', o_orderdate) AS DATE) AS yr_mo,
              CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month_idx,
              CAST(date_trunc('month', o_orderdate) AS DATE) AS back
       FROM orders""",
)
def calendar_parts(spark, sf):
    day = dates.to_day("o_orderdate")
    idx = dates.month_idx(day)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        day.alias("day"),
        F.year(day).alias("yr"),
        F.month(day).alias("mo"),
        dates.month_start(day).alias("yr_mo"),
        idx.alias("month_idx"),
        dates.month_idx_to_date(idx).alias("back"),
    )


FLAG_SQL = (
    "WITH"
    + S.ROLLOUT_SQL
    + """, tagged AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, cohort, rtc_treat_date AS treat
  FROM orders LEFT JOIN rollout ON zip = CAST(o_custkey AS VARCHAR)
)"""
)


def _tagged(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_custkey").cast("string").alias("zip"),
    )
    return orders.join(
        S.rollout(spark, sf).withColumnRenamed("rtc_treat_date", "treat"), "zip", "left"
    )


@query(
    "D5",
    FLAG_SQL
    + """ SELECT o_orderkey, CASE WHEN treat IS NULL THEN 0 WHEN treat > day THEN 0 ELSE 1 END AS treated,
                 CASE WHEN treat > day THEN 0 ELSE 1 END AS treated_legacy FROM tagged""",
)
def treated_flag_day(spark, sf):
    return _tagged(spark, sf).select(
        "o_orderkey",
        dates.treated_flag("treat", "day", grain="day").alias("treated"),
        dates.treated_flag("treat", "day", grain="day", null_treated=True).alias("treated_legacy"),
    )


@query(
    "D5",
    FLAG_SQL
    + """ SELECT o_orderkey, CASE WHEN treat IS NULL THEN 0
            WHEN date_trunc('month', treat) > date_trunc('month', day) THEN 0 ELSE 1 END AS treated
          FROM tagged""",
)
def treated_flag_month(spark, sf):
    return _tagged(spark, sf).select(
        "o_orderkey", dates.treated_flag("treat", "day", grain="month").alias("treated")
    )


@query(
    "D6 D7 D8",
    FLAG_SQL
    + """ SELECT o_orderkey, CASE WHEN cohort < 4 THEN 1 ELSE 0 END AS ever_treated,
            CAST(CASE WHEN treat IS NULL OR treat > DATE '1998-12-31' THEN 0
                 ELSE year(treat) * 12 + month(treat) END AS INTEGER) AS first_treated
          FROM tagged
          WHERE day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""",
)
def study_window(spark, sf):
    first, last = dates.month_idx_value(1996, 1), dates.month_idx_value(1998, 12)
    inside = _tagged(spark, sf).where(dates.in_study("day", first, last))
    return inside.select(
        "o_orderkey",
        dates.ever_treated("cohort", 4).alias("ever_treated"),
        dates.first_treated_month("treat", last).alias("first_treated"),
    )
