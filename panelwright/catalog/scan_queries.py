"""Scans, schema operators and filters."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from panelwright.catalog import standins as S
from panelwright.catalog.registry import query, table
from panelwright.functions.scalars import finite_or, try_number
from panelwright.functions.text import first_chars
from panelwright.operators import filters, schema_ops
from panelwright.operators.order import sort_rows
from panelwright.session import shared_folder
from panelwright.sources import scan, sink


@query(
    "S4 F1 F4 P1",
    """SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-05-31 00:00:00'
         AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def scan_filter_in(spark, sf):
    wanted = scan.date_and_code_filter(
        "o_orderdate", dt.datetime(1996, 1, 1), dt.datetime(1999, 5, 31),
        "o_orderpriority", ["1-URGENT", "2-HIGH"],
    )
    columns = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]
    return scan.scan(spark, f"{sf}/orders.parquet", where=wanted, columns=columns)


@query(
    "S5 F1 P1",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1997-07-31'""",
)
def scan_date_range(spark, sf):
    wanted = scan.between_dates("l_shipdate", dt.datetime(1997, 1, 1), dt.datetime(1997, 7, 31))
    columns = ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"]
    return scan.scan(spark, f"{sf}/lineitem.parquet", where=wanted, columns=columns)


@query("S6 O1", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem ORDER BY 1, 2")
def distinct_keys(spark, sf):
    return scan.distinct_keys(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query(
    "S7 U2",
    """SELECT CAST(y AS INTEGER) AS year, o_orderkey, o_totalprice
       FROM orders JOIN range(1995, 2002) AS r(y) ON year(o_orderdate) = y""",
)
def union_years(spark, sf):
    orders = table(spark, sf, "orders")
    by_year = {
        y: orders.where(
            (F.col("o_orderdate") >= dt.datetime(y, 1, 1))
            & (F.col("o_orderdate") < dt.datetime(y + 1, 1, 1))
        ).select("o_orderkey", "o_totalprice")
        for y in S.YEARS
    }
    return scan.union_years(by_year)


ESTIMATES_SQL = """
WITH estimates AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS geoid, l_returnflag AS variable,
         SUM(l_quantity) AS estimate, MAX(l_quantity) AS moe
  FROM lineitem GROUP BY 1, 2, 3
)"""


def _estimates(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.year("l_shipdate").alias("year"),
            F.col("l_suppkey").alias("geoid"),
            F.col("l_returnflag").alias("variable"),
        )
        .agg(F.sum("l_quantity").alias("estimate"), F.max("l_quantity").alias("moe"))
    )


@query(
    "S8",
    ESTIMATES_SQL
    + """
SELECT year, geoid, MAX(CASE WHEN variable = 'A' THEN estimate END) AS "AE",
       MAX(CASE WHEN variable = 'A' THEN moe END) AS "AM",
       MAX(CASE WHEN variable = 'N' THEN estimate END) AS "NE",
       MAX(CASE WHEN variable = 'N' THEN moe END) AS "NM",
       MAX(CASE WHEN variable = 'R' THEN estimate END) AS "RE",
       MAX(CASE WHEN variable = 'R' THEN moe END) AS "RM"
FROM estimates GROUP BY 1, 2""",
)
def wide_estimates_pivot(spark, sf):
    return scan.pivot_estimates(_estimates(spark, sf), ["A", "N", "R"], margin="moe")


@query(
    "P3 P4",
    ESTIMATES_SQL
    + """
SELECT year, geoid, MAX(CASE WHEN variable = 'A' THEN estimate END) AS accepted,
       MAX(CASE WHEN variable = 'N' THEN estimate END) AS not_yet,
       MAX(CASE WHEN variable = 'R' THEN estimate END) AS returned
FROM estimates GROUP BY 1, 2""",
)
def estimates_renamed(spark, sf):
    wide = scan.pivot_estimates(_estimates(spark, sf), ["A", "N", "R"], margin="moe")
    names = {"AE": "accepted", "NE": "not_yet", "RE": "returned"}
    return schema_ops.rename(schema_ops.drop_suffix(wide, "m"), names)


@query(
    "S9",
    """SELECT n_name, cohort, label FROM nation JOIN (VALUES (0, 1, 'Aug. 1997'), (1, 2, 'Oct. 1997'),
         (2, 3, 'Nov. 1998'), (3, 4, 'Dec. 1999')) AS w(region, cohort, label)
       ON n_regionkey = region""",
)
def literal_table_join(spark, sf):
    rows = [(0, 1, "Aug. 1997"), (1, 2, "Oct. 1997"), (2, 3, "Nov. 1998"), (3, 4, "Dec. 1999")]
    waves = scan.literal_table(spark, rows, "region INT, cohort INT, label STRING")
    nation = table(spark, sf, "nation")
    return nation.join(waves, F.col("n_regionkey") == F.col("region")).select(
        "n_name", "cohort", "label"
    )


@query("P2", "SELECT p_partkey, p_brand, p_size FROM part")
def dropped_columns(spark, sf):
    return table(spark, sf, "part").drop("p_name", "p_type", "p_retailprice")


@query(
    "P5 P6 P7",
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
              l_extendedprice * (1 - l_discount) AS net_price FROM lineitem""",
)
def derived_columns(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"
    )
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return schema_ops.derive(lines, {"net_price": net}, after="l_extendedprice", drop=["l_discount"])


@query(
    "P8",
    """SELECT p_partkey AS part_key, p_brand AS brand_name, p_size AS size_mm,
              p_type AS type, p_name AS type_2 FROM part""",
)
def snake_cased_names(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("Part Key"), F.col("p_brand").alias("brandName"),
        F.col("p_size").alias("Size (mm)"), F.col("p_type").alias("Type"),
        F.col("p_name").alias("type"),
    )
    return schema_ops.snake_names(part)


@query(
    "P9",
    """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 1 END AS half
       FROM orders""",
)
def drop_constant_columns(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.lit("x").alias("same"),
        F.lit(None).cast("int").alias("empty"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(1).alias("half"),
    )
    return schema_ops.drop_constant(orders)


@query(
    "P10",
    """SELECT o_orderkey, TRY_CAST(o_orderpriority AS DOUBLE) AS priority_text,
              TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
              CAST(o_custkey AS VARCHAR) AS zip FROM orders""",
)
def lenient_casts(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        try_number("o_orderpriority").alias("priority_text"),
        first_chars("o_orderpriority", 1).alias("priority"),
        F.col("o_custkey").alias("zip"),
    )
    return schema_ops.cast_columns(orders, {"priority": "int", "zip": "string"})


@query(
    "P11 M8 M11",
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS price,
              CASE WHEN o_custkey % 5 = 0 THEN 0.0 ELSE o_totalprice / 2 END AS half_price
       FROM orders""",
)
def nan_to_zero(spark, sf):
    nan, infinite = F.lit(float("nan")), F.lit(float("inf"))
    price = F.col("o_totalprice")
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 3 == 0, nan).otherwise(price).alias("price"),
        F.when(F.col("o_custkey") % 5 == 0, infinite).otherwise(price / 2).alias("half_price"),
    )
    return schema_ops.map_numeric(orders, lambda c: finite_or(c, 0.0))


@query(
    "P12",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS price,
              CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS customer FROM orders""",
)
def nulls_to_zero(spark, sf):
    status = F.col("o_orderstatus")
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status != "P", F.col("o_totalprice")).alias("price"),
        F.when(status != "F", F.col("o_custkey")).alias("customer"),
    )
    return schema_ops.fill_nulls(orders, 0)


@query("F1", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 20")
def range_filter(spark, sf):
    supplier = table(spark, sf, "supplier")
    return supplier.where((F.col("s_acctbal") > 0) & (F.col("s_nationkey") < 20)).select(
        "s_suppkey", "s_acctbal"
    )


@query(
    "F2",
    "WITH"
    + S.EVENTS_SQL
    + """
SELECT violationid, zip FROM events_raw WHERE zip <> '2016' AND boroid <> 4 AND boroid <> 5""",
)
def not_equal_filter(spark, sf):
    events = S.events(spark, sf)
    return events.where(
        (F.col("zip") != "2016") & (F.col("boroid") != 4) & (F.col("boroid") != 5)
    ).select("violationid", "zip")


@query(
    "F4",
    "WITH"
    + S.EVENTS_SQL
    + """
SELECT violationid, zip FROM events_raw WHERE COALESCE(zip IN ('2016', '112226'), FALSE) = FALSE""",
)
def not_in_keeps_missing(spark, sf):
    events = S.events(spark, sf)
    return events.where(filters.not_in("zip", ["2016", "112226"])).select("violationid", "zip")


@query(
    "F7",
    "WITH"
    + S.EVENTS_SQL
    + """
SELECT violationid, zip IS NULL AS zip_missing FROM events_raw
WHERE zip IS NULL OR (zip IS NOT NULL AND boroid = 1)""",
)
def null_filters(spark, sf):
    events = S.events(spark, sf)
    missing = F.col("zip").isNull()
    return events.where(missing | (F.col("zip").isNotNull() & (F.col("boroid") == 1))).select(
        "violationid", missing.alias("zip_missing")
    )


@query(
    "F8 O1",
    "WITH"
    + S.ANNUAL_SQL
    + ","
    + S.UNIT_FACTS_SQL
    + """
SELECT a.zip, year, med_hh_inc_rou, rs_17 FROM annual a LEFT JOIN stabilised s ON s.zip = a.zip
WHERE med_hh_inc_rou IS NULL OR rs_17 IS NULL""",
)
def any_null_rows(spark, sf):
    joined = S.annual(spark, sf).join(S.stabilised(spark, sf), "zip", "left")
    found = filters.rows_with_nulls(joined.select("zip", "year", "med_hh_inc_rou", "rs_17"))
    return sort_rows(found, "zip", "year")


@query(
    "F9 D1",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
       WHERE o_orderdate <= TIMESTAMP '1999-05-31' AND o_custkey >= 36 AND o_custkey < 370""",
)
def typed_comparisons(spark, sf):
    orders = table(spark, sf, "orders")
    last = F.lit(dt.date(1999, 5, 31))
    kept = orders.where(
        (F.col("o_orderdate") <= last) & (F.col("o_custkey") >= 36) & (F.col("o_custkey") < 370)
    )
    return kept.select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))


@query(
    "O1",
    "WITH" + S.EVENTS_SQL + " SELECT zip, violationid FROM events_raw ORDER BY zip NULLS LAST, violationid",
)
def sorted_ascending(spark, sf):
    return sort_rows(S.events(spark, sf).select("zip", "violationid"), "zip", "violationid")


# --- files: written to the shared folder, then read back --------------------------------

ROUND_TRIP_SQL = (
    "WITH"
    + S.EVENTS_SQL
    + """
SELECT violationid, boroid, zip, inspectiondate, ordernumber FROM events_clean"""
)
ROUND_TRIP_SCHEMA = (
    "violationid BIGINT, boroid INT, zip STRING, inspectiondate DATE, ordernumber STRING"
)


def _new_folder(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _dated(spark, sf):
    events = S.events(spark, sf).drop("agency")
    return events.withColumn("inspectiondate", F.col("inspectiondate").cast("date"))


@query("S1 S2 S10", ROUND_TRIP_SQL)
def csv_gzip_round_trip(spark, sf):
    folder = _new_folder(spark)
    sink.sink(_dated(spark, sf), folder, fmt="csv")
    return scan.scan(spark, folder, ROUND_TRIP_SCHEMA)


@query("S3", ROUND_TRIP_SQL)
def piped_round_trip(spark, sf):
    folder = _new_folder(spark)
    _dated(spark, sf).write.csv(folder, header=True, sep="|", nullValue="NA")
    return scan.scan_piped(spark, folder, ROUND_TRIP_SCHEMA)


@query(
    "S12 S13",
    ROUND_TRIP_SQL.replace("SELECT violationid, boroid, zip, inspectiondate, ordernumber FROM", "SELECT 'kept' AS part, violationid, zip FROM")
    + " WHERE zip <> '2016' UNION ALL SELECT 'faulty', violationid, zip FROM events_clean WHERE zip = '2016' OR zip IS NULL",
)
def saved_results(spark, sf):
    folder = _new_folder(spark)
    events = _dated(spark, sf).select("violationid", "zip")
    bad = (F.col("zip") == "2016") | F.col("zip").isNull()
    sink.sink_exceptions(events, bad, f"{folder}/report")
    faulty = scan.scan(spark, f"{folder}/report", "violationid BIGINT, zip STRING")
    sink.save_results({"kept": events.where(F.col("zip") != "2016"), "faulty": faulty}, folder)
    parts = sink.load_results(spark, folder, ["kept", "faulty"])
    return scan.union_all(df.select(F.lit(n).alias("part"), "*") for n, df in parts.items())
