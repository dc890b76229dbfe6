"""Addresses, area lookup, rental stock and census covariates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelwright.catalog import standins as S
from panelwright.catalog.registry import query, table
from panelwright.functions import constants as K
from panelwright.functions.text import apply_rules, normal_address
from panelwright.operators.panel import by_unit
from panelwright.plans import addresses, census, stock
from panelwright.sources.scan import literal_table


def rules_sql(text: str, rules) -> str:
    """The same ordered rules as nested SQL calls, look-arounds as captured groups."""
    for pattern, replacement in rules:
        new = replacement.replace("'", "''")
        if re.fullmatch(r"[A-Z0-9 ]+", pattern):
            text = f"replace({text}, '{pattern}', '{new}')"
            continue
        behind = re.fullmatch(r"\(\?<=(.+?)\)(.*)", pattern)
        ahead = re.fullmatch(r"([^|]*)\(\?=(.+?)\)", pattern)
        if behind:
            pattern, new = f"({behind[1]}){behind[2]}", rf"\1{new}"
        elif ahead:
            pattern, new = f"{ahead[1]}({ahead[2]})", rf"{new}\1"
        else:
            # Inside an alternation: one optional group that keeps what follows.
            kept = [m[1] for m in re.finditer(r"\(\?=(.+?)\)", pattern)]
            if kept:
                pattern = re.sub(r"\(\?=(.+?)\)", r"(\1)", pattern)
                new += "".join(f"\\{i}" for i in range(1, len(kept) + 1))
        pattern = pattern.replace(r"\p{Punct}", "[[:punct:]]")
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


ADDRESS_SQL = f"""
WITH raw AS (
  SELECT o_orderkey AS violationid, CAST(1 + o_custkey % 5 AS INTEGER) AS boroid,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL
              ELSE CAST(o_custkey AS VARCHAR) END AS housenumber,
         {S.sql_list(S.STREETS)}[CAST(1 + o_orderkey % {len(S.STREETS)} AS INTEGER)] AS streetname,
         CAST(o_custkey % 500 AS VARCHAR) AS censustract
  FROM orders
), addressed AS (
  SELECT *, {rules_sql("(housenumber || ' ' || streetname)", K.ADDRESS_RULES)} AS address FROM raw
)"""


def _raw(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("violationid"),
        (1 + F.col("o_custkey") % 5).cast("int").alias("boroid"),
        F.when(
            ~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")),
            F.col("o_custkey").cast("string"),
        ).alias("housenumber"),
        S.pick(S.STREETS, F.col("o_orderkey") % len(S.STREETS)).alias("streetname"),
        (F.col("o_custkey") % 500).cast("string").alias("censustract"),
    )


def _addressed(spark, sf):
    return addresses.event_addresses(_raw(spark, sf))


@query("JOB5 X1 X3 X5", ADDRESS_SQL + " SELECT violationid, streetname, address FROM addressed")
def standardize_address(spark, sf):
    return _addressed(spark, sf).select("violationid", "streetname", "address")


NORMAL = (
    "nullif(nullif(trim(regexp_replace(regexp_replace(upper({c}), "
    "'[!\"$%&''()*+,\\-.:;<=>?@\\[\\\\\\]^_`{{|}}~]', '', 'g'), '\\s+', ' ', 'g')), ''), 'NA')"
)
MESSY_SQL = f"""
WITH raw AS (
  SELECT o_orderkey AS docket_number,
         CAST(o_custkey AS VARCHAR) || '-' || CAST(o_custkey + 2 AS VARCHAR) || ' ' ||
         {S.sql_list(S.MESSY_STREETS)}[CAST(1 + o_orderkey % {len(S.MESSY_STREETS)} AS INTEGER)]
           AS eviction_address,
         {S.sql_list(S.MESSY_STREETS)}[CAST(1 + o_orderkey % {len(S.MESSY_STREETS)} AS INTEGER)] AS street
  FROM orders
)"""


def _messy(spark, sf):
    street = S.pick(S.MESSY_STREETS, F.col("o_orderkey") % len(S.MESSY_STREETS))
    number = F.concat(
        F.col("o_custkey").cast("string"), F.lit("-"), (F.col("o_custkey") + 2).cast("string")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("docket_number"),
        F.concat(number, F.lit(" "), street).alias("eviction_address"),
        street.alias("street"),
    )


@query(
    "X10",
    MESSY_SQL
    + f""" SELECT docket_number, {NORMAL.format(c="eviction_address")} AS address,
         {NORMAL.format(c="street")} AS street FROM raw""",
)
def normal_addresses(spark, sf):
    return _messy(spark, sf).select(
        "docket_number",
        normal_address("eviction_address").alias("address"),
        normal_address("street").alias("street"),
    )


# Blanks after AV and AVE are kept: protect them, then apply the plain alternations.
SPLIT_SQL = [
    (r"STREE T|S TREET|STRE ET|ST REET|STR EET", "ST"),
    (r"STREE(?=[[:punct:]])", "ST"),
    (r"A VENUE|AV ENUE|AVE NUE|AVEN UE|AVENU E", "AVE"),
    (r"AV(?= )", "AVE"),
    (r"P ARKWAY|PA RKWAY|PAR KWAY|PARKW AY|PKWY", "PKWY"),
    (r"CONC OURSE", "CONCOURSE"),
]


@query(
    "X4 X10 JOB10",
    MESSY_SQL
    + f""" SELECT docket_number, {rules_sql(NORMAL.format(c="eviction_address"), SPLIT_SQL)} AS address
       FROM raw""",
)
def split_word_addresses(spark, sf):
    return addresses.eviction_addresses(_messy(spark, sf)).select("docket_number", "address")


@query(
    "X4",
    MESSY_SQL
    + f""" SELECT docket_number, {rules_sql(NORMAL.format(c="eviction_address"), [
        (r"STREE T|S TREET|STRE ET|ST REET|STR EET", "ST"), (r"STREE(?=[[:punct:]])", "ST"),
        *K.SPLIT_WORD_RULES_LEGACY[1:]])} AS address FROM raw""",
)
def split_word_addresses_legacy(spark, sf):
    found = addresses.eviction_addresses(_messy(spark, sf), legacy_rules=True)
    return found.select("docket_number", "address")


TEXT_RULES = [
    (r"the(?=\s)", "THE"),
    (r"(?<=\s)on", "ON"),
    (r"ent|ion", "-"),
    (r"HEIN", "IN"),
]


@query(
    "X3 X5 X12",
    f"SELECT doc_id, md5({rules_sql('text', TEXT_RULES)}) AS digest, "
    f"CAST(length({rules_sql('text', TEXT_RULES)}) AS INTEGER) AS n FROM documents",
)
def rules_on_documents(spark, sf):
    ruled = apply_rules("text", TEXT_RULES)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(ruled).alias("digest"), F.length(ruled).alias("n")
    )


CODED_SQL = """, coded AS (
  SELECT address, lpad(CAST(boroid * 2 + 1 AS VARCHAR), 3, '0') AS county_fips,
         lpad(censustract, 6, '0') AS census_tract
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY address ORDER BY violationid) AS rn FROM addressed
        WHERE streetname <> 'BROADWAY' AND streetname <> 'WALTON AVENUE' AND address IS NOT NULL)
  WHERE rn = 1
), tract_key AS (
  SELECT DISTINCT CAST(1 + c_custkey % 5 AS INTEGER) AS boroid, CAST(c_custkey % 500 AS VARCHAR) AS censustract,
         '36999' || lpad(CAST(c_custkey % 500 AS VARCHAR), 6, '0') AS geoid_nyp
  FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 5000
), firsts AS (
  SELECT violationid, boroid, address, censustract FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY address ORDER BY violationid) AS rn FROM addressed)
  WHERE rn = 1
), enriched AS (
  SELECT f.*, county_fips, census_tract,
         COALESCE('36' || county_fips || census_tract, geoid_nyp) AS geoid
  FROM firsts f LEFT JOIN coded c ON c.address = f.address
  LEFT JOIN tract_key k ON k.boroid = f.boroid AND k.censustract = f.censustract
)"""


def _coded(distinct):
    """The address table: county and tract of all but two streets."""
    listed = distinct.where(
        (F.col("streetname") != "BROADWAY")
        & (F.col("streetname") != "WALTON AVENUE")
        & F.col("address").isNotNull()
    )
    return listed.select(
        "address",
        F.lpad((F.col("boroid") * 2 + 1).cast("string"), 3, "0").alias("county_fips"),
        F.lpad("censustract", 6, "0").alias("census_tract"),
    )


def _tract_key(spark, sf):
    key = F.col("c_custkey")
    kept = table(spark, sf, "customer").where(
        (F.col("c_mktsegment") != "MACHINERY") & (F.col("c_acctbal") > 5000)
    )
    return kept.select(
        (1 + key % 5).cast("int").alias("boroid"),
        (key % 500).cast("string").alias("censustract"),
        F.concat(F.lit("36999"), F.lpad((key % 500).cast("string"), 6, "0")).alias("geoid_nyp"),
    ).distinct()


def _enriched(spark, sf):
    distinct = addresses.distinct_event_addresses(_raw(spark, sf), ["violationid"])
    columns = ["violationid", "boroid", "address", "censustract"]
    return addresses.enrich(
        distinct.select(*columns), _coded(distinct), _tract_key(spark, sf)
    ).select(*columns, "county_fips", "census_tract", "geoid")


@query("JOB6 W8 J1 J6 X2", ADDRESS_SQL + CODED_SQL + " SELECT * FROM enriched")
def geocoded_addresses(spark, sf):
    return _enriched(spark, sf)


@query("JOB6 J7 S13", ADDRESS_SQL + CODED_SQL + " SELECT * FROM enriched WHERE geoid IS NULL")
def uncoded_report(spark, sf):
    return addresses.uncoded(_enriched(spark, sf))


@query(
    "JOB10 J1 A2",
    ADDRESS_SQL
    + CODED_SQL
    + """ SELECT geoid, COUNT(DISTINCT violationid) AS evictions_per_tract
FROM (SELECT a.violationid, e.geoid FROM addressed a LEFT JOIN enriched e ON e.address = a.address)
GROUP BY geoid""",
)
def events_by_area(spark, sf):
    return addresses.events_by_area(
        _addressed(spark, sf), _enriched(spark, sf), event_id="violationid"
    )


@query("A16 A1", ADDRESS_SQL + " SELECT address, COUNT(*) AS records FROM addressed GROUP BY address")
def address_frequency(spark, sf):
    return addresses.address_frequency(_addressed(spark, sf))


@query(
    "M12 JOB6",
    f"""SELECT o_orderkey, {S.sql_list([*K.BOROUGH_BY_NAME, 'ELSEWHERE'])}[CAST(1 + o_custkey % 6 AS INTEGER)] AS borough,
        CASE WHEN o_custkey % 6 < 5 THEN CAST(1 + o_custkey % 6 AS INTEGER) END AS boroid FROM orders""",
)
def eviction_boroughs(spark, sf):
    named = table(spark, sf, "orders").select(
        "o_orderkey", S.pick([*K.BOROUGH_BY_NAME, "ELSEWHERE"], F.col("o_custkey") % 6).alias("borough")
    )
    return addresses.borough_ids(named)


# --- rental stock --------------------------------------------------------------------

CLASSES = ["A1", "A0", "B1", "B2", "C0", "C6", "D1", "D5", "S1", "Z9", "K1", "R4", "O3", "C1", "E7"]
LOTS_SQL = f"""
WITH lots AS (
  SELECT p_partkey AS bbl, ['MN', 'BX', 'BK', 'QN', 'SI'][CAST(1 + p_size % 5 AS INTEGER)] AS borough,
         CAST(p_size AS VARCHAR) AS ct2010, p_brand AS zipcode,
         {S.sql_list(CLASSES)}[CAST(1 + p_partkey % {len(CLASSES)} AS INTEGER)] AS bldgclass,
         CAST(p_size - 5 AS INTEGER) AS unitsres, CAST(1900 + p_partkey % 120 AS INTEGER) AS yearbuilt
  FROM part
), flags AS (
  SELECT DISTINCT l_partkey AS bbl, 1 AS possible_rental FROM lineitem
  WHERE l_partkey <> 0 AND l_returnflag = 'R' AND l_quantity > 45
), flagged AS (
  SELECT l.*, possible_rental FROM lots l LEFT JOIN flags f ON f.bbl = l.bbl WHERE unitsres > 0
), stock AS (
  SELECT bbl, zipcode, bldgclass, unitsres, yearbuilt, possible_rental,
         CASE borough WHEN 'MN' THEN '1' WHEN 'BX' THEN '2' WHEN 'BK' THEN '3' WHEN 'QN' THEN '4'
              WHEN 'SI' THEN '5' END || ct2010 AS tract_2010
  FROM flagged
  WHERE yearbuilt < 2013
    AND NOT regexp_matches(bldgclass, '^[{"".join(K.DROPPED_CLASS_PREFIXES)}]')
    AND bldgclass NOT IN ({", ".join(f"'{c}'" for c in K.DROPPED_CLASSES)})
    AND NOT (regexp_matches(bldgclass, '^[AB]') AND possible_rental IS NULL)
)"""


def _flagged(spark, sf):
    key = F.col("p_partkey")
    lots = table(spark, sf, "part").select(
        key.alias("bbl"),
        S.pick(list(K.BOROUGH_BY_ABBREVIATION), F.col("p_size") % 5).alias("borough"),
        F.col("p_size").cast("string").alias("ct2010"),
        F.col("p_brand").alias("zipcode"),
        S.pick(CLASSES, key % len(CLASSES)).alias("bldgclass"),
        (F.col("p_size") - 5).cast("int").alias("unitsres"),
        (1900 + key % 120).cast("int").alias("yearbuilt"),
    )
    complaints = table(spark, sf, "lineitem").where(
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    )
    return stock.flag_lots(lots, stock.complaint_flags(complaints.select(F.col("l_partkey").alias("BBL"))))


@query("JOB8 F5 F6 F4 M12 J3", LOTS_SQL + " SELECT * FROM stock")
def class_filters(spark, sf):
    return stock.rental_stock(_flagged(spark, sf))


@query(
    "JOB8 A5",
    LOTS_SQL
    + """ SELECT bldgclass, COALESCE(CAST(SUM(possible_rental) AS BIGINT), 0) AS flagged_lots,
         CAST(SUM(unitsres) AS BIGINT) AS units FROM flagged GROUP BY bldgclass""",
)
def units_by_class(spark, sf):
    return stock.class_counts(_flagged(spark, sf))


@query(
    "JOB8 A4 A10",
    LOTS_SQL
    + " SELECT tract_2010, zipcode, CAST(SUM(unitsres) AS BIGINT) AS unit_count_2012 FROM stock GROUP BY 1, 2",
)
def units_by_tract_zip(spark, sf):
    return stock.stock_by(stock.rental_stock(_flagged(spark, sf)), "tract_2010", "zipcode")


@query(
    "JOB8 A4",
    LOTS_SQL
    + " SELECT zipcode, CAST(SUM(unitsres) AS BIGINT) AS unit_count_2012 FROM stock GROUP BY 1",
)
def units_by_zip(spark, sf):
    return stock.stock_by(stock.rental_stock(_flagged(spark, sf)), "zipcode")


@query("JOB8 A8", LOTS_SQL + " SELECT CAST(SUM(unitsres) AS BIGINT) AS units FROM stock")
def total_units(spark, sf):
    return stock.total_units(stock.rental_stock(_flagged(spark, sf)))


# --- census --------------------------------------------------------------------------

VARIABLES = list(K.ESTIMATE_NAMES)
INDEX = {y: 100.0 + 3 * (y - 1995) for y in S.YEARS}
CENSUS_SQL = f"""
WITH long AS (
  SELECT CAST(y AS INTEGER) AS year, CAST(c_custkey AS VARCHAR) AS geoid, k, variable,
         CASE WHEN k IN (5, 7) AND c_custkey % 29 = 0 AND y = 1999 THEN NULL
              ELSE CAST((c_custkey * (k + 3) + y * 7) % 997 AS DOUBLE) END AS estimate
  FROM customer CROSS JOIN range(1995, 2002) AS r(y)
  CROSS JOIN (SELECT unnest({S.sql_list(VARIABLES)}) AS variable, unnest(range(0, 17)) AS k) v
  WHERE c_nationkey < 20
), idx AS (SELECT y AS year, CAST(100 + 3 * (y - 1995) AS DOUBLE) AS i FROM range(1995, 2002) AS r(y)
), wide AS (
  SELECT year, geoid, {", ".join(f"MAX(CASE WHEN variable = '{c}' THEN estimate END) AS {n}" for c, n in K.ESTIMATE_NAMES.items())}
  FROM long GROUP BY 1, 2
), real AS (
  SELECT w.*, ROUND(med_gross_rent * (CAST(118 AS DOUBLE) / i)) * 1 AS med_gross_rent_2020_adj,
         ROUND(med_hh_inc_rou * (CAST(118 AS DOUBLE) / i)) * 1 AS med_hh_inc_rou_2020_adj
  FROM wide w JOIN idx ON idx.year = w.year
)
SELECT year, geoid,
  {", ".join(n for n in K.ESTIMATE_NAMES.values() if n not in K.FILLED_ESTIMATES)},
  med_gross_rent_2020_adj,
  {", ".join(f"LAST_VALUE({c} IGNORE NULLS) OVER w AS {c}" for c in K.FILLED_ESTIMATES)},
  {", ".join(f"{a} / NULLIF({b}, 0) AS {n}" for n, (a, b) in K.ESTIMATE_SHARES.items())}
FROM real WINDOW w AS (PARTITION BY geoid ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("JOB9 S7 S8 J4 P3 P4 M1 M4 M5 W5 X7", CENSUS_SQL)
def census_covariates(spark, sf):
    key = F.col("c_custkey")
    customer = table(spark, sf, "customer")
    variables = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(v).alias("variable")) for k, v in enumerate(VARIABLES)]
    )
    years = F.explode(F.array(*[F.lit(y) for y in S.YEARS])).alias("year")
    # Dealt out before years and variables multiply the rows: the file is small enough for a single task.
    rows = by_unit(customer.select("c_custkey"), "c_custkey").select("c_custkey", years).select("c_custkey", "year", F.inline(variables))
    missing = F.col("k").isin(5, 7) & (key % 29 == 0) & (F.col("year") == 1999)
    value = ((key * (F.col("k") + 3) + F.col("year") * 7) % 997).cast("double")
    # Ids of the first year carry the state prefix, as delivered.
    geoid = F.concat(F.when(F.col("year") == 1995, "36").otherwise(""), key.cast("string"))
    estimates = rows.select(
        "year", geoid.alias("geoid"), "variable", F.when(~missing, value).alias("estimate")
    )
    listed = customer.where(F.col("c_nationkey") < 20).select(key.cast("string").alias("geoid"))
    index = literal_table(spark, list(INDEX.items()), "year INT, idx DOUBLE")
    return census.census_covariates(
        estimates, index, units=listed, digits=None, prefix_year=1995, price_year=2001
    )
