"""Declared schemas of the input files. Nothing is inferred at read time.

Identifiers that look like numbers (ZIP, tract, area id) are text, so leading
zeros survive and no value turns into scientific notation.
"""

ROLLOUT = (
    "`Cohort` INT, `Date Added` DATE, `ZIP` STRING, `Borough` STRING, "
    "`Neighborhood` STRING, `Notes` STRING"
)
CORRECTED_ZIPS = (
    "violationid BIGINT, bbl BIGINT, housenumber STRING, streetname STRING, zip STRING, "
    "censustract STRING, boro STRING, inspectiondate DATE"
)
FAULTY_ZIPS = (
    "violationid BIGINT, bbl BIGINT, boroid INT, boro STRING, housenumber STRING, "
    "streetname STRING, zip STRING, censustract STRING, inspectiondate DATE"
)
UNIT_AREAS = "ZCTA STRING"
RENTAL_STOCK_BY_ZIP = "row STRING, zipcode STRING, unit_count_2012 BIGINT"
STABILISED_BY_ZIP = "zipcode STRING, rs_17_count BIGINT"
STABILISED_BY_TRACT = "GEOID STRING, rs_17_count BIGINT"
EVICTION_COUNTS = "count BIGINT, `Eviction Postcode` STRING"
UNCODED_VIOLATIONS = (
    "violationid BIGINT, boroid INT, address STRING, zip STRING, county_fips STRING, "
    "censustract STRING, census_tract STRING, geoid STRING"
)
UNCODED_EVICTIONS = (
    "address STRING, county_fips STRING, boroid INT, censustract STRING, "
    "census_tract STRING, geoid STRING, geoid_nyp STRING"
)
VIOLATIONS = (
    "violationid BIGINT, buildingid BIGINT, boroid INT, boro STRING, housenumber STRING, "
    "lowhousenumber STRING, highhousenumber STRING, streetname STRING, zip STRING, "
    "apartment STRING, story STRING, block STRING, lot STRING, class STRING, "
    "inspectiondate TIMESTAMP, ordernumber STRING, novdescription STRING, novtype STRING, "
    "rentimpairing STRING, latitude DOUBLE, longitude DOUBLE, censustract STRING, "
    "bin BIGINT, bbl BIGINT, nta STRING"
)
ESTIMATES = (
    "year INT, geoid STRING, name STRING, variable STRING, estimate DOUBLE, moe DOUBLE"
)
PRICE_INDEX = "year INT, idx DOUBLE"
EVICTIONS = (
    "docket_number STRING, executed_date TIMESTAMP, borough STRING, census_tract STRING, "
    "eviction_address STRING, eviction_zip STRING, latitude DOUBLE, longitude DOUBLE"
)
TAX_LOTS = (
    "bbl BIGINT, borough STRING, ct2010 STRING, zipcode STRING, bldgclass STRING, "
    "unitsres INT, yearbuilt INT"
)
COMPLAINT_KEYS = "BBL BIGINT"
AREA_RATIOS = "TRACT STRING, ZIP STRING, RES_RATIO DOUBLE"
TRACT_VINTAGES = "GEOID_TRACT_20 STRING, GEOID_TRACT_10 STRING"
TRACT_KEY = "geoid STRING, boro_code INT, ct_label STRING"
