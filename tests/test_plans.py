"""Composite jobs on hand-written tables in the shape of the published files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.functions import constants as K
from panelwright.plans import addresses, areas, census, events, models, panels, stock, tables
from panelwright.sources import schemas
from panelwright.sources.scan import literal_table


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


@pytest.fixture(scope="module")
def rollout(spark):
    data = [
        (1, dt.date(2017, 8, 11), "10026", "Manhattan", "Harlem", None),
        (2, dt.date(2017, 10, 1), "10027", "Manhattan", "Harlem", None),
        (4, dt.date(2019, 12, 1), "10028", "Manhattan", "Yorkville", None),
        (5, dt.date(2021, 5, 11), "all others", None, None, None),
    ]
    return spark.createDataFrame(data, schemas.ROLLOUT)


def test_rollout_drops_the_row_for_all_others(rollout):
    assert rows(events.rollout_table(rollout), "cohort", "zip") == [
        (1, "10026"), (2, "10027"), (4, "10028"),
    ]
    assert events.rollout_table(rollout, drop_cohorts=()).count() == 3


def test_clean_and_tag(spark, rollout):
    raw = spark.createDataFrame(
        [
            (1, "10026", dt.datetime(2017, 8, 10, 9), "577", "HPD"),
            (2, "10026", dt.datetime(2017, 8, 11, 9), "664", "HPD"),
            (3, None, dt.datetime(2018, 1, 1, 0), "664", "HPD"),
            (4, "99999", dt.datetime(2021, 6, 1, 0), "664", "HPD"),
        ],
        "violationid BIGINT, zip STRING, inspectiondate TIMESTAMP, ordernumber STRING, boro STRING",
    )
    cleaned = events.clean_events(raw, drop_constants=True)
    assert "boro" not in cleaned.columns and "month_idx" in cleaned.columns
    tagged = events.tag_treatment(cleaned, events.rollout_table(rollout))
    assert rows(tagged, "violationid", "cohort", "treated") == [
        (1, 1, 0), (2, 1, 1), (3, 5, 0), (4, 5, 1),
    ]
    assert rows(events.faulty_records(cleaned), "violationid") == [(3,)]


@pytest.fixture(scope="module")
def small_panel(spark, rollout):
    data = [(i, z, dt.date(2017, m, 1)) for i, (z, m) in enumerate(
        [("10026", 7), ("10026", 8), ("10026", 8), ("10027", 9), ("10029", 11)]
    )]
    ev = spark.createDataFrame(data, "violationid BIGINT, zip STRING, inspection_yr_mo DATE")
    annual = spark.createDataFrame(
        [("10026", 2017, 100, 0.2, 0.6), ("10027", 2017, 0, 0.1, 0.3), ("10029", 2016, 50, 0.1, 0.1)],
        "zip STRING, year INT, renter_occ_units INT, pct_pov DOUBLE, pct_wh_rou DOUBLE",
    )
    evict = spark.createDataFrame([("10026", 5), ("10027", 2)], "zip STRING, evicts_17 BIGINT")
    rs = spark.createDataFrame([("10026", 40)], "zip STRING, rs_17 BIGINT")
    return panels.zip_panel(ev, annual, evict, rs, events.rollout_table(rollout))


def test_zip_panel(small_panel):
    found = {(r["zip"], r["inspection_yr_mo"].month): r for r in small_panel.collect()}
    assert len(found) == 3 * 4
    august = found["10026", 8]
    assert august["n_violations"] == 2 and august["n_violations_per_1k_units"] == 20.0
    assert august["evict_rate_17"] == 0.05 and august["rs_rate_17"] == 0.4
    assert august["treated"] == 1 and found["10026", 7]["treated"] == 0
    assert found["10027", 9]["n_violations_per_1k_units"] is None      # n / 0
    assert found["10027", 9]["evict_rate_17"] is None
    assert found["10029", 11]["pct_pov_17"] is None                    # no baseline year
    assert found["10029", 11]["cohort"] == 5
    day = [r for r in small_panel.collect() if r["zip"] == "10029"]
    assert all(r["rtc_treat_date"] == dt.date(2021, 5, 11) for r in day)


def test_zero_over_zero_policy(spark, rollout):
    ev = spark.createDataFrame(
        [(1, "a", dt.date(2017, 1, 1)), (2, "b", dt.date(2017, 2, 1))],
        "violationid BIGINT, zip STRING, inspection_yr_mo DATE",
    )
    annual = spark.createDataFrame(
        [("a", 2017, 0, 0.1, 0.1), ("b", 2017, 10, 0.1, 0.1)],
        "zip STRING, year INT, renter_occ_units INT, pct_pov DOUBLE, pct_wh_rou DOUBLE",
    )
    none = spark.createDataFrame([], "zip STRING, evicts_17 BIGINT")
    rs = spark.createDataFrame([], "zip STRING, rs_17 BIGINT")
    made = panels.zip_panel(ev, annual, none, rs, events.rollout_table(rollout), zero_over_zero=0)
    found = {(r["zip"], r["inspection_yr_mo"].month): r["n_violations_per_1k_units"] for r in made.collect()}
    assert found == {("a", 1): None, ("a", 2): 0.0, ("b", 1): 0.0, ("b", 2): 100.0}


def test_study_window_recodes_late_cohorts(small_panel):
    study = panels.study_panel(small_panel, 2017 * 12 + 7, 2017 * 12 + 9)
    found = {r["zip"]: r["treat_idx"] for r in study.collect()}
    assert found == {"10026": 2017 * 12 + 8, "10027": 0, "10029": 0}
    assert study.agg(F.max("month_idx")).first()[0] == 2017 * 12 + 9


def test_missing_by_unit(small_panel):
    found = events.missing_by_unit(small_panel, "zip", ["rs_rate_17", "n_violations_per_1k_units"])
    assert ("n_violations_per_1k_units", "10027", 4) in rows(found)
    assert ("rs_rate_17", "10026", 4) not in rows(found)


def test_crosswalk(spark):
    ratios = spark.createDataFrame(
        [
            ("36005000100", "10451", 0.7), ("36005000100", "10452", 0.3),
            ("36047000200", "11201", 0.5), ("36047000200", "11202", 0.5),
            ("36061000300", "10001", 0.0), ("34001000400", "07001", 1.0),
            ("36119000500", "10701", 1.0),
        ],
        "tract STRING, zip STRING, res_ratio DOUBLE",
    )
    city = areas.city_ratios(ratios)
    assert city.count() == 5
    treated = spark.createDataFrame([("10452",), ("11201",), ("11202",)], "zip STRING")
    found = areas.assign_area(city, treated)
    assert rows(found) == [
        ("36005000100", "10451", 0.7, True), ("36047000200", "11201", 0.5, False),
    ]
    assert areas.assign_area(city, treated, ties="all").count() == 3
    vintage = spark.createDataFrame([("36005000101", "36005000100", "x")], "GEOID_TRACT_20 STRING, GEOID_TRACT_10 STRING, z STRING")
    assert rows(areas.tract_vintages(vintage)) == [("36005000101", "36005000100", "000100", "000101")]


def test_enrichment_and_uncoded_report(spark):
    evs = spark.createDataFrame(
        [
            (2, 1, "5", "EAST 6 STREET", "38"), (1, 1, "5", "EAST 6 STREET", "38"),
            (3, 2, "7", "WALTON AVENUE", "63"), (4, 2, None, "NOWHERE", "1"),
        ],
        "violationid BIGINT, boroid INT, housenumber STRING, streetname STRING, censustract STRING",
    )
    distinct = addresses.distinct_event_addresses(evs, ["violationid"])
    assert rows(distinct, "violationid", "address") == [
        (1, "5 EAST 6TH ST"), (3, "7 WALTON AVE"), (4, None),
    ]
    coded = spark.createDataFrame([("5 EAST 6TH ST", "061", "003800")], "address STRING, county_fips STRING, census_tract STRING")
    key = spark.createDataFrame([(2, "63", "36005006300")], "boroid INT, censustract STRING, geoid_nyp STRING")
    found = addresses.enrich(distinct, coded, key)
    assert rows(found, "violationid", "geoid") == [(1, "36061003800"), (3, "36005006300"), (4, None)]
    assert rows(addresses.uncoded(found), "violationid") == [(4,)]


def test_events_by_area(spark):
    evictions = spark.createDataFrame(
        [("d1", "5 EAST 6th STREE T", "BRONX"), ("d2", "5 East 6th Street.", "QUEENS"), ("d2", "5 East 6th Street", "X")],
        "docket_number STRING, eviction_address STRING, borough STRING",
    )
    located = addresses.eviction_addresses(evictions)
    assert rows(addresses.borough_ids(located), "boroid") == [(2,), (4,), (None,)]
    coded = spark.createDataFrame([("5 EAST 6TH STREET", "g")], "address STRING, geoid STRING")
    found = addresses.events_by_area(located, coded)
    assert rows(found) == [("g", 1), (None, 1)]


def test_rental_stock(spark):
    lots = spark.createDataFrame(
        [
            (1, "MN", "100", "10001", "C1", 10, 1950), (2, "MN", "100", "10001", "A1", 2, 1950),
            (3, "BX", "200", "10451", "B1", 2, 1950), (4, "BX", "200", "10451", "R4", 50, 1950),
            (5, "BK", "300", "11201", "C6", 20, 1950), (6, "QN", "400", "11101", "D1", 99, 2013),
            (7, "SI", "500", "10301", "S1", 0, 1950), (8, "SI", "500", "10301", "S1", 3, 1950),
        ],
        schemas.TAX_LOTS,
    )
    complaints = spark.createDataFrame([(3,), (0,), (3,)], schemas.COMPLAINT_KEYS)
    flagged = stock.flag_lots(lots, stock.complaint_flags(complaints))
    assert flagged.count() == 7
    kept = stock.rental_stock(flagged)
    assert rows(kept, "bbl", "tract_2010") == [(1, "1100"), (3, "2200"), (8, "5500")]
    assert stock.total_units(kept).first()["units"] == 15
    assert rows(stock.stock_by(kept, "zipcode")) == [("10001", 10), ("10301", 3), ("10451", 2)]
    assert ("B1", 1, 2) in rows(stock.class_counts(flagged))


def test_census_covariates(spark):
    def long(year, geoid, **values):
        codes = {n: c for c, n in K.ESTIMATE_NAMES.items()}
        return [(year, geoid, "x", codes[n], float(v) if v is not None else None, 1.0) for n, v in values.items()]

    data = (
        long(2012, "3610001", med_hh_inc_rou=100, renter_occ_units=50, tot_wh_rou=10, med_gross_rent=10)
        + long(2015, "10001", med_hh_inc_rou=None, renter_occ_units=0, tot_wh_rou=0, med_gross_rent=20)
        + long(2015, "99999", med_hh_inc_rou=5, renter_occ_units=1, tot_wh_rou=1, med_gross_rent=20)
    )
    estimates = spark.createDataFrame(data, schemas.ESTIMATES)
    index = literal_table(spark, [(2012, 200.0), (2015, 220.0), (2020, 250.0)], schemas.PRICE_INDEX)
    units = spark.createDataFrame([("10001",)], "geoid STRING")
    found = {r["year"]: r for r in census.census_covariates(estimates, index, units).collect()}
    assert set(found) == {2012, 2015}
    assert found[2012]["geoid"] == "10001"
    assert found[2012]["med_hh_inc_rou_2020_adj"] == 125 and found[2012]["pct_wh_rou"] == 0.2
    assert found[2015]["med_hh_inc_rou"] == 100 and found[2015]["med_hh_inc_rou_2020_adj"] == 125
    assert found[2015]["pct_wh_rou"] is None
    assert found[2015]["med_gross_rent_2020_adj"] == 23
    assert not [c for c in found[2012].asDict() if c.endswith("E") or c.endswith("M")]


def test_cohort_tables(small_panel):
    table = tables.cohort_months(small_panel)
    found = {r["cohort"]: r for r in table.collect()}
    assert found["1"]["0"] == 1 and found["1"]["1"] == 3 and found["1"]["rtc_date"] == "Aug. 2017"
    assert found["Total"]["n_units"] == 3 and found["Total"]["0"] is None
    counts = tables.units_by(small_panel, "cohort", "zip")
    assert rows(counts) == [("1", 1), ("2", 1), ("5", 1), ("Total", 3)]


def test_group_tests(spark):
    data = [("a", 1.0, "x"), ("a", 2.0, "x"), ("a", 3.0, "y"), ("b", 2.0, "y"), ("b", 4.0, "y"), ("b", 6.0, "y")]
    df = spark.createDataFrame(data, "g STRING, v DOUBLE, c STRING")
    row = tables.group_test(df, ["v"], "g").first()
    # Means 2 and 4, within sum of squares 2 + 8: F = 6 / (10 / 4).
    assert row["f_statistic"] == pytest.approx(2.4)
    assert row["p_value"] == pytest.approx(0.196, abs=1e-3)
    chi = tables.category_test(df, "c", "g").first()
    assert chi["chi2"] == pytest.approx(3.0) and chi["df"] == 1
    assert chi["p_value"] == pytest.approx(0.0833, abs=1e-3)


def test_averages_weigh_by_units_with_complete_rows(spark):
    """Three units of one cohort never have an outcome, so they carry no weight."""
    data = [(u, t, g, (None if u in (3, 4, 5) else float(u + (t >= g > 0) * g)), 1.0)
            for u, g in [(1, 3), (2, 4), (3, 4), (4, 4), (5, 4), (6, 0), (7, 0)] for t in range(1, 6)]
    df = spark.createDataFrame(data, "zip int, month_idx int, treat_idx int, rate double, x double")
    out = models.effects_and_averages(df, y="rate")
    # Cohort 3 has three treated months of effect 3, cohort 4 two of effect 4, one unit each.
    assert abs(out["simple"].first()["att"] - (3 * 3 + 2 * 4) / 5) < 1e-9


def test_models(spark):
    data = [
        (u, t, g, float(u % 7) + 0.1 * t + (1.5 if g and t >= g else 0.0) + 0.01 * ((u * 31 + t * 17) % 13))
        for u in range(60) for g in [[4, 6, 0][u % 3]] for t in range(1, 9)
    ]
    df = spark.createDataFrame(data, "zip INT, month_idx INT, treat_idx INT, y DOUBLE")
    out = models.effects_and_averages(df, y="y")
    assert out["simple"].first()["att"] == pytest.approx(1.5, abs=0.05)
    compared = models.compare_models(df, {"plain": ()}, y="y", draws=50)
    assert {r["level"] for r in compared.collect()} == {4, 6, None}
    tested = models.compare_pretests(df, {"plain": ()}, unit="zip", y="y", draws=50)
    assert tested.columns == ["covariates", "statistic", "critical_value", "p_value"]
