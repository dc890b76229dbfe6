"""Verbs on small tables with the awkward rows spelled out."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.functions import constants as K
from panelwright.functions import dates, scalars, text
from panelwright.operators import (
    filters,
    grouping,
    joins,
    numbering,
    order,
    panel,
    quantiles,
    reshape,
    schema_ops,
)
from panelwright.sources import scan, sink


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- panel ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def events(spark):
    data = [
        ("a", "2017-01-05", 1), ("a", "2017-01-20", 2), ("a", "2017-01-20", 2),
        ("a", "2017-04-01", 3), ("b", "2017-02-11", 4), (None, "2017-04-09", 5),
        ("b", "2017-02-12", None), ("b", "2017-02-13", None),
    ]
    df = spark.createDataFrame(data, "unit STRING, day STRING, id INT")
    return df.withColumn("month", F.trunc(F.col("day").cast("date"), "month"))


def test_counts_treat_missing_ids_as_one_value(events):
    counts = panel.unit_period_counts(events, "unit", "month", "id", "n")
    found = {(r["unit"], r["month"].month): r["n"] for r in counts.collect()}
    assert found == {("a", 1): 2, ("a", 4): 1, ("b", 2): 2, (None, 4): 1}


@pytest.mark.parametrize("calendar, months", [(False, 3), (True, 4)])
def test_completion_keeps_sums_and_fills_every_cell(events, calendar, months):
    counts = panel.unit_period_counts(events, "unit", "month", "id", "n")
    periods = (panel.calendar_months if calendar else panel.observed_periods)(events, "month")
    full = panel.complete_panel(counts, "unit", "month", "n", periods)
    assert full.count() == 3 * months
    assert full.agg(F.sum("n")).first()[0] == counts.agg(F.sum("n")).first()[0]
    assert full.where("unit IS NULL").count() == months
    assert panel.duplicated_cells(full, "unit", "month").count() == 0
    dropped = panel.complete_panel(counts, "unit", "month", "n", periods, keep_null_unit=False)
    assert dropped.count() == 2 * months


def test_completion_plan_has_no_cross_join(events):
    counts = panel.unit_period_counts(events, "unit", "month", "id", "n")
    full = panel.complete_panel(counts, "unit", "month", "n", panel.observed_periods(events, "month"))
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_duplicate_cells_are_refused(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "unit STRING, t INT")
    with pytest.raises(ValueError, match="not unique"):
        panel.assert_unique(df, "unit", "t")
    assert panel.assert_unique(df.distinct(), "unit", "t").count() == 1


def test_baseline_from_annual_table_equals_panel_fill(spark):
    annual = spark.createDataFrame(
        [("a", 2016, 1.0), ("a", 2017, 2.0), ("b", 2016, 3.0)], "unit STRING, year INT, v DOUBLE"
    )
    base = panel.baseline(annual, "unit", "year", 2017, {"v17": F.col("v")})
    assert rows(base) == [("a", 2.0)]
    spread = panel.panel_baseline(annual, "unit", F.col("year"), 2017, {"v17": F.col("v")})
    assert rows(spread, "unit", "v17") == [("a", 2.0), ("a", 2.0), ("b", None)]


def test_toy_rates(spark):
    data = [(1, 2, 10), (1, 0, 10), (1, 5, 10), (2, 1, 8), (2, 7, 8), (3, 4, 0), (3, 0, 0)]
    df = spark.createDataFrame(data, "tract INT, n INT, units INT")
    found = [r[0] for r in df.select(scalars.rate_per("n", "units")).collect()]
    assert found == [200, 0, 500, 125, 875, None, None]
    zero = df.select(scalars.safe_ratio("n", "units", zero_over_zero=0)).collect()
    assert [r[0] for r in zero][-2:] == [None, 0.0]


# --- order -----------------------------------------------------------------------------


def test_fills_never_cross_units(spark):
    data = [("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 1, None), ("b", 2, None), ("c", 1, 7)]
    df = spark.createDataFrame(data, "unit STRING, t INT, v INT")
    updown = order.fill_updown(df, "unit", "t", ["v"])
    assert rows(updown) == [
        ("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("b", 1, None), ("b", 2, None), ("c", 1, 7),
    ]
    assert rows(order.ffill(df, "unit", "t", ["v"]))[:3] == [("a", 1, None), ("a", 2, 5), ("a", 3, 5)]


def test_first_row_and_missing_order_values(spark):
    data = [("x", None, "late"), ("x", 3, "third"), ("x", 2, "second"), (None, 1, "null key")]
    df = spark.createDataFrame(data, "k STRING, o INT, v STRING")
    assert rows(order.first_per_key(df, ["k"], ["o"]), "k", "v") == [("x", "second"), (None, "null key")]


def test_argmax_ties(spark):
    data = [("t", "z2", 0.4), ("t", "z1", 0.4), ("t", "z3", 0.2), ("u", "z9", 1.0)]
    df = spark.createDataFrame(data, "tract STRING, zip STRING, r DOUBLE")
    first = order.argmax_rows(df, ["tract"], "r", tie_break=["zip"])
    assert rows(first, "tract", "zip") == [("t", "z1"), ("u", "z9")]
    both = order.argmax_rows(df, ["tract"], "r", ties="all")
    assert rows(both, "tract", "zip") == [("t", "z1"), ("t", "z2"), ("u", "z9")]


def test_sorts_put_missing_last(spark):
    df = spark.createDataFrame([(2,), (None,), (3,)], "v INT")
    assert [r["v"] for r in order.sort_rows(df, "v").collect()] == [2, 3, None]
    assert [r["v"] for r in order.sort_rows(df, "v", descending=True).collect()] == [3, 2, None]


def test_row_numbers_and_batches(spark):
    ids = random.Random(1).sample(range(10_000), 997)
    df = spark.createDataFrame([(i,) for i in ids], "id INT").repartition(5)
    numbered = numbering.number_rows(df, "id", buckets=7).orderBy("id").collect()
    assert [r["id"] for r in numbered] == sorted(ids)
    assert [r["row_number"] for r in numbered] == list(range(1, 998))
    sizes = numbering.batch_number(df, "id", 100).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in sizes) == [97] + [100] * 9


def test_exact_quantiles(spark):
    rng = random.Random(4)
    data = []
    for g, n in (("a", 1), ("b", 2), ("c", 60), ("d", 900), ("e", 15_000), (None, 5)):
        data += [(g, round(rng.gauss(0, 5), 3)) for _ in range(n)]
    # A third of the rows share one value.
    data += [("hot", 1.0 if i % 3 == 0 else rng.random() * 2) for i in range(12_000)]
    data += [("none", None)]
    df = spark.createDataFrame(data, "g STRING, v DOUBLE")
    wanted = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "v", wanted).collect()}
    exact = df.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in wanted.items()])
    for r in exact.collect():
        for name in wanted:
            assert got[r["g"]][name] == (
                pytest.approx(r[name], abs=1e-9) if r[name] is not None else None
            )


# --- joins, groups, reshaping -------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"spread_by": ["i"], "salts": 4}])
def test_lookup_null_keys_and_salting(spark, options):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(30)], "i INT, k STRING")
    right = spark.createDataFrame([("hot", 1), (None, 2), ("cold", 3)], "k STRING, v INT")
    plain = joins.lookup(left, right, "k", **options)
    assert plain.columns == ["i", "k", "v"]
    assert plain.count() == 30 and plain.where("v = 1").count() == 20
    assert plain.where("v IS NULL").count() == 10
    safe = joins.lookup(left, right, "k", null_safe=True, **options)
    assert safe.where("v = 2").count() == 10


def test_lookup_multiplies_on_duplicate_keys(spark):
    left = spark.createDataFrame([("t",)], "tract STRING")
    right = spark.createDataFrame([("t", 1), ("t", 2)], "id STRING, v INT")
    assert joins.lookup(left, right, {"tract": "id"}).count() == 2


def test_coalescing_lookup_and_leftovers(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", "own"), (3, "z", None)], "i INT, k STRING, g STRING")
    key = spark.createDataFrame([("x", "found"), ("y", "other")], "k STRING, alt STRING")
    out = joins.fill_from(df, key, "k", "g", "alt")
    assert rows(out, "i", "g") == [(1, "found"), (2, "own"), (3, None)]
    assert rows(joins.unmatched(out, "g"), "i") == [(3,)]
    assert rows(joins.keep_listed(df, key, "k"), "i") == [(1,), (2,)]
    assert rows(joins.keep_unlisted(df, key, "k"), "i") == [(3,)]


def test_sums_counts_and_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 2), (None, 3)], "k STRING, v INT")
    out = df.groupBy("k").agg(
        grouping.sum_strict("v"), grouping.sum_or_zero("v"),
        grouping.n_distinct("v"), grouping.n_distinct_with_null("v"),
    )
    assert rows(out) == [("a", None, 1, 1, 2), ("b", 4, 4, 1, 1), (None, 3, 3, 1, 1)]
    total = grouping.with_total(df.groupBy("k").agg(F.sum("v").alias("v")), ["k"], ["v"])
    assert rows(total) == [("Total", 8), ("a", 1), ("b", 4), (None, 3)]


def test_pivot_and_union(spark):
    df = spark.createDataFrame([(1, 10, 0, 5), (1, 10, 1, 6), (2, 4, 0, 7)], "c INT, u INT, t INT, m INT")
    wide = reshape.pivot_wider(df, ["c", "u"], "t", "m", [0, 1], prefix="t")
    assert rows(wide) == [(1, 10, 5, 6), (2, 4, 7, None)]
    other = spark.createDataFrame([(9,)], "c INT")
    assert rows(reshape.union_all([df.select("c", "u"), other]))[-1] == (9, None)


def test_corrections_are_idempotent(spark):
    events = spark.createDataFrame(
        [(1, "10001"), (2, None), (3, "2016"), (4, "10129"), (5, "112226")], "id INT, zip STRING"
    )
    fixes = spark.createDataFrame([(2, "10002"), (3, "10003"), (5, "11226")], "id INT, zip STRING")
    once = reshape.apply_corrections(events, fixes, "id", "zip", ["2016"], K.ZIP_RECODES)
    twice = reshape.apply_corrections(once, fixes, "id", "zip", ["2016"], K.ZIP_RECODES)
    expected = [(1, "10001"), (2, "10002"), (3, "10003"), (4, "10128"), (5, "11226")]
    assert rows(once) == rows(twice) == expected
    by_key = reshape.apply_corrections(events, fixes, "id", "zip", ["2016"], anti_join=False)
    assert by_key.where("id = 5").count() == 2


# --- schema, filters -------------------------------------------------------------------------


def test_names_constants_and_casts(spark):
    df = spark.createDataFrame([(1, "x", None, 1), (2, "x", None, None)], "`Date Added` INT, boroName STRING, e INT, `% of` INT")
    assert schema_ops.snake_names(df).columns == ["date_added", "boro_name", "e", "of"]
    assert schema_ops.constant_columns(df) == ["boroName", "e"]
    cast = schema_ops.cast_columns(spark.createDataFrame([("all others",), ("10001",)], "zip STRING"), {"zip": "int"})
    assert rows(cast) == [(10001,), (None,)]
    placed = schema_ops.derive(df, {"n": F.lit(1)}, after="Date Added", drop=["e"])
    assert placed.columns == ["Date Added", "n", "boroName", "% of"]


def test_filters_and_missing_values(spark):
    df = spark.createDataFrame([("A1", None), ("A1", 1), ("Z2", 1), (None, 1), ("C1", None)], "c STRING, f INT")
    assert df.where(filters.not_in("c", ["A1"])).count() == 3
    assert df.where(filters.not_prefixed("c", ["Z", "Y"])).count() == 3
    # A missing class with a flag present is kept: unknown AND false is false.
    assert df.where(filters.flagged_if_prefixed("c", ["A", "B"], "f")).count() == 4
    assert df.where(filters.is_one_of_or_null("c", ["C1"])).count() == 2
    assert filters.rows_with_nulls(df).count() == 3


def test_nan_policy(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (1.5,), (None,)], "v DOUBLE")
    assert [r[0] for r in schema_ops.map_numeric(df, scalars.finite_or).collect()] == [None, None, None, 1.5, None]


# --- scalars ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, standard",
    [
        ("1 HOR HARDING EXPRESSWAY SR NORTH", "1 HORACE HARDING EXPY"),
        ("1 HOR HARDING EXPRESSWAY SR SOUTH", "1 HORACE HARDING EXPY"),
        ("2 ST NICHOLAS PLACE", "2 SAINT NICHOLAS PL"),
        ("3 9 AVENUE", "3 9TH AVE"),
        ("19 AVENUE", "19 AVE"),
        ("4 WEST 181 STREET", "4 W 181ST ST"),
        ("5 FREDERICK DOUGAL BOULEVARD", "5 FREDERICK DOUGLASS BLVD"),
        ("6 MANH AVENUE", "6 MANHATTAN AVE"),
        ("7 EAST 6 STREET", "7 EAST 6TH ST"),
        ("7 EAST 61 STREET", "7 EAST 61 ST"),
        ("8 EAST 31 STREET", "8 EAST 31ST ST"),
        ("9 EAST 132 STREET", "9 EAST 132ND ST"),
        ("9 EAST 238 STREET", "9 EAST 238TH ST"),
        ("10 MC BRIDE STREET", "10 MCBRIDE ST"),
        ("11 ADAM C POWELL BOULEVARD", "11 ADAM CLAYTON POWELL JR BLVD"),
        ("11 ADAM C POWELL JR BOULEVARD", "11 ADAM CLAYTON POWELL JR BLVD"),
        ("12 HUTCH RIVER PARKWAY", "12 HUTCHINSON RIVER PKWY"),
    ],
)
def test_address_rules(spark, raw, standard):
    assert one(spark, text.apply_rules(F.lit(raw), K.ADDRESS_RULES)) == standard


@pytest.mark.parametrize(
    "raw, standard, legacy",
    [
        ("5 Gipson Stree t", "5 GIPSON ST", "5 GIPSON ST"),
        ("5 Av Enue", "5 AVE", "5 AVE"),
        ("5 ave apt", "5 AVE APT", "5 AVEAPT"),
        ("Pelham Parkw ay", "PELHAM PKWY", "PELHAM PKWY"),
        ("Grand Conc Ourse", "GRAND CONCOURSE", "GRAND CONCOURSE"),
        ("1 STREE#2", "1 ST#2", "1 ST#2"),
    ],
)
def test_split_words(spark, raw, standard, legacy):
    bare = text.normal_address(F.lit(raw))
    assert one(spark, text.apply_rules(bare, K.SPLIT_WORD_RULES)) == standard
    assert one(spark, text.apply_rules(bare, K.SPLIT_WORD_RULES_LEGACY)) == legacy


def test_normal_address(spark):
    assert one(spark, text.normal_address(F.lit(" 687-689  East 137th St. Apt#4 1/2"))) == "687689 EAST 137TH ST APT#4 1/2"
    assert one(spark, text.normal_address(F.lit("NA"))) is None
    assert one(spark, text.normal_address(F.lit(" . "))) is None


def test_text_helpers(spark):
    assert one(spark, text.join_text(F.lit("1"), F.lit(None).cast("string"))) is None
    assert one(spark, text.join_text(F.lit("1"), F.lit(None).cast("string"), null_as="NA")) == "1 NA"
    assert one(spark, text.area_id(F.lit("061"), F.lit("000100"))) == "36061000100"
    assert one(spark, text.strip_prefix_for(F.lit("3610001"), "36", F.lit(True))) == "10001"
    assert one(spark, text.strip_prefix_for(F.lit("3610001"), "36", F.lit(False))) == "3610001"
    assert one(spark, text.label(F.lit(3), {1: "Cohort 1"})) == "3"


def test_treated_flag_grain(spark):
    treat, month = F.lit(dt.date(2017, 8, 11)), F.lit(dt.date(2017, 8, 1))
    assert one(spark, dates.treated_flag(treat, month, grain="day")) == 0
    assert one(spark, dates.treated_flag(treat, month, grain="month")) == 1
    missing = F.lit(None).cast("date")
    assert one(spark, dates.treated_flag(missing, month)) == 0
    assert one(spark, dates.treated_flag(missing, month, null_treated=True)) == 1


def test_months(spark):
    for y, m in ((2013, 1), (2019, 12), (2020, 2)):
        idx = dates.month_idx(F.lit(dt.date(y, m, 28)))
        assert one(spark, idx) == y * 12 + m
        assert one(spark, dates.month_idx_to_date(idx)) == dt.date(y, m, 1)
    assert one(spark, dates.first_treated_month(F.lit(dt.date(2019, 12, 1)), 2019 * 12 + 5)) == 0
    inside = dates.in_study(F.lit(dt.date(2019, 5, 31)), 2013 * 12 + 1, 2019 * 12 + 5)
    assert one(spark, inside)
    assert not one(spark, dates.in_study(F.lit(dt.date(2019, 6, 1)), 2013 * 12 + 1, 2019 * 12 + 5))


def test_recodes(spark):
    assert one(spark, scalars.recode(F.lit("10435"), K.ZIP_RECODES)) == "11435"
    assert one(spark, scalars.recode(F.lit("10001"), K.ZIP_RECODES)) == "10001"
    assert one(spark, scalars.map_values(F.lit("QN"), K.BOROUGH_BY_ABBREVIATION)) == 4
    assert one(spark, scalars.round_to_nearest(F.lit(12.6), 5)) == 15
    assert len(K.DROPPED_CLASSES) == 29 and len(K.DROPPED_CLASS_PREFIXES) == 17
    assert len(K.ADDRESS_RULES) == 28 and len(K.ESTIMATE_NAMES) == 17


# --- files -----------------------------------------------------------------------------------


def test_csv_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("01000", 1, None), (None, 2, 0.5)], "zip STRING, n INT, x DOUBLE")
    path = str(tmp_path / "out")
    sink.sink(df, path, fmt="csv")
    files = list((tmp_path / "out").glob("*.csv.gz"))
    assert files
    back = scan.scan(spark, path, "zip STRING, n INT, x DOUBLE", partitions=3)
    assert rows(back) == rows(df)
    piped = str(tmp_path / "piped")
    df.write.csv(piped, header=True, sep="|", nullValue="NA")
    assert rows(scan.scan_piped(spark, piped, "zip STRING, n INT, x DOUBLE")) == rows(df)
    report = sink.sink_exceptions(df, F.col("zip").isNull(), str(tmp_path / "bad"), ["n"])
    assert rows(report) == [(2,)]
    sink.save_results({"one": df}, str(tmp_path / "res"))
    assert rows(sink.load_results(spark, str(tmp_path / "res"), ["one"])["one"]) == rows(df)


def test_filter_and_columns_reach_the_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.lit("577").alias("code"), F.lit(1).alias("other")).write.parquet(path)
    df = scan.scan(spark, path, where=F.col("id").between(2, 4) & F.col("code").isin("577"), columns=["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,2)" in plan and "other" not in plan
    assert df.count() == 3
