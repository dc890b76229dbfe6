"""Tables with rows for every unit are neither broadcast nor made in one task, whatever their file size says."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright import catalog
from panelwright.catalog import standins as S
from panelwright.effects import kernels
from panelwright.operators import joins
from panelwright.plans import census, panels
from panelwright.sources.scan import literal_table


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def customers(spark, tmp_path):
    rows = [(i, i % 25, float(i)) for i in range(1, 41)]
    spark.createDataFrame(rows, "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_years_of_one_small_file_are_spread_over_tasks(spark, customers):
    found = S.annual(spark, customers)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 40 * len(S.YEARS)


def test_variables_of_one_small_file_are_spread_over_tasks(spark, customers):
    plan = planned(catalog.QUERIES["census_covariates"](spark, customers))
    assert plan.rindex("Generate") < plan.rindex("REPARTITION_BY_NUM")


def test_composite_lookup_broadcasts_no_annual_table(spark, sf_dir):
    assert "Broadcast" not in planned(catalog.QUERIES["left_join_composite"](spark, sf_dir))


def unit_joins(spark, df):
    return [line for line in planned(df).splitlines() if "BroadcastHashJoin" in line and "nation" not in line and "region" not in line]


def test_panel_broadcasts_no_table_of_units(spark, sf_dir):
    assert not unit_joins(spark, S.panel(spark, sf_dir))
    assert not unit_joins(spark, catalog.QUERIES["baseline_covariates"](spark, sf_dir))


def test_panel_is_shuffled_once_for_its_lookups(spark):
    panel = spark.createDataFrame([("a", 1), ("b", 2)], "zip STRING, year INT").repartition(4, "zip")
    annual = spark.createDataFrame([("a", 1, 5)], "zip STRING, year INT, v INT")
    plan = planned(joins.lookup(panel, joins.shuffled(annual), "zip", also=["year"]))
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan


def test_lookup_by_keys_compared_later(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), (None, 1), ("b", 1)], "k STRING, year INT")
    right = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", None, 12), (None, 1, 13), ("b", 2, 14)], "k STRING, year INT, v INT")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(map(tuple, joins.lookup(left, right, ["k", "year"]).collect()), key=key)
    found = joins.lookup(left, joins.shuffled(right), "k", also=["year"])
    assert found.columns == ["k", "year", "v"]
    assert sorted(map(tuple, found.collect()), key=key) == want


def test_annual_rows_of_a_unit_may_repeat_or_lack_a_key(spark):
    panel = spark.createDataFrame([("a", "2001-01-01", 1), (None, "2001-01-01", 2), ("b", None, 3)], "zip STRING, d STRING, n_violations INT")
    panel = panel.select("zip", F.to_date("d").alias("inspection_yr_mo"), "n_violations")
    annual = spark.createDataFrame([("a", 2001, 10), ("a", 2001, 20), (None, 2001, 30), ("b", None, 40)], "zip STRING, year INT, renter_occ_units INT")
    found = panels.attach_covariates(panel, annual, annual.select("zip").distinct())
    rows = sorted((r["n_violations"], r["renter_occ_units"]) for r in found.where("n_violations = 1").collect())
    assert rows == [(1, 10), (1, 20)]
    assert [r["renter_occ_units"] for r in found.where("n_violations > 1").collect()] == [None, None]


def test_census_lists_areas_after_the_pivot(spark):
    names = {"V1": "a", "V2": "b"}
    cells = spark.createDataFrame(
        [("1", 2001, "V1", 1.0), ("1", 2001, "V2", 4.0), ("2", 2001, "V1", 2.0), (None, 2001, "V1", 3.0)], "geoid STRING, year INT, variable STRING, estimate DOUBLE")
    listed = spark.createDataFrame([("1",), ("1",), (None,)], "geoid STRING")
    index = literal_table(spark, [(2001, 1.0)], "year INT, idx DOUBLE")
    found = census.census_covariates(cells, index, listed, names, {"c": ("a", "b")}, {}, [], None, None, 2001)
    assert [(r["geoid"], r["a"], r["b"], r["c"]) for r in found.collect()] == [("1", 1.0, 4.0, 0.25)]
    assert planned(found).index("SortMergeJoin") < planned(found).index("max(")


def pretest_batch(n=300, months=3, strips=4):
    rng = np.random.default_rng(5)
    cohort = rng.choice([2, 3, 9], n)
    batch = pa.RecordBatch.from_arrays([
        pa.array(rng.integers(-2**62, 2**62, n)), pa.array(cohort.astype(np.int32)), pa.array(rng.normal(size=n)),
        pa.array(list(rng.normal(size=(n, months))), pa.list_(pa.float64())), pa.array(rng.integers(0, strips, n).astype(np.int32)),
    ], names=["hash", "cohort", "x1", "y", "place"])
    inverse = np.linalg.inv(np.array([[9.0, 1.0], [1.0, 7.0]]))
    cell = {"group": 2, "controls": (3, 9), "gamma": np.array([0.1, -0.4]), "base": 0, "n1": 90.0, "w0": 80.0, "inverse": inverse, "odds_x": np.array([60.0, 5.0])}
    other = {**cell, "group": 3, "controls": (9,), "gamma": np.array([-0.3, 0.2]), "time": 2}
    spec = {"k": 1, "months": months, "draws": 40, "rows": 64, "cells": [{**cell, "time": 1}, {**cell, "time": 2}, other]}
    spec["drawn"] = rng.normal(size=(40, 3, 4))
    return batch, spec


def test_scalars_come_once_for_each_model():
    """Cells of one cohort that differ in their months only share their sums."""
    batch, spec = pretest_batch()
    found = {(r["kind"], r["i"]): np.array(r["values"]) for out in kernels.moment_scalars(spec)([batch]) for r in out.to_pylist()}
    assert kernels.models_of(spec["cells"]) == ([0, 2], [0, 0, 1])
    drawn = np.array([found["draw", b] for b in range(40)]).reshape(40, 2, 4)
    hashes, cohort, X, Y = kernels.unpack(batch, 1, 3)
    V = kernels.multipliers(hashes, 40)
    for m, (rows, d, odds, chance, _) in enumerate(kernels.moment_terms({**spec, "cells": [spec["cells"][0], spec["cells"][2]]}, cohort, X, Y)):
        want = V[rows].T @ np.column_stack([d, odds, (d - chance)[:, None] * X[rows]])
        np.testing.assert_allclose(drawn[:, m], want, atol=1e-9)
        np.testing.assert_allclose(found["odds", m], odds @ X[rows])


def test_strips_add_up_the_terms_of_their_units(monkeypatch):
    """By products of matrices, without the terms of every unit, cell and draw."""
    batch, spec = pretest_batch()
    place = batch.column("place").to_numpy()
    want = np.zeros((4, 3, 41))
    for c, (rows, terms) in enumerate(kernels.moment_columns(spec, 0, 3, *kernels.unpack(batch, 1, 3))):
        np.add.at(want[:, c], place[rows], terms)
    monkeypatch.setattr(kernels, "moment_columns", None)
    found = {r["i"]: r["values"] for out in kernels.strip_sums(spec)([batch]) for r in out.to_pylist()}
    for strip in range(4):
        for c in range(3):
            np.testing.assert_allclose(found[strip * 3 + c], want[strip, c], atol=1e-9)
