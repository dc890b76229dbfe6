"""Every registered query against its SQL on the same files."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
import check_oracles
from panelwright import catalog

ROWS_ONLY = {
    "att_bands", "att_gt_dr_three_covariates", "att_gt_dr_unbalanced", "dynamic_bands",
    "group_table", "group_test_p_values", "model_comparison", "pretest_cvm", "pretest_three_covariates", "pretest_wald",
}


@pytest.fixture(scope="module")
def db(sf_dir):
    return check_oracles.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, db, sf_dir, name):
    ok, note = check_oracles.compare(spark, db, name, sf_dir)
    assert ok, note


def test_only_iterative_queries_lack_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == ROWS_ONLY


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cohort", "inspection_yr_mo", "avg_monthly_intensity", "treated"]
    assert df.count() == 400
