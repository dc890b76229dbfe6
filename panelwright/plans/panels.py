"""Unit-by-month analysis panels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import constants as K
from panelwright.functions.dates import in_months, month_idx, treated_flag
from panelwright.functions.scalars import null_if, rate_per, safe_ratio
from panelwright.operators.joins import lookup, shuffled
from panelwright.operators.panel import (
    baseline,
    calendar_months,
    complete_panel,
    observed_periods,
    unit_period_counts,
)
from panelwright.operators.schema_ops import derive
from panelwright.plans.events import attach_cohorts


def count_panel(
    events: DataFrame,
    unit="zip",
    period="inspection_yr_mo",
    event_id="violationid",
    measure="n_violations",
    calendar=False,
    keep_null_unit=True,
) -> DataFrame:
    """Distinct events per unit and month, zero where none was recorded.

    Months are those seen anywhere in the data, or with ``calendar`` every month
    from the first to the last.
    """
    periods = (calendar_months if calendar else observed_periods)(events, period)
    counts = unit_period_counts(events, unit, period, event_id, measure)
    return complete_panel(counts, unit, period, measure, periods, keep_null_unit=keep_null_unit)


def baseline_rates(
    annual: DataFrame,
    evictions: DataFrame,
    stabilised: DataFrame,
    unit="zip",
    evict_col="evicts_17",
    stabilised_col="rs_17",
    year=K.BASELINE_YEAR,
    zero_over_zero=None,
    shares: Mapping[str, str] | None = None,
) -> DataFrame:
    """Baseline-year rates, one row per unit, with the counts they come from.

    Everything here has one row per unit, so the panel later takes all of it in
    a single lookup.
    """
    shares = shares or {"pct_pov_17": "pct_pov", "pct_wh_17": "pct_wh_rou"}
    units = {"_units": F.col("renter_occ_units")}
    at_year = baseline(
        annual, unit, "year", year, {**units, **{n: F.col(c) for n, c in shares.items()}}
    )
    facts = annual.select(unit).distinct()
    facts = facts.join(evictions, unit, "full_outer").join(stabilised, unit, "full_outer")
    facts = facts.join(shuffled(at_year), unit, "left")
    return facts.withColumns(
        {
            "evict_rate_17": safe_ratio(evict_col, "_units", zero_over_zero=zero_over_zero),
            "rs_rate_17": safe_ratio(stabilised_col, "_units", zero_over_zero=zero_over_zero),
        }
    ).drop("_units")


def attach_covariates(
    panel: DataFrame,
    annual: DataFrame,
    baselines: DataFrame,
    unit="zip",
    period="inspection_yr_mo",
    measure="n_violations",
    zero_over_zero=None,
) -> DataFrame:
    """Annual covariates by unit and year, baseline rates by unit, and the outcome rate."""
    # The panel is partitioned by unit, and all joins are by unit: its rows are shuffled once.
    joined = lookup(panel.withColumn("year", F.year(period)), shuffled(annual), unit, also=["year"])
    joined = lookup(joined, shuffled(baselines), unit)
    rate: Column = rate_per(measure, "renter_occ_units")
    if zero_over_zero is not None:
        empty = (F.col(measure) == 0) & (F.col("renter_occ_units") == 0)
        rate = F.when(empty, F.lit(float(zero_over_zero))).otherwise(rate)
    return derive(joined, {f"{measure}_per_1k_units": rate}, after=measure, drop=["year"])


def zip_panel(
    events: DataFrame,
    annual: DataFrame,
    evictions: DataFrame,
    stabilised: DataFrame,
    rollout: DataFrame,
    baseline_year=K.BASELINE_YEAR,
    grain="month",
    zero_over_zero=None,
    calendar=False,
    last_cohort=K.LAST_COHORT,
    last_date=None,
) -> DataFrame:
    """The ZIP panel: counts, covariates, baseline rates, cohort and treatment flag."""
    panel = count_panel(events, calendar=calendar)
    rates = baseline_rates(
        annual, evictions, stabilised, year=baseline_year, zero_over_zero=zero_over_zero
    )
    panel = attach_covariates(panel, annual, rates, zero_over_zero=zero_over_zero)
    panel = attach_cohorts(panel, shuffled(rollout), "zip", last_cohort, last_date)
    return panel.withColumn(
        "treated", treated_flag("rtc_treat_date", "inspection_yr_mo", grain=grain)
    )


def tract_panel(
    events: DataFrame,
    annual: DataFrame,
    evictions: DataFrame,
    stabilised: DataFrame,
    assignments: DataFrame,
    baseline_year=K.BASELINE_YEAR,
) -> DataFrame:
    """The tract panel; treatment comes from the ZIP each tract is assigned to."""
    panel = count_panel(events, unit="geoid")
    rates = baseline_rates(
        annual,
        evictions,
        stabilised,
        unit="geoid",
        evict_col="evictions_per_tract",
        stabilised_col="rs_17_count",
        year=baseline_year,
        shares={"pct_pov_17": "pct_pov", "pct_wh_17": "pct_wh_rou", "pct_bl_17": "pct_bl_rou"},
    )
    panel = attach_covariates(panel, annual, rates, unit="geoid")
    panel = panel.withColumn("med_yr_blt_rou", null_if("med_yr_blt_rou", 0))
    return lookup(panel, assignments, "geoid")


def study_panel(
    panel: DataFrame,
    first_idx: int,
    last_idx: int,
    period="inspection_yr_mo",
    treat_date="rtc_treat_date",
) -> DataFrame:
    """Study window with integer month numbers for estimation.

    ``treat_idx`` is 0 for units first treated after the window.
    """
    idx = panel.withColumns({"month_idx": month_idx(period), "_treat": month_idx(treat_date)})
    late = F.col("_treat").isNull() | (F.col("_treat") > last_idx)
    return (
        idx.where(in_months("month_idx", first_idx, last_idx))
        .withColumn("treat_idx", F.when(late, 0).otherwise(F.col("_treat")))
        .drop("_treat")
    )
