"""Aggregates ready to plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.dates import ever_treated
from panelwright.operators.grouping import n_distinct, sum_strict

RATE = "n_violations_per_1k_units"


def monthly_total(panel: DataFrame, period="inspection_yr_mo", measure="n_violations") -> DataFrame:
    return panel.groupBy(period).agg(sum_strict(measure).alias(measure))


def rate_by_cohort_month(panel: DataFrame, period="inspection_yr_mo", rate=RATE) -> DataFrame:
    """Mean rate and mean treatment flag per cohort and month."""
    return panel.groupBy("cohort", period).agg(
        F.avg(rate).alias("avg_monthly_intensity"), F.avg("treated").alias("treated")
    )


def unit_series(panel: DataFrame, period="inspection_yr_mo", measure="n_violations") -> DataFrame:
    """Raw unit rows by cohort."""
    return panel.select("cohort", period, measure)


def events_by(events: DataFrame, *keys: str, event_id="violationid") -> DataFrame:
    """Distinct events per year, cohort or treatment status."""
    return events.groupBy(*keys).agg(n_distinct(event_id).alias("tot_violations"))


def rate_by_cohort_year(panel: DataFrame, period="inspection_yr_mo", rate=RATE) -> DataFrame:
    return panel.groupBy("cohort", F.year(period).alias("inspection_yr")).agg(
        F.avg(rate).alias("avg_yr_intensity")
    )


def rate_by_ever_treated(
    panel: DataFrame, period="inspection_yr_mo", rate=RATE, last_cohort=5
) -> DataFrame:
    return panel.groupBy(
        ever_treated("cohort", last_cohort).alias("ever_treated"), period
    ).agg(F.avg(rate).alias("avg_monthly_intensity"))
