"""Estimation jobs over a study panel."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from panelwright.effects import aggregate_att, att_gt, cohort_sizes, estimate, pretest
from panelwright.effects.result_tables import compare, pretest_table

THREE = ("evict_rate_17", "rs_rate_17", "pct_pov_17")
FORMULAS: Mapping[str, tuple[str, ...]] = {
    "without covariates": (),
    "three covariates": THREE,
    "three covariates + share white": (*THREE, "pct_wh_17"),
    "three covariates + share Black": (*THREE, "pct_bl_17"),
}
RATE = "n_violations_per_1k_units"


def effects_and_averages(
    panel: DataFrame, unit="zip", y=RATE, time="month_idx", group="treat_idx", **options
) -> dict[str, DataFrame]:
    """Group-time effects and their four averages, as lazy tables.

    Cohorts weigh by their units with at least one complete row, as the effects use no others.
    """
    att = att_gt(panel, y, unit, time, group, **options)
    used = panel.dropna(subset=[time, y, *options.get("covariates", ())])
    sizes = cohort_sizes(used, unit, group)
    out = {"att": att}
    for kind in ("simple", "group", "dynamic", "calendar"):
        out[kind] = aggregate_att(att, sizes, kind)
    return out


def compare_models(
    panel: DataFrame,
    formulas: Mapping[str, Iterable[str]],
    kind="group",
    unit="zip",
    y=RATE,
    time="month_idx",
    group="treat_idx",
    **options,
) -> DataFrame:
    """One averaged result per covariate list, stacked with the model's name."""
    return compare(
        {
            name: estimate(panel, y, unit, time, group, covariates, **options).bands(kind)
            for name, covariates in formulas.items()
        }
    )


def compare_pretests(
    panel: DataFrame,
    formulas: Mapping[str, Iterable[str]],
    unit="geoid",
    y=RATE,
    time="month_idx",
    group="treat_idx",
    **options,
) -> DataFrame:
    """Conditional pre-trend test of several covariate lists."""
    return pretest_table(
        {
            name: pretest(panel, y, unit, time, group, covariates, **options)
            for name, covariates in formulas.items()
        }
    )
