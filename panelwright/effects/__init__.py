"""Staggered difference-in-differences on unit-by-month panels.

Point estimates come from aggregates by cohort and month; uncertainty comes from
per-unit influence values, multiplied with hash weights and summed in parallel.
Only matrices sized by cohorts, months and bootstrap draws reach the driver.
"""

from panelwright.effects.aggregate import aggregate_att, cohort_sizes
from panelwright.effects.att import att_gt, att_std_errors, dropped_rows, left_out
from panelwright.effects.bands import Estimate, estimate
from panelwright.effects.result_tables import compare, pretest_table
from panelwright.effects.design import NEVER, Design
from panelwright.effects.pretrend import pretest

__all__ = [
    "NEVER",
    "Design",
    "Estimate",
    "aggregate_att",
    "att_gt",
    "att_std_errors",
    "cohort_sizes",
    "compare",
    "dropped_rows",
    "estimate",
    "left_out",
    "pretest",
    "pretest_table",
]
