"""Calendar helpers. Months are integers, ``year * 12 + month``, never decimals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.functions.scalars import as_column


def to_day(value) -> Column:
    return as_column(value).cast("date")


def month_start(value) -> Column:
    return F.trunc(as_column(value), "month")


def month_idx(value) -> Column:
    """Evenly spaced month number; differences are whole months of exposure."""
    value = as_column(value)
    return F.year(value) * 12 + F.month(value)


def month_idx_value(year: int, month: int) -> int:
    return year * 12 + month


def month_idx_to_date(idx) -> Column:
    """First day of a month number."""
    idx = as_column(idx)
    year = F.floor((idx - 1) / 12).cast("int")
    return F.make_date(year, (idx - year * 12).cast("int"), F.lit(1))


def treated_flag(treat_date, observed, grain="month", null_treated=False) -> Column:
    """0 while the treat date lies after the observation, else 1.

    ``grain="month"`` compares months, so a unit counts as treated in the month
    it is added; ``grain="day"`` compares the dates as they are. A missing treat
    date means untreated unless ``null_treated`` is set.
    """
    treat, seen = as_column(treat_date), as_column(observed)
    if grain == "month":
        later = month_idx(treat) > month_idx(seen)
    elif grain == "day":
        later = treat > seen
    else:
        raise ValueError(f"grain must be 'month' or 'day', not {grain!r}")
    flag = F.when(later, 0).otherwise(1)
    return flag if null_treated else F.when(treat.isNull(), 0).otherwise(flag)


def ever_treated(cohort, last_cohort=5) -> Column:
    return F.when(as_column(cohort) < last_cohort, 1).otherwise(0)


def first_treated_month(treat_date, study_end_idx: int) -> Column:
    """Month number of first treatment, 0 where it falls after the study."""
    idx = month_idx(as_column(treat_date))
    return F.when(idx.isNull() | (idx > study_end_idx), 0).otherwise(idx)


def in_months(value, first_idx: int, last_idx: int) -> Column:
    """Study-window predicate on a month number (both ends included)."""
    return as_column(value).between(first_idx, last_idx)


def in_study(column, first_idx: int, last_idx: int) -> Column:
    """The same window on a raw date or timestamp column.

    Compares with two literals, so the predicate reaches a columnar scan.
    """
    first = dt.date((first_idx - 1) // 12, (first_idx - 1) % 12 + 1, 1)
    after = dt.date(last_idx // 12, last_idx % 12 + 1, 1)
    value = as_column(column)
    return (value >= F.lit(first)) & (value < F.lit(after))
