"""Event records: cleaning, treatment tags, audits and corrections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import constants as K
from panelwright.functions.dates import month_idx, month_start, to_day, treated_flag
from panelwright.functions.scalars import try_number
from panelwright.operators.filters import is_one_of_or_null
from panelwright.operators.grouping import count_by, n_distinct_with_null
from panelwright.operators.joins import lookup
from panelwright.operators.order import sort_rows
from panelwright.operators.reshape import apply_corrections
from panelwright.operators.schema_ops import drop_constant, snake_names

# The columns kept from the event file.
EVENT_COLUMNS = [
    "violationid", "buildingid", "boroid", "boro", "housenumber", "lowhousenumber",
    "highhousenumber", "streetname", "zip", "apartment", "story", "block", "lot", "class",
    "inspectiondate", "ordernumber", "novdescription", "novtype", "rentimpairing",
    "latitude", "longitude", "censustract", "bin", "bbl", "nta",
]


def with_months(events: DataFrame, date_col="inspectiondate") -> DataFrame:
    """Date, year, month, month start and month number of every event."""
    day = to_day(date_col)
    return events.withColumns(
        {
            date_col: day,
            "inspection_yr": F.year(day),
            "inspection_mo": F.month(day),
            "inspection_yr_mo": month_start(day),
            "month_idx": month_idx(day),
        }
    )


def clean_events(events: DataFrame, columns: Iterable[str] = (), drop_constants=False) -> DataFrame:
    """Keep the analysis columns and add the calendar columns.

    ``drop_constants`` also removes columns with a single value, which costs one
    aggregate job over the kept columns.
    """
    wanted = [c for c in (columns or EVENT_COLUMNS) if c in events.columns]
    kept = events.select(*wanted)
    if drop_constants:
        kept = drop_constant(kept)
    return with_months(kept)


def rollout_table(rollout: DataFrame, drop_cohorts: Iterable[int] = (K.LAST_COHORT,)) -> DataFrame:
    """Cohort and treat date per unit; rows without a usable unit are dropped.

    The row for "all others" has no number as its unit: left in, its NULL could
    match units that are missing themselves.
    """
    table = snake_names(rollout).withColumnRenamed("date_added", "rtc_treat_date")
    table = table.where(try_number("zip").isNotNull()).select("cohort", "rtc_treat_date", "zip")
    drops = list(drop_cohorts)
    return table.where(~F.col("cohort").isin(drops)) if drops else table


def attach_cohorts(
    df: DataFrame,
    rollout: DataFrame,
    unit="zip",
    last_cohort=K.LAST_COHORT,
    last_date=None,
    spread_by: Iterable[str] = (),
) -> DataFrame:
    """Cohort and treat date of each row's unit; unlisted units join the last cohort.

    ``spread_by`` names columns to salt the join with, for events where one unit
    (or the missing unit) holds a large part of the rows.
    """
    last_date = last_date or K.COHORT_DATES[K.LAST_COHORT]
    listed = rollout.select("zip", "cohort", "rtc_treat_date")
    joined = lookup(df, listed, {unit: "zip"}, spread_by=spread_by)
    return joined.withColumns(
        {
            "cohort": F.coalesce("cohort", F.lit(last_cohort)),
            "rtc_treat_date": F.coalesce("rtc_treat_date", F.lit(last_date).cast("date")),
        }
    )


def tag_treatment(
    df: DataFrame, rollout: DataFrame, date_col="inspectiondate", unit="zip", grain="day", **options
) -> DataFrame:
    """Cohort, treat date and a 0/1 flag comparing the treat date with the row's date."""
    tagged = attach_cohorts(df, rollout, unit, **options)
    return tagged.withColumn("treated", treated_flag("rtc_treat_date", date_col, grain=grain))


def audit_keys(events: DataFrame, key="zip", event_id="violationid") -> DataFrame:
    """Distinct events per key, largest key first and the missing key last."""
    counts = events.groupBy(key).agg(n_distinct_with_null(event_id).alias("n_violations"))
    return sort_rows(counts, key, descending=True)


def faulty_records(
    events: DataFrame, key="zip", bad: Iterable[str] = tuple(K.FAULTY_ZIPS), columns=()
) -> DataFrame:
    """Records with a missing or known faulty key, the report for hand correction."""
    report = events.where(is_one_of_or_null(key, bad))
    return report.select(*columns) if columns else report


def missing_by_unit(panel: DataFrame, unit: str, columns: Iterable[str]) -> DataFrame:
    """Rows with a missing value per column and unit, all columns in one pass."""
    marked = F.explode(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    )
    found = panel.select(unit, marked.alias("variable")).where(F.col("variable").isNotNull())
    return count_by(found, "variable", unit)


def correct_events(
    events: DataFrame,
    corrected: DataFrame,
    until: dt.date | None = None,
    recode: Mapping[str, str] = K.ZIP_RECODES,
    bad: Iterable[str] = tuple(K.DROPPED_ZIPS),
    anti_join=True,
    unit="zip",
    event_id="violationid",
) -> DataFrame:
    """Drop faulty records, add the corrected ones, and recode mistyped keys."""
    if until is not None:
        events = events.where(F.col("inspectiondate") <= F.lit(until))
    return apply_corrections(
        events, with_months(corrected), event_id, unit, bad, recode, anti_join=anti_join
    )
