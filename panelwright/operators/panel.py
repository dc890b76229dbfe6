"""Zero-filled unit-by-period panels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.joins import shuffled


def unit_period_counts(
    events: DataFrame, unit: str, period: str, event_id: str, name="n_events"
) -> DataFrame:
    """Distinct events per unit and period; a missing id counts as one value.

    The distinct aggregate shuffles by (unit, period, id) first, so a unit that
    holds a large part of all events is spread over all tasks.
    """
    ids = F.count_distinct(event_id)
    missing = F.max(F.col(event_id).isNull().cast("int")).cast("long")
    return events.groupBy(unit, period).agg((ids + missing).alias(name))


def by_unit(df: DataFrame, unit: str) -> DataFrame:
    """Partition by unit over all shuffle partitions.

    What follows multiplies the rows, so the shuffled size says little about the
    work; a fixed number of partitions keeps adaptive execution from merging them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), unit)


def observed_periods(events: DataFrame, period: str) -> DataFrame:
    """One row with the sorted array of the periods present in the data.

    Reads the period column only; its length is bounded by the calendar.
    """
    distinct = events.select(period).where(F.col(period).isNotNull()).distinct()
    return distinct.agg(F.sort_array(F.collect_list(period)).alias("periods"))


def calendar_months(events: DataFrame, period: str) -> DataFrame:
    """One row with every month between the first and last one observed."""
    return events.agg(
        F.sequence(F.min(period), F.max(period), F.expr("INTERVAL 1 MONTH")).alias("periods")
    )


def complete_panel(
    counts: DataFrame,
    unit: str,
    period: str,
    measure: str,
    periods: DataFrame,
    fill=0,
    keep_null_unit=True,
) -> DataFrame:
    """Every unit in every period, with ``fill`` where nothing was counted.

    ``periods`` is a one-row table with a sorted array (see the functions above);
    it enters as a scalar subquery. Counts are gathered to one map per unit, at
    most one entry per period, and spread out again inside the same partition.
    Only non-empty cells are shuffled, and the result stays partitioned by unit.
    """
    kept = counts if keep_null_unit else counts.where(F.col(unit).isNotNull())
    cells = F.map_from_entries(
        F.collect_list(F.when(F.col(period).isNotNull(), F.struct(period, measure)))
    )
    per_unit = by_unit(kept, unit).groupBy(unit).agg(cells.alias("_cells"))
    spread = per_unit.select(unit, "_cells", F.explode(periods.scalar()).alias(period))
    value = F.coalesce(F.try_element_at("_cells", F.col(period)), F.lit(fill))
    return spread.select(unit, period, value.alias(measure))


def baseline(
    annual: DataFrame, unit: str, year_col: str, year: int, columns: Mapping[str, Column]
) -> DataFrame:
    """One row per unit with its values in the baseline year.

    Taken from the annual table, one row per unit and year, before it meets the
    panel: the constant is attached by a join on unit and needs no window.
    """
    picked = annual.where(F.col(year_col) == year)
    return picked.groupBy(unit).agg(*[F.max(e).alias(name) for name, e in columns.items()])


def panel_baseline(
    panel: DataFrame, unit: str, year: Column, at: int, columns: Mapping[str, Column]
) -> DataFrame:
    """Baseline values computed on the panel itself and attached to all its rows."""
    facts = panel.groupBy(unit).agg(
        *[F.max(F.when(year == at, e)).alias(name) for name, e in columns.items()]
    )
    keyed = shuffled(facts.withColumnRenamed(unit, "_unit"))
    return panel.join(keyed, F.col(unit).eqNullSafe(F.col("_unit")), "left").drop("_unit")


def duplicated_cells(panel: DataFrame, unit: str, period: str) -> DataFrame:
    """Cells that occur more than once; empty for a valid panel."""
    counts = panel.groupBy(unit, period).agg(F.count(F.lit(1)).alias("copies"))
    return counts.where(F.col("copies") > 1)


def assert_unique(panel: DataFrame, unit: str, period: str) -> DataFrame:
    """Raise if a unit occurs twice in a period, else return the panel."""
    found = duplicated_cells(panel, unit, period).limit(1).collect()
    if found:
        raise ValueError(f"unit-period cells are not unique, for instance {found[0].asDict()}")
    return panel


def panel_facts(panel: DataFrame, unit: str, period: str, doubles: Iterable[str] = ()) -> DataFrame:
    """One row of invariants: rows, units, periods, and NaN or infinite values."""
    bad = [
        F.sum((F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("int")).alias(f"bad_{c}")
        for c in doubles
    ]
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_distinct(unit) + F.max(F.col(unit).isNull().cast("int"))).alias("n_units"),
        F.count_distinct(period).alias("n_periods"),
        *bad,
    )
