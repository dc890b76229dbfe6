"""Aggregate expressions and grouped summaries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import as_column


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_distinct(value, approx=False) -> Column:
    """Distinct values, missing ones ignored; ``approx`` opts into a sketch."""
    value = as_column(value)
    return F.approx_count_distinct(value) if approx else F.count_distinct(value)


def n_distinct_with_null(value) -> Column:
    """Distinct values where NULL counts as one more value."""
    value = as_column(value)
    return F.count_distinct(value) + F.max(value.isNull().cast("int")).cast("long")


def sum_strict(value) -> Column:
    """Sum that is missing as soon as one value is missing."""
    value = as_column(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def sum_or_zero(value) -> Column:
    """Sum of the present values; 0 when there is none."""
    return F.coalesce(F.sum(as_column(value)), F.lit(0))


def count_by(df: DataFrame, *keys: str, name="records") -> DataFrame:
    return df.groupBy(*keys).agg(n_rows().alias(name))


def profile(df: DataFrame, by: Iterable[str], means: Mapping[str, str], **others: Column):
    """Many means (and other aggregates) per group in a single pass."""
    aggregates = [expr.alias(name) for name, expr in others.items()]
    aggregates += [F.avg(F.col(c)).alias(name) for name, c in means.items()]
    by = list(by)
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def with_total(df: DataFrame, ids: Iterable[str], sums: Iterable[str], label="Total"):
    """Append one row that sums the displayed values.

    ``df`` is a finished table with one row per ``ids``. Grouping sets produce
    rows and total together, so the table is computed once. The first id column
    becomes text and carries the label.
    """
    ids = list(ids)
    out = df.groupingSets([[F.col(c) for c in ids], []], *ids).agg(
        F.grouping_id().alias("_total"), *[F.sum(c).alias(c) for c in sums]
    )
    first = ids[0]
    marked = F.when(F.col("_total") > 0, F.lit(label)).otherwise(F.col(first).cast("string"))
    return out.withColumn(first, marked).drop("_total")
