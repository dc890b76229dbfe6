"""Verbs whose result depends on row order, with the order made explicit.

Windows appear only over one unit's periods, a group bounded by the calendar.
Everything keyed by an arbitrary value uses aggregates instead, which combine
before the shuffle and never gather a hot key in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_updown(df: DataFrame, unit: str, time: str, columns: Iterable[str]) -> DataFrame:
    """Fill gaps from the next value of the unit, else from the previous one."""
    w = Window.partitionBy(unit).orderBy(time)
    down = w.rowsBetween(Window.unboundedPreceding, 0)
    up = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns(
        {
            c: F.coalesce(
                F.first(c, ignorenulls=True).over(up), F.last(c, ignorenulls=True).over(down)
            )
            for c in columns
        }
    )


def ffill(df: DataFrame, unit: str, time: str, columns: Iterable[str]) -> DataFrame:
    """Carry the last value forward inside each unit, never across units."""
    w = Window.partitionBy(unit).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def _nulls_last(columns: Iterable[str]) -> Column:
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.struct(*parts)


def first_per_key(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """The first full row of every key, in the given order."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), _nulls_last(order)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def sort_rows(df: DataFrame, *columns: str, descending=False) -> DataFrame:
    """Total order with missing values last in both directions."""
    if descending:
        return df.orderBy(*[F.col(c).desc_nulls_last() for c in columns])
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def argmax_rows(
    df: DataFrame, keys: Iterable[str], value: str, ties="first", tie_break: Iterable[str] = ()
) -> DataFrame:
    """Rows holding the largest ``value`` of their key.

    ``ties="first"`` keeps one row per key, the smallest by ``tie_break``;
    ``ties="all"`` keeps every row that reaches the maximum.
    """
    keys = list(keys)
    if ties == "first":
        rest = [c for c in df.columns if c not in keys]
        ranked = F.struct((-F.col(value)).alias("_v"), *[F.col(c) for c in tie_break])
        picked = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
            F.min_by(F.struct(*rest), ranked).alias("_row")
        )
        return picked.select(*keys, "_row.*").select(*df.columns)
    if ties != "all":
        raise ValueError(f"ties must be 'first' or 'all', not {ties!r}")
    top = df.groupBy(*keys).agg(F.max(value).alias(value))
    return df.join(top, [*keys, value], "left_semi")
