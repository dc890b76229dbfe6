"""Row predicates and filters whose null handling differs from plain SQL."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import as_column
from panelwright.functions.text import has_prefix


def not_in(value, values: Iterable) -> Column:
    """Outside a set; a missing value is outside too."""
    return ~F.coalesce(as_column(value).isin(list(values)), F.lit(False))


def is_one_of_or_null(value, values: Iterable) -> Column:
    value = as_column(value)
    return value.isin(list(values)) | value.isNull()


def any_null(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """True on rows where at least one of the columns is missing."""
    return reduce(or_, [F.col(c).isNull() for c in (columns or df.columns)])


def rows_with_nulls(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.where(any_null(df, columns))


def not_prefixed(value, prefixes: Iterable[str]) -> Column:
    """Conjunction of negated prefix tests; a missing value passes no test."""
    return ~has_prefix(value, prefixes)


def flagged_if_prefixed(value, prefixes: Iterable[str], flag) -> Column:
    """Rows of the given families are kept only where ``flag`` is present."""
    return ~(has_prefix(value, prefixes) & as_column(flag).isNull())


def majority(df: DataFrame, share_col: str, above=True, cut=0.5) -> DataFrame:
    """Sub-population with a share strictly above (or below) the cut."""
    value = F.col(share_col)
    return df.where(value > cut if above else value < cut)
