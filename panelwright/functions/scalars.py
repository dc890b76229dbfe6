"""Arithmetic, null-handling and conditional column helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    """Accept a column name or a Column."""
    return F.col(value) if isinstance(value, str) else value


def safe_ratio(num, den, scale=1, zero_over_zero=None) -> Column:
    """``num / den * scale``; x/0 is NULL, and 0/0 is ``zero_over_zero``.

    No NaN or infinity ever leaves this function.
    """
    num, den = as_column(num), as_column(den)
    ratio = F.try_divide(num.cast("double"), den.cast("double"))
    if scale != 1:
        ratio = ratio * F.lit(scale)
    if zero_over_zero is None:
        return ratio
    return F.when((num == 0) & (den == 0), F.lit(float(zero_over_zero))).otherwise(ratio)


def rate_per(num, den, per=1000) -> Column:
    """Events per ``per`` units of size."""
    return safe_ratio(num, den, scale=per)


def share(num, den, digits=None) -> Column:
    """A ratio, optionally rounded half-up for display."""
    ratio = safe_ratio(num, den)
    return ratio if digits is None else F.round(ratio, digits)


def percent(value) -> Column:
    return as_column(value) * 100


def round_to_nearest(value, unit=1) -> Column:
    return F.round(as_column(value) / F.lit(unit)) * F.lit(unit)


def null_default(value, default) -> Column:
    return F.coalesce(as_column(value), F.lit(default))


def null_if(value, bad) -> Column:
    return F.nullif(as_column(value), F.lit(bad))


def finite_or(value, default=None) -> Column:
    """Replace NaN and both infinities of a double column by ``default``."""
    value = as_column(value)
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(value)


def choose(*branches, default=None) -> Column:
    """``choose((cond, value), ..., default=v)``: the first true branch wins.

    Without a default an unmatched row is NULL.
    """
    (first_cond, first_value), *rest = branches
    chain = F.when(first_cond, first_value)
    for cond, value in rest:
        chain = chain.when(cond, value)
    return chain if default is None else chain.otherwise(default)


def map_values(value, mapping: Mapping, default=None) -> Column:
    """Look a value up in a small literal mapping.

    ``default`` is a Column or literal for values outside the mapping; pass the
    column itself to keep unmapped values.
    """
    value = as_column(value)
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.element_at(F.create_map(*pairs), value)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def recode(value, mapping: Mapping) -> Column:
    """Replace the listed values and keep every other one (NULL stays NULL)."""
    value = as_column(value)
    return map_values(value, mapping, default=value)


def try_number(value, kind="double") -> Column:
    """Text to number; text that is not a number gives NULL instead of an error."""
    return as_column(value).try_cast(kind)
