"""Annual census covariates: wide, named, adjusted to one price year, with shares."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import constants as K
from panelwright.functions.scalars import round_to_nearest, share
from panelwright.functions.text import strip_prefix_for
from panelwright.operators.joins import lookup, shuffled
from panelwright.operators.order import ffill
from panelwright.operators.schema_ops import drop_suffix, rename
from panelwright.sources.scan import pivot_estimates


def inflate(
    df: DataFrame, columns: Mapping[str, str], index: DataFrame, to=K.PRICE_YEAR, year="year"
) -> DataFrame:
    """Amounts in prices of one year: ``{new: source}``, from a yearly price index.

    The index has one row per year; the target level enters as a scalar subquery.
    """
    level = index.where(F.col("year") == to).select("idx").scalar()
    joined = lookup(df, index.select(F.col("year").alias("_yr"), "idx"), {year: "_yr"})
    factor: Column = F.try_divide(level, F.col("idx"))
    return joined.withColumns({new: F.col(old) * factor for new, old in columns.items()}).drop("idx")


def census_covariates(
    estimates: DataFrame,
    index: DataFrame,
    units: DataFrame | None = None,
    names: Mapping[str, str] = K.ESTIMATE_NAMES,
    shares: Mapping[str, tuple[str, str]] = K.ESTIMATE_SHARES,
    inflated: Mapping[str, str] = K.INFLATED_ESTIMATES,
    filled: Iterable[str] = tuple(K.FILLED_ESTIMATES),
    digits: int | None = 2,
    prefix_year: int | None = 2012,
    price_year=K.PRICE_YEAR,
) -> DataFrame:
    """One row per area and year with named measures, real amounts and shares.

    ``units`` restricts to listed areas before anything is derived. Missing values
    of ``filled`` take the area's previous year. ``prefix_year`` is the year whose
    ids carry the state prefix.
    """
    df = estimates
    if prefix_year is not None:
        df = df.withColumn("geoid", strip_prefix_for("geoid", K.STATE_CODE, F.col("year") == prefix_year))
    wide = drop_suffix(pivot_estimates(df, list(names)), "M")
    if units is not None:
        # After the pivot there is one row per area and year instead of one per variable to shuffle; the
        # optimizer would move a semi-join back below it.
        wide = wide.join(shuffled(units.select("geoid").distinct()), "geoid").select(*wide.columns)
    wide = rename(wide, {f"{code}E": name for code, name in names.items()})
    wide = inflate(wide, inflated, index, to=price_year)
    wide = wide.withColumns({c: round_to_nearest(c, 1) for c in inflated})
    wide = wide.withColumns({n: share(a, b, digits) for n, (a, b) in shares.items()})
    fills = list(filled)
    return ffill(wide, "geoid", "year", fills) if fills else wide
