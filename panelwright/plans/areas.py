"""Area crosswalks: which ZIP a tract belongs to, and tract vintages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import constants as K
from panelwright.functions.text import first_chars, last_chars
from panelwright.operators.joins import lookup
from panelwright.operators.order import argmax_rows
from panelwright.operators.schema_ops import snake_names
from panelwright.plans.events import attach_cohorts


def city_ratios(ratios: DataFrame, state=K.STATE_CODE, counties: Iterable[str] = tuple(K.COUNTY_CODES)):
    """Crosswalk rows of the city, with the parts of the tract id split off."""
    split = ratios.withColumns(
        {
            "state_code": first_chars("tract", 2),
            "county_code": first_chars("tract", 3, start=3),
            "tract_code": first_chars("tract", 6, start=6),
        }
    )
    return split.where((F.col("state_code") == state) & F.col("county_code").isin(list(counties)))


def assign_area(
    ratios: DataFrame,
    treated_targets: DataFrame | None = None,
    from_="tract",
    to="zip",
    ratio="res_ratio",
    ties="first",
    min_ratio=0.0,
) -> DataFrame:
    """The target area with the largest share, per source area.

    ``impacted`` marks sources that touch both treated and untreated targets.
    Group facts and the winning row come from aggregates, which combine before
    the shuffle, so a source with very many rows costs no single task more.
    ``ties="all"`` keeps every target that reaches the largest share, which makes
    later lookups multiply rows. A share of ``min_ratio`` or less is no match.
    """
    rows = ratios.select(from_, to, F.coalesce(F.col(ratio), F.lit(0.0)).alias(ratio))
    if treated_targets is None:
        rows = rows.withColumn("_treated", F.lit(0))
    else:
        listed = treated_targets.select(to).distinct().withColumn("_treated", F.lit(1))
        rows = lookup(rows, listed, to).withColumn("_treated", F.coalesce("_treated", F.lit(0)))
    mixed = F.min("_treated") != F.max("_treated")
    if ties == "first":
        # Largest ratio first, then the smallest target.
        best = F.min_by(F.struct(to, ratio), F.struct(-F.col(ratio), F.col(to)))
        out = rows.groupBy(from_).agg(best.alias("_best"), mixed.alias("impacted"))
        out = out.select(from_, "_best.*", "impacted")
    else:
        flags = rows.groupBy(from_).agg(mixed.alias("impacted"))
        top = argmax_rows(rows, [from_], ratio, ties="all").drop("_treated")
        out = top.join(flags, from_)
    return out.where(F.col(ratio) > min_ratio)


def tract_cohorts(assignments: DataFrame, rollout: DataFrame, **last) -> DataFrame:
    """Cohort and treat date of each tract through the ZIP it is assigned to."""
    keyed = assignments.select(F.col("zip").alias("tract_treat_zip"), F.col("tract").alias("geoid"))
    return attach_cohorts(keyed, rollout, "tract_treat_zip", **last)


def tract_vintages(relationships: DataFrame) -> DataFrame:
    """Tract ids of both census vintages and their six-digit tract codes."""
    table = snake_names(relationships).select("geoid_tract_20", "geoid_tract_10")
    return table.withColumns(
        {
            "census_tract_10": last_chars("geoid_tract_10", 6),
            "census_tract_20": last_chars("geoid_tract_20", 6),
        }
    )
