"""Rental stock from tax lots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import constants as K
from panelwright.functions.scalars import map_values
from panelwright.functions.text import join_text
from panelwright.operators.filters import flagged_if_prefixed, not_in, not_prefixed
from panelwright.operators.grouping import sum_or_zero, sum_strict
from panelwright.operators.joins import lookup


def complaint_flags(keys: DataFrame, key="BBL") -> DataFrame:
    """Lots that ever had a complaint; 0 is no lot."""
    lots = keys.where(F.col(key) != 0).select(key).distinct()
    return lots.withColumn("possible_rental", F.lit(1))


def flag_lots(lots: DataFrame, flags: DataFrame) -> DataFrame:
    """Residential lots with their complaint flag."""
    return lookup(lots.where(F.col("unitsres") > 0), flags, {"bbl": "BBL"})


def class_counts(flagged: DataFrame) -> DataFrame:
    """Flagged lots and residential units per building class."""
    return flagged.groupBy("bldgclass").agg(
        sum_or_zero("possible_rental").alias("flagged_lots"),
        sum_or_zero("unitsres").alias("units"),
    )


def rental_stock(flagged: DataFrame) -> DataFrame:
    """Lots counted as rental stock.

    Built before the first study year, of a residential class, and for one- and
    two-family classes only with a complaint on record.
    """
    borough = map_values("borough", K.BOROUGH_BY_ABBREVIATION)
    kept = flagged.where(
        (F.col("yearbuilt") < K.BUILT_BEFORE)
        & not_prefixed("bldgclass", K.DROPPED_CLASS_PREFIXES)
        & not_in("bldgclass", K.DROPPED_CLASSES)
        & flagged_if_prefixed("bldgclass", K.FLAGGED_CLASS_PREFIXES, "possible_rental")
    )
    return kept.withColumn("tract_2010", join_text(borough, "ct2010", sep="")).drop(
        "borough", "ct2010"
    )


def stock_by(stock: DataFrame, *keys: str) -> DataFrame:
    return stock.groupBy(*keys).agg(sum_strict("unitsres").alias("unit_count_2012"))


def total_units(stock: DataFrame) -> DataFrame:
    return stock.agg(F.sum("unitsres").alias("units"))
