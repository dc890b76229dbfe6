"""Address standardisation and address-to-area lookup."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import constants as K
from panelwright.functions.scalars import map_values
from panelwright.functions.text import apply_rules, area_id, join_text, normal_address
from panelwright.operators.grouping import n_distinct_with_null
from panelwright.operators.joins import fill_from, lookup, unmatched
from panelwright.operators.order import first_per_key


def standardize(df: DataFrame, column: str, rules: Iterable[tuple[str, str]] = K.ADDRESS_RULES):
    """Apply the ordered spelling rules to one column."""
    return df.withColumn(column, apply_rules(column, rules))


def event_addresses(events: DataFrame, number="housenumber", street="streetname") -> DataFrame:
    """Full standard street address of every event."""
    with_address = events.withColumn("address", join_text(number, street))
    return standardize(with_address, "address")


def eviction_addresses(
    evictions: DataFrame, column="eviction_address", legacy_rules=False
) -> DataFrame:
    """Normalised eviction address with split words repaired.

    ``legacy_rules`` also swallows the blank after AV and AVE.
    """
    rules = K.SPLIT_WORD_RULES_LEGACY if legacy_rules else K.SPLIT_WORD_RULES
    return standardize(evictions.withColumn("address", normal_address(column)), "address", rules)


def borough_ids(df: DataFrame, name_col="borough", target="boroid") -> DataFrame:
    return df.withColumn(target, map_values(name_col, K.BOROUGH_BY_NAME))


def distinct_addresses(df: DataFrame, order: Iterable[str], key="address") -> DataFrame:
    """One row per address, the first in the given order, before any lookup."""
    return first_per_key(df, [key], order)


def distinct_event_addresses(
    events: DataFrame, order: Iterable[str], number="housenumber", street="streetname"
) -> DataFrame:
    """One row per standard address, the first in the given order.

    Rows are reduced to distinct raw addresses before the spelling rules run, so
    the rules see each spelling once, not each event.
    """
    raw = first_per_key(events, [number, street], order)
    return distinct_addresses(event_addresses(raw, number, street), order)


def enrich(
    addresses: DataFrame,
    coded: DataFrame,
    tract_key: DataFrame,
    address="address",
    fallback_on=("boroid", "censustract"),
) -> DataFrame:
    """Area id of each address: from the address table, else from the tract key.

    ``coded`` has one row per address with county and tract codes; ``tract_key``
    gives ``geoid_nyp`` per borough and tract label.
    """
    found = lookup(addresses, coded.select(address, "county_fips", "census_tract"), address)
    found = found.withColumn("geoid", area_id("county_fips", "census_tract", K.STATE_CODE))
    return fill_from(found, tract_key, list(fallback_on), "geoid", "geoid_nyp")


def uncoded(enriched: DataFrame) -> DataFrame:
    """Addresses no lookup resolved, the report for hand edits."""
    return unmatched(enriched, "geoid")


def events_by_area(
    evictions: DataFrame, coded: DataFrame, event_id="docket_number", name="evictions_per_tract"
) -> DataFrame:
    """Distinct events per area, matched by standard address."""
    located = lookup(evictions, coded.select("address", "geoid"), "address")
    return located.groupBy("geoid").agg(n_distinct_with_null(event_id).alias(name))


def address_frequency(df: DataFrame, key="address") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("records"))
