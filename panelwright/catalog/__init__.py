"""Registered queries over the test tables, each with an equivalent SQL text."""

from panelwright.catalog import (
    address_queries,
    effect_queries,
    event_queries,
    panel_queries,
    scalar_queries,
    scan_queries,
    summary_queries,
)
from panelwright.catalog.registry import COVERS, ORACLES, QUERIES

__all__ = [
    "COVERS", "ORACLES", "QUERIES",
    "address_queries", "effect_queries", "event_queries", "panel_queries",
    "scalar_queries", "scan_queries", "summary_queries",
]
