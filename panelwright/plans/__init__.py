"""Composite jobs: lazy chains from event tables to panels, tables and models."""

from panelwright.plans import (
    addresses,
    areas,
    census,
    charts,
    events,
    models,
    panels,
    stock,
    tables,
)

__all__ = [
    "addresses", "areas", "census", "charts", "events", "models", "panels", "stock", "tables",
]
