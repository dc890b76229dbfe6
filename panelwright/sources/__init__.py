"""Scans and sinks."""

from panelwright.sources import scan, schemas, sink

__all__ = ["scan", "schemas", "sink"]
