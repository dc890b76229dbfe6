"""Panels and staggered policy evaluation as Spark jobs."""

from panelwright import effects, functions, operators, plans, sources
from panelwright.session import build_session, materialise

__all__ = [
    "build_session", "effects", "functions", "materialise", "operators", "plans", "sources",
]
