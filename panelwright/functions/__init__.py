"""Column-level building blocks: every helper takes and returns Spark columns."""

from panelwright.functions import constants, dates, scalars, text

__all__ = ["constants", "dates", "scalars", "text"]
