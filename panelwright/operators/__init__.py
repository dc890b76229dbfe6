"""Table-level verbs. Each takes DataFrames and returns a lazy DataFrame."""

from panelwright.operators import (
    filters,
    grouping,
    joins,
    numbering,
    order,
    panel,
    quantiles,
    reshape,
    schema_ops,
)

__all__ = [
    "filters",
    "grouping",
    "joins",
    "numbering",
    "order",
    "panel",
    "quantiles",
    "reshape",
    "schema_ops",
]
