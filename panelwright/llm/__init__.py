"""Operators for preparing training data, their registered queries and SQL."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with their jobs, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from panelwright.llm import queries_more, queries_new, queries_text  # noqa: E402
from panelwright.llm.registry import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "queries_more", "queries_new", "queries_text"]
