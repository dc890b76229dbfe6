"""Result tables over several models."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.text import label


def compare(models: Mapping[str, DataFrame]) -> DataFrame:
    """Stack result tables, each row marked with its model."""
    frames = [df.select(F.lit(name).alias("model"), "*") for name, df in models.items()]
    return reduce(DataFrame.unionByName, frames)


def side_by_side(results: DataFrame, keys, values, models) -> DataFrame:
    """One row per key with the values of every model next to each other."""
    cells = [
        F.max(F.when(F.col("model") == m, F.col(v))).alias(f"{m}_{v}")
        for m in models
        for v in values
    ]
    return results.groupBy(*keys).agg(*cells)


def tidy_groups(group_bands: DataFrame, labels: Mapping[int, str], overall="All Groups"):
    """Group averages as a printed table: label, effect, error and band."""
    named = F.when(F.col("level").isNull(), F.lit(overall)).otherwise(label("level", labels))
    return group_bands.select(
        named.alias("group"), "estimate", "std_error", "conf_low", "conf_high"
    )


def pretest_table(tests: Mapping[str, DataFrame]) -> DataFrame:
    """Pre-test rows of several models with a description of their covariates."""
    frames = [
        df.select(F.lit(name).alias("covariates"), "statistic", "critical_value", "p_value")
        for name, df in tests.items()
    ]
    return reduce(DataFrame.unionByName, frames)
