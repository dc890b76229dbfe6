"""Unions, pivots and record correction."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import recode as recode_column
from panelwright.sources.scan import union_all


def pivot_wider(
    df: DataFrame, ids: Iterable[str], names_from: str, values_from: str, names: Iterable, prefix=""
) -> DataFrame:
    """Spread one column over several. The ids and the list of names are explicit."""
    cells = [
        F.max(F.when(F.col(names_from) == name, F.col(values_from))).alias(f"{prefix}{name}")
        for name in names
    ]
    return df.groupBy(*ids).agg(*cells)


def apply_corrections(
    df: DataFrame,
    fixes: DataFrame,
    id_col: str,
    key: str,
    bad_keys: Iterable = (),
    recode: Mapping | None = None,
    anti_join=True,
) -> DataFrame:
    """Replace faulty records by their hand-corrected versions.

    Rows with a missing or bad key are dropped, the corrected rows are added
    (columns they lack become NULL), and known mistyped keys are recoded. With
    ``anti_join`` a corrected id also removes its original row, so applying the
    corrections twice changes nothing.
    """
    wrong: Column = F.col(key).isNull()
    bad = list(bad_keys)
    if bad:
        wrong = wrong | F.col(key).isin(bad)
    kept = df.where(~wrong)
    if anti_join:
        kept = kept.join(fixes.select(id_col), id_col, "left_anti")
    out = union_all([kept, fixes])
    return out.withColumn(key, recode_column(key, recode)) if recode else out
