"""Column names, types and placement."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snake(name: str) -> str:
    """``Date Added`` -> ``date_added``; ``ctLabel`` -> ``ct_label``."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()
    return name or "x"


def snake_names(df: DataFrame) -> DataFrame:
    """Snake-case every column name; clashes get a numeric suffix. No data is read."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        base = snake(raw)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def constant_columns(df: DataFrame) -> list[str]:
    """Columns holding one value only, where NULL counts as a value.

    One aggregate job for all columns. Comparing min with max needs no distinct
    counting, so nothing but one row per task is shuffled.
    """
    facts = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(df.columns):
        column = F.col(f"`{c}`")
        facts += [
            F.count(column).alias(f"_c{i}"),
            F.min(column).eqNullSafe(F.max(column)).alias(f"_same{i}"),
        ]
    row = df.agg(*facts).first()
    return [
        c
        for i, c in enumerate(df.columns)
        if row[f"_same{i}"] and row[f"_c{i}"] in (0, row["_n"])
    ]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Drop the columns whose name ends with ``suffix``, in any letter case."""
    return df.drop(*[c for c in df.columns if c.lower().endswith(suffix.lower())])


def rename(df: DataFrame, new_by_old: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(new_by_old))


def derive(df: DataFrame, columns: Mapping[str, Column], after=None, drop: Iterable[str] = ()):
    """Add or replace columns, optionally placed after another one, dropping inputs."""
    out = df.withColumns(dict(columns))
    if after is not None:
        moved = list(columns)
        kept = [c for c in out.columns if c not in columns]
        at = kept.index(after) + 1
        out = out.select(*kept[:at], *moved, *kept[at:])
    return out.drop(*drop)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast by name; values that do not convert become NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def map_numeric(df: DataFrame, fn: Callable[[Column], Column], kinds=(T.DoubleType, T.FloatType)):
    """Apply one column function to every column of the given numeric kinds."""
    hit = {f.name for f in df.schema.fields if isinstance(f.dataType, kinds)}
    return df.select(*[fn(F.col(c)).alias(c) if c in hit else F.col(c) for c in df.columns])


def fill_nulls(df: DataFrame, value) -> DataFrame:
    """Replace NULL by ``value`` in every column of a matching type."""
    return df.fillna(value)
