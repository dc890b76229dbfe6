"""Reading tables: delimited text with declared schemas, filtered scans, wide loads.

Filters and column lists are ordinary DataFrame expressions, so on columnar
input Catalyst hands both to the file reader.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scan(
    spark: SparkSession,
    path,
    schema: str | None = None,
    where: Column | None = None,
    columns: Iterable[str] | None = None,
    sep=",",
    null_value="NA",
    partitions: int | None = None,
) -> DataFrame:
    """Read Parquet, or delimited text (also gzip) when a schema is given.

    A gzip file is read by one task; ``partitions`` spreads its rows before any
    further work.
    """
    if schema is None:
        df = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    else:
        df = (
            spark.read.schema(schema)
            .option("header", True)
            .option("sep", sep)
            .option("nullValue", null_value)
            .csv(path)
        )
    if partitions:
        df = df.repartition(partitions)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def scan_piped(spark: SparkSession, path, schema: str, **options) -> DataFrame:
    """Pipe-delimited text."""
    return scan(spark, path, schema, sep="|", **options)


def between_dates(column: str, first, last) -> Column:
    """Inclusive time-range predicate on a raw column, so it reaches the scan."""
    return F.col(column).between(F.lit(first), F.lit(last))


def date_and_code_filter(date_col, first, last, code_col, codes) -> Column:
    """Time range AND a list of codes, the filter of the event pull."""
    return between_dates(date_col, first, last) & F.col(code_col).isin(list(codes))


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys in key order."""
    return df.select(*keys).distinct().orderBy(*keys)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union of tables by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_years(frames_by_year: Mapping[int, DataFrame], year_col="year") -> DataFrame:
    """Bind one table per year, each row marked with its year."""
    return union_all(
        df.withColumn(year_col, F.lit(year).cast("int")) for year, df in frames_by_year.items()
    )


def pivot_estimates(
    df: DataFrame,
    variables: Iterable[str],
    keys=("year", "geoid"),
    variable="variable",
    estimate="estimate",
    margin: str | None = None,
) -> DataFrame:
    """One column per variable, suffixed E (estimate) and, if asked, M (margin).

    The list of variables is explicit: no extra job to discover it, and a fixed
    schema. Conditional aggregates keep a single partially combined shuffle.
    """
    picked = []
    for v in variables:
        hit = F.col(variable) == v
        picked.append(F.max(F.when(hit, F.col(estimate))).alias(f"{v}E"))
        if margin:
            picked.append(F.max(F.when(hit, F.col(margin))).alias(f"{v}M"))
    return df.groupBy(*keys).agg(*picked)


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table written in code.

    Passed as Arrow, so it becomes a local relation whose size the optimizer knows.
    """
    columns = to_arrow_schema(StructType.fromDDL(schema))
    by_column = list(zip(*rows, strict=True)) or [()] * len(columns)
    arrays = [pa.array(v, f.type) for v, f in zip(by_column, columns, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=columns))
