"""Writing tables. Parquet is the default; CSV matches the published files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def sink(df: DataFrame, path: str, fmt="parquet", compress=True, partition_by=(), mode="overwrite"):
    """Write one table, in parallel, with its header and ``NA`` for null in CSV."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(
            path, header=True, nullValue="NA", compression="gzip" if compress else "none"
        )
    else:
        writer.format(fmt).save(path)


def sink_exceptions(df: DataFrame, bad: Column, path: str, columns=None, fmt="csv") -> DataFrame:
    """Write the rows matching ``bad`` as a report and return that report lazily."""
    report = df.where(bad)
    if columns:
        report = report.select(*columns)
    sink(report, path, fmt=fmt, compress=False)
    return report


def save_results(results: dict[str, DataFrame], folder: str):
    """Persist named result tables, one Parquet folder each."""
    for name, df in results.items():
        sink(df, f"{folder}/{name}")


def load_results(spark, folder: str, names) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
