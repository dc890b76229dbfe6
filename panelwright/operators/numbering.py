"""Row numbers over a whole table without one task seeing all rows.

Rows are cut into key ranges; each range is numbered on its own and shifted by
the number of rows in earlier ranges. The cut points come from an approximate
sketch and influence only the balance, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut_points(df: DataFrame, column: str, buckets: int) -> list:
    """Approximate, strictly increasing range limits of a numeric column."""
    wanted = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, wanted, 100 * buckets)).first()[0]
    return sorted(set(found or []))


def with_bucket(df: DataFrame, column: str, limits: list, name="_bucket") -> DataFrame:
    """Add the number of limits at or below the value: a bucket id that keeps the order.

    A binary search written as one column step per level, so the cost per row is
    the logarithm of the number of limits.
    """
    df = df.withColumn(name, F.lit(0))
    if not limits:
        return df
    table = F.array(*[F.lit(x) for x in limits])
    step = 1 << (len(limits).bit_length() - 1)
    while step:
        reached = F.try_element_at(table, F.col(name) + step) <= F.col(column)
        df = df.withColumn(name, F.col(name) + F.when(reached, step).otherwise(0))
        step >>= 1
    return df


def number_rows(df: DataFrame, order: str, name="row_number", buckets=None) -> DataFrame:
    """Number all rows 1..n by a unique numeric key that is never missing."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limits = cut_points(df, order, buckets)
    placed = with_bucket(df, order, limits)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    return (
        placed.withColumn("_inside", inside)
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_bucket", "_inside", "_before")
    )


def batch_number(df: DataFrame, order: str, size: int, name="batch", buckets=None) -> DataFrame:
    """Batches of ``size`` consecutive rows, numbered from 1."""
    numbered = number_rows(df, order, "_row", buckets)
    return numbered.withColumn(
        name, (F.floor((F.col("_row") - 1) / size) + 1).cast("long")
    ).drop("_row")
