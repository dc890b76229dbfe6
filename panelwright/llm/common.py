"""Helpers that several operators share: word rules, document keys, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import materialise

#: A word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Small tables are broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, UPPER.lower())


def text_print(text: Column) -> Column:
    """A 64-bit print of the text, the same on every run; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def two_hashes(value: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that say nothing about each other: the second one starts from another seed."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the (written) table is counted to be small; else leave it as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links (a long, b long) as (id, label), label the smallest id.

    Alternates large-star and small-star steps until nothing changes; each step is two joins
    on the links and its result is written, so that a lost executor costs one step at most.
    Ids without a link to another id are not returned.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialise(links.distinct())
    while True:
        ends = links.select(F.col("a").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(
            links.select("b", F.lit(0), F.lit(1))
        )
        ends = ends.groupBy("id").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
        if ends.filter("child + root > 1").isEmpty():
            break  # every link leads straight to the root of its component
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b >= a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        # Small star: every a has only smaller neighbours now.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        links = materialise(small)
    roots = links.select(F.col("b").alias("id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("label")).union(
        roots.select("id", F.col("id").alias("label"))
    )
