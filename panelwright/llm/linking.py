"""Groups of similar items from shared buckets, without comparing all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import components, small_side
from panelwright.session import materialise


def shared_buckets(members: DataFrame, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """Of distinct (key, id) rows: the distinct pairs (a, b), a < b, of buckets with just two ids,
    and the (key, id) rows of larger buckets; both written. Most keys are held once: they are counted in so many parts, one
    after the other, whose shuffles don't lie on disk together."""
    def counted(rows: DataFrame) -> DataFrame:
        ends = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
        return materialise(ends.filter("n > 1"))

    # The key's low bits pick its place in a shuffle, so the parts go by others.
    part = F.pmod(F.shiftright("key", 32), F.lit(parts))
    ends = reduce(DataFrame.union, [counted(members.filter(part == i) if parts > 1 else members) for i in range(parts)])
    large = materialise(ends.filter("n > 2").select("key"))
    pairs = materialise(ends.filter("n = 2").select("a", "b").distinct())
    return pairs, materialise(members.join(small_side(large), "key", "left_semi").select("key", "id"))


def group_buckets(
    pairs: DataFrame,
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    rest: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Components of all verified links between ids that share a bucket, as (id, label).

    ``pairs``: distinct (a, b), a < b, of buckets of two; ``members``: distinct (key, id) rows of
    larger buckets. ``verify`` takes pairs and returns those that are linked. First every bucket compares one pivot with
    its other members; the pivot is the member that shares most buckets, so that a group of near
    copies mostly meets the text they come from. Within a component no pair needs another
    comparison. Buckets of three ids or more that still hold several components are open:
    ``rest`` takes their rows (key, id, label) and returns all pairs across labels that can be
    linked at all. They are verified too, so no link is lost, whatever the size of a bucket.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    shares = members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("shares"))
    order = F.col("shares") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    pivots = members.join(shares, "id").groupBy("key").agg(F.max_by("id", order).alias("pivot"))
    to_pivots = (
        members.join(pivots, "key")
        .filter("id <> pivot")
        .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    )
    links = materialise(verify(pairs.union(to_pivots).distinct()))
    labels = components(links)
    labelled = members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last"))
    mixed = mixed.filter("first < last").select("key")
    still_open = materialise(labelled.join(mixed, "key", "left_semi"))
    if still_open.isEmpty():
        return labels
    more = materialise(verify(rest(still_open)))
    if more.isEmpty():
        return labels
    return components(links.union(more))


def across_labels(rows: DataFrame, key: str, condition: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids that share a key under different labels.

    Rows: key, id, label and the ``extra`` columns; ``condition`` may use each of these, with a
    suffix 2 for the other row. Within a key the rows of all labels but the most frequent one are
    joined with all rows, so that the pairs of the largest component are never formed.
    """
    counts = rows.groupBy(key, "label").agg(F.count("*").alias("n"))
    main = counts.groupBy(key).agg(F.max_by("label", "n").alias("main"), F.count("*").alias("labels"))
    main = main.filter("labels > 1").select(key, "main")
    lesser = rows.join(main, key).filter("label <> main").drop("main")
    other = rows.select(key, *[F.col(c).alias(f"{c}2") for c in ("id", "label", *extra)])
    # A pair of two lesser labels is found from either side.
    pairs = lesser.join(other, (lesser[key] == other[key]) & (F.col("label") != F.col("label2")) & (
        F.lit(True) if condition is None else condition
    ))
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
