"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import materialise

WEIGHTS = (5, 2, 1)
#: Words of the mix for every word of the input.
BUDGET = 1.5
#: Most times that a document is taken.
REPEATS = 2

BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def _running(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one, in the group and by the order.

    The rows are range-sorted and written; ranges are summed, and a row adds the sums of its
    group's ranges before its own to a window within its range. No task sorts a whole group.
    """
    keys = [F.col(c) for c in group]
    ranged = df.withColumn("_value", value).repartitionByRange(*keys, *order)
    ranged = materialise(ranged.withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(c).alias(f"_of_{c}") for c in group],
        F.col("_range").alias("_of_range"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    match = F.col("_range") == F.col("_of_range")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inner = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn(name, F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    out = within.join(sums, match).withColumn(name, F.col(name) + F.col("_before"))
    return out.drop("_value", "_range", "_of_range", "_before", *[f"_of_{c}" for c in group])


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources by code point, null last, weigh ``weights`` in turn. Each gets its share of the budget
    by weight, but at most ``repeats`` times its size; what is above is shared again until no
    source is above. A source without words has target 0.
    """
    order = [F.col("source").isNull(), F.col("source")]
    placed = _running(sources, [], order, F.lit(1), "place")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.select("source", "source_size", weight.cast("long").alias("weight"))
    placed = materialise(placed.withColumn("cap", F.col("source_size") * repeats))
    words = (placed.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, capped = 0.0, F.lit(False)
    while True:
        row = placed.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
            F.count(F.when(capped, 1)),
        ).first()
        if row[1] == 0:
            target = F.col("cap").cast("double")
            break
        new = (words - row[0]) / row[1]
        if new == level:
            target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
            break
        level = new
        capped = F.col("cap") < F.col("weight") * F.lit(level)
    return placed.select("source", "source_size", target.alias("target"))


def _taken(sized: DataFrame, weights, budget: float, repeats: int) -> DataFrame:
    """Rows (row, source, key, size) with source_size, target and taken added."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialise(targets(sizes, weights, budget, repeats))
    goal = goals.select(F.col("source").alias("of_source"), "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("of_source"))
    total = goals.agg(F.sum("target")).first()[0] or 0.0

    queued = sized.filter("size > 0").select("row", "source", "key", "size")
    queued = _running(queued, ["source"], [F.col("key"), F.col("row")], F.col("size"), "before")
    queued = queued.join(goal, same).filter("target > 0")
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    end = F.col("copy") * F.col("source_size") + F.col("before") + F.col("size")
    copies = copies.select("row", "source", "key", "copy", "size", (end / F.col("target")).alias("finish"))
    by_time = [F.col("finish"), F.col("source").isNull(), F.col("source"), F.col("key"), F.col("copy"), F.col("row")]
    served = _running(copies, [], by_time, F.col("size"), "spent")
    room = F.greatest(F.floor(F.lit(total)).cast("long") - F.col("spent"), F.lit(0))
    taken = served.groupBy("row").agg(F.sum(F.least("size", room)).alias("taken"))
    return sized.join(goal, same).join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def _key(id: str, text: str, seed: int) -> Column:
    """The place of a document in the shuffle."""
    blank = F.lit("")
    return F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id).cast("string"), blank), F.coalesce(F.col(text), blank))
    )


def mixed_sizes(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    source: str = "source",
    weights=WEIGHTS,
    budget: float = BUDGET,
    repeats: int = REPEATS,
    seed: int = 0,
) -> DataFrame:
    """One row per document: ``id``, size, source_size, target, taken.

    The documents of a source queue in a fixed shuffle, ``repeats`` times over. The finish time of
    a queued copy is the number of the source's words up to its end, divided by the source's
    target. Copies are taken by finish time until the budget is spent; the copy at the border is
    taken in part. So every source comes within one document of its target, and the budget is
    met exactly. Documents without words (null or blank) have size 0 and take nothing. Null is a
    source of its own. The shuffle is a hash of id and text, so reruns agree; of rows that agree
    in both, any may be served first. An empty table gives no rows. Other columns are not read.
    """
    sized = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id).cast("long").alias("doc"),
        F.col(source).cast("string").alias("source"),
        n_words(F.col(text)).alias("size"),
        _key(id, text, seed).alias("key"),
    )
    found = _taken(materialise(sized), weights, budget, repeats)
    return found.select(F.col("doc").alias(id), "size", "source_size", "target", "taken")


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    source: str = "source",
    weights=WEIGHTS,
    budget: float = BUDGET,
    repeats: int = REPEATS,
    seed: int = 0,
) -> DataFrame:
    """The documents of the mix with all their columns, and size, source_size, target, taken.

    ``taken`` is the number of words to take, above ``size`` where the document is repeated.
    Documents that take nothing are left out. Columns of these names in ``docs`` are replaced.
    """
    columns = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    numbered = materialise(docs.select(*columns, F.monotonically_increasing_id().alias("_pw_row")))
    sized = materialise(
        numbered.select(
            F.col("_pw_row").alias("row"),
            F.col(source).cast("string").alias("source"),
            n_words(F.col(text)).alias("size"),
            _key(id, text, seed).alias("key"),
        )
    )
    found = _taken(sized, weights, budget, repeats).filter("taken > 0")
    found = found.select(F.col("row").alias("_pw_row"), "size", "source_size", "target", "taken")
    return numbered.join(found, "_pw_row").drop("_pw_row")
