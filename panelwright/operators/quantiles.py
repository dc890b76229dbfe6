"""Exact quantiles per group, without gathering a group in one task.

A sketch brackets every quantile between two values. A second pass counts what
lies outside the brackets and keeps single values only inside them, a fraction
of about a thousandth of a large group. Copies of a value are counted, not kept,
so a hot value costs one row. Only the bracketed values are ordered.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.joins import broadcast_if_small
from panelwright.session import materialise

ACCURACY = 10_000
# Half-widths of the brackets, as shares of the group. The narrowest that covers
# the error of the sketch and three ranks is used; the last covers everything.
MARGINS = (0.0005, 0.005, 0.05, 1.0)


def _bracket(sketch: str, n: Column, first: int) -> tuple[Column, Column]:
    """Lower and upper value of one quantile's bracket."""
    low = high = None
    for i, margin in reversed(list(enumerate(MARGINS))):
        a = F.col(sketch)[first + 2 * i]
        b = F.col(sketch)[first + 2 * i + 1]
        wide_enough = F.lit(margin) >= F.lit(2.0 / ACCURACY) + F.try_divide(F.lit(3.0), n)
        low = a if low is None else F.when(wide_enough, a).otherwise(low)
        high = b if high is None else F.when(wide_enough, b).otherwise(high)
    return low, high


def exact_quantiles(
    df: DataFrame,
    by: Iterable[str],
    value: str,
    probabilities: Mapping[str, float],
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group with an interpolated quantile per name.

    The quantile at p of n sorted values lies at position ``(n - 1) * p``,
    interpolated linearly between its neighbours. ``also`` adds ordinary
    aggregates to the first pass.
    """
    by, also = list(by), dict(also or {})
    shares = [
        min(1.0, max(0.0, p + side * margin))
        for p in probabilities.values()
        for margin in MARGINS
        for side in (-1, 1)
    ]
    v = F.col(value).cast("double")
    facts = df.groupBy(*by).agg(
        F.count(v).alias("_n"),
        F.percentile_approx(v, shares, ACCURACY).alias("_sketch"),
        *[e.alias(name) for name, e in also.items()],
    )
    edges = {}
    for j in range(len(probabilities)):
        low, high = _bracket("_sketch", F.col("_n"), 2 * len(MARGINS) * j)
        edges |= {f"_low{j}": low, f"_high{j}": high}
    facts = materialise(facts.withColumns(edges).drop("_sketch"))

    # Values outside all brackets sort right after the last bracket below them.
    limits = facts.select(*[F.col(c).alias(f"_g_{c}") for c in by], *edges)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    placed = df.where(F.col(value).isNotNull()).join(broadcast_if_small(limits), same)
    inside, below = F.lit(False), [F.lit(float("-inf"))]
    for j in range(len(probabilities)):
        inside = inside | v.between(F.col(f"_low{j}"), F.col(f"_high{j}"))
        below.append(F.when(F.col(f"_high{j}") < v, F.col(f"_high{j}")))
    below.append(F.lit(None).cast("double"))
    counted = placed.groupBy(
        *by,
        F.when(inside, v).otherwise(F.greatest(*below)).alias("_v"),
        F.when(inside, 0).otherwise(1).alias("_outside"),
    ).agg(F.count(F.lit(1)).alias("_copies"))

    ordered = Window.partitionBy(*by).orderBy("_v", "_outside")
    last = F.sum("_copies").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_last", last).withColumn("_total", F.sum("_copies").over(
        Window.partitionBy(*by)
    ))

    def value_at(rank):
        hit = (rank < F.col("_last")) & (rank >= F.col("_last") - F.col("_copies"))
        missed = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
        return F.max(F.when(hit & (F.col("_outside") == 0), F.col("_v")).when(hit, missed))

    found = []
    for name, p in probabilities.items():
        position = (F.col("_total") - 1) * F.lit(float(p))
        low, high = value_at(F.floor(position)), value_at(F.ceil(position))
        weight = F.max(position - F.floor(position))
        found.append((low + (high - low) * weight).alias(name))
    quantiles = ranked.groupBy(*by).agg(*found)

    keyed = quantiles.withColumnsRenamed({c: f"_g_{c}" for c in by})
    return facts.select(*by, *also).join(keyed, same, "left").drop(*[f"_g_{c}" for c in by])
