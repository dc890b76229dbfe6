"""Lookups. No strategy hints on small or measured tables: adaptive execution broadcasts
a side when its measured size allows it and splits skewed partitions otherwise. Tables with
rows for every unit are marked by ``shuffled``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows=BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast only after counting the rows.

    For materialised tables with few columns, where the count is cheap; a bigger
    table is returned as it is and joins by shuffle.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """A table that is never broadcast: one with rows for every unit, read from files or exploded.

    Before it runs, its size is guessed from compressed files, without what an explode adds; the
    guess can be a hundredth of what the driver and every task would hold.
    """
    return df.hint("merge")


def _pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    return [(c, c) for c in on]


def lookup(
    left: DataFrame,
    right: DataFrame,
    on,
    null_safe=False,
    also: Iterable[str] = (),
    spread_by: Iterable[str] = (),
    salts=32,
) -> DataFrame:
    """Left equi-join. ``on`` is a key, a list of keys or ``{left: right}``.

    A NULL key matches nothing unless ``null_safe``. With ``spread_by`` the rows
    of a hot key are divided over ``salts`` parts by a hash of those columns,
    and the right side, one row per key and part, follows them; the result is
    the same. Use it where one key may hold a large part of the left side and
    the right side is too big to broadcast.

    Columns of ``also`` must be equal too, but are compared when rows have met by ``on``: a left
    side that is partitioned by ``on`` stays where it is. For whole numbers with few values to a key.
    """
    pairs = _pairs(on)
    also = list(also)
    renamed = right.withColumnsRenamed({r: f"_key_{r}" for r in [*[r for _, r in pairs], *also]})
    conditions: list[Column] = []
    for l, r in pairs:
        a, b = F.col(l), F.col(f"_key_{r}")
        conditions.append(a.eqNullSafe(b) if null_safe else a == b)
    # As a difference the optimizer takes it for no key to shuffle by.
    conditions += [F.col(c) - F.col(f"_key_{c}") == 0 for c in also]
    spread = list(spread_by)
    if spread:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
        renamed = renamed.withColumn("_part", parts)
        conditions.append(F.col("_salt") == F.col("_part"))
    out = left.join(renamed, reduce(and_, conditions), "left")
    return out.drop(*[f"_key_{r}" for r in [*[r for _, r in pairs], *also]], "_salt", "_part")


def keep_listed(df: DataFrame, listed: DataFrame, on) -> DataFrame:
    """Left semi-join: rows whose key is on the list."""
    return df.join(listed, _on_condition(df, listed, on), "left_semi")


def keep_unlisted(df: DataFrame, listed: DataFrame, on) -> DataFrame:
    """Left anti-join: rows whose key is not on the list."""
    return df.join(listed, _on_condition(df, listed, on), "left_anti")


def _on_condition(left: DataFrame, right: DataFrame, on):
    if isinstance(on, Mapping):
        return reduce(and_, [left[l] == right[r] for l, r in on.items()])
    return on


def fill_from(
    df: DataFrame, table: DataFrame, on, target: str, source: str, keep_source=False
) -> DataFrame:
    """Coalescing lookup: a missing ``target`` takes ``source`` of the second table."""
    joined = lookup(df, table, on)
    out = joined.withColumn(target, F.coalesce(F.col(target), F.col(source)))
    return out if keep_source or source == target else out.drop(source)


def unmatched(df: DataFrame, target: str) -> DataFrame:
    """Rows that no lookup resolved."""
    return df.where(F.col(target).isNull())
