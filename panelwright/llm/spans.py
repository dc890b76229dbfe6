"""Positions of regular-expression matches in whole texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix sums are kept for every so many matches, so that long match lists take no quadratic time.
BLOCK = 256

SPAN = "array<struct<start:bigint,stop:bigint,hit:string,before:string>>"


def find_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: (start, stop, hit, before), in code points from 0.

    ``before`` is the text between the previous match and this one. The pattern must not match
    the empty string. Null gives an empty list.
    """
    body = F.coalesce(text, F.lit(""))
    parts = F.struct(
        F.split(body, pattern, -1).alias("gaps"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("hits")
    )

    def lengths(p: Column) -> Column:
        steps = F.zip_with(p["gaps"], p["hits"], lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("bigint"))
        return F.struct(p["gaps"].alias("gaps"), p["hits"].alias("hits"), steps.alias("steps"))

    def blocks(p: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(p["hits"]) - 1) / BLOCK).cast("int"))
        sums = F.aggregate(
            numbers,
            F.array(F.lit(0).cast("bigint")),
            lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(
                F.slice(p["steps"], b * BLOCK + 1, BLOCK), F.lit(0).cast("bigint"), lambda s, x: s + x))),
        )
        return F.struct(p["gaps"].alias("gaps"), p["hits"].alias("hits"), p["steps"].alias("steps"), sums.alias("sums"))

    def spans(p: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            inside = F.slice(p["steps"], block * BLOCK + 1, i - block * BLOCK)
            gap = F.get(p["gaps"], i)
            start = F.get(p["sums"], block) + F.aggregate(inside, F.lit(0).cast("bigint"), lambda s, x: s + x) + F.length(gap)
            return F.struct(
                start.alias("start"), (start + F.length(hit)).alias("stop"), hit.alias("hit"), gap.alias("before")
            )

        return F.transform(p["hits"], span)

    # One-element arrays bind intermediate results, so that they are computed once.
    found = F.get(F.transform(F.transform(F.transform(F.array(parts), lengths), blocks), spans), F.lit(0))
    return F.when(body.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def named(spans: Column, kind: str) -> Column:
    """Spans without their texts, with their kind."""
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def listed(spans: Column) -> Column:
    """kind:start:stop, joined by commas in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
