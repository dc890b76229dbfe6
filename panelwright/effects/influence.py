"""Influence values by unit, and their sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.effects import kernels
from panelwright.effects.design import NEVER
from panelwright.effects.fit import Fit, Result
from panelwright.effects.numbers import normal_quantile
from panelwright.operators.panel import by_unit

SUMS = "kind STRING, i INT, values ARRAY<DOUBLE>"


def unit_arrays(fit: Fit, seed: int) -> DataFrame:
    """One row per unit: hash, cohort, covariates and outcomes in month order.

    A unit has at most one entry per month, so a row is bounded by the calendar.
    """
    names = [f"x{i}" for i in range(1, fit.k + 1)]
    entries = F.collect_list(F.struct("time", "y"))
    per_unit = by_unit(fit.rows, "unit").groupBy("unit").agg(
        F.min("cohort").alias("cohort"), *[F.min(c).alias(c) for c in names], entries.alias("_y")
    )
    if fit.layout == "balanced":
        # Every month is present: sorting the entries aligns them.
        outcomes = F.sort_array("_y").getField("y")
    else:
        months = F.array(*[F.lit(p) for p in fit.design.periods])
        by_month = F.map_from_entries("_y")
        outcomes = F.transform(months, lambda m: F.try_element_at(by_month, m))
    return per_unit.select(
        F.xxhash64("unit", F.lit(seed)).alias("hash"), "cohort", *names, outcomes.alias("y")
    )


def _part(part, month_at) -> dict:
    out = dict(vars(part))
    out["slot"] = month_at.get(part.slot)
    return out


def cell_spec(fit: Fit, result: Result) -> dict:
    month_at = {p: i for i, p in enumerate(fit.design.periods)}
    cell = result.cell
    return {
        "group": cell.group,
        "controls": fit.design.controls(cell),
        "time": month_at[cell.time],
        "base": month_at[cell.base],
        "gamma": fit.gammas.get(result.problem) if fit.method != "reg" else None,
        "parts": [_part(p, month_at) for p in result.parts],
    }


def influence_spec(fit: Fit, draws: int) -> dict:
    return {
        "layout": fit.layout,
        "method": fit.method,
        "k": fit.k,
        "months": len(fit.design.periods),
        "cohorts": [*fit.design.cohorts, NEVER],
        "cells": [cell_spec(fit, r) for r in fit.results],
        "draws": draws,
    }


def added_up(partial: DataFrame) -> DataFrame:
    """Add partial rows; a group holds one row per task."""
    return partial.groupBy("kind", "i").applyInArrow(kernels.add_sums, schema=SUMS)


def matrices(sums: DataFrame) -> dict[str, np.ndarray]:
    """Collect summed rows to matrices, one per kind."""
    found: dict[str, dict[int, list[float]]] = {}
    for row in sums.collect():
        found.setdefault(row["kind"], {})[row["i"]] = row["values"]
    return {
        kind: np.array([rows[i] for i in sorted(rows)]) for kind, rows in found.items()
    }


PARTIAL = "chunk INT, part INT, i INT, values ARRAY<DOUBLE>"
# Result columns of a chunk, cells of a covariance block, numbers that a task holds, partial sums added at once.
COLUMNS, BLOCK_CELLS, NUMBERS, ADDED = 256, 128, 4_000_000, 16


def _grouped(units: DataFrame, kernel, spec: dict, sizes: list[int]) -> DataFrame:
    """Sums of a kernel per chunk, whose numbers are ``sizes``: chunks are grouped so that a task holds few numbers,
    units are sent to every group, and partial sums of a few tasks at a time are added."""
    groups, held = [[]], 0
    for chunk, size in enumerate(sizes):
        if groups[-1] and held + size > NUMBERS:
            groups.append([])
            held = 0
        groups[-1].append(chunk)
        held += size
    spec = {**spec, "groups": groups}
    if len(groups) == 1:
        rows = units.withColumn("group", F.lit(0))
        parts = rows.rdd.getNumPartitions()
    else:
        parts = min(len(groups) * units.rdd.getNumPartitions(), 20_000)
        rows = units.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))))
        rows = rows.repartition(parts, "group", F.pmod("hash", F.lit(-(-parts // len(groups))))).sortWithinPartitions("group")
    found = rows.mapInArrow(kernel(spec), schema=PARTIAL)
    while parts > 1:
        found = found.withColumn("part", F.floor(F.col("part") / ADDED).cast("int"))
        found = found.groupBy("chunk", "part").applyInArrow(kernels.add_partials, schema=PARTIAL)
        parts = -(-parts // ADDED)
    return found


def column_errors(fit: Fit, units: DataFrame, columns: list[dict], draws: int) -> dict[str, np.ndarray]:
    """``square`` and ``error`` per result column, ``max`` per draw: the largest scaled deviation in the band.

    What comes back has one number per column and one per draw. ``columns`` are chunks with the
    ``cells`` they read, a ``map`` of them (None: the cells are the columns), ``n`` columns, the number of
    the ``first`` one, and whether they belong to the ``band``.
    """
    quartiles = normal_quantile(0.75) - normal_quantile(0.25)
    spec = {**influence_spec(fit, draws), "columns": columns, "width": quartiles}
    sums = _grouped(units, kernels.column_sums, spec, [(draws + 1) * c["n"] for c in columns])
    slim = {"width": quartiles, "columns": [{"first": c["first"], "band": c["band"]} for c in columns]}
    found = sums.groupBy("chunk").applyInArrow(kernels.column_spread(slim), schema="kind STRING, i INT, value DOUBLE")
    found = found.groupBy("kind", "i").agg(F.max("value").alias("value")).toArrow().sort_by("i")
    kinds, values = np.array(found.column("kind").to_pylist()), found.column("value").to_numpy()
    return {kind: values[kinds == kind] for kind in ("square", "error", "max")}


def cell_chunks(at: list[int]) -> list[dict]:
    """Chunks of result columns that are cells themselves."""
    chunks = [at[i : i + COLUMNS] for i in range(0, len(at), COLUMNS)]
    return [{"cells": c, "map": None, "n": len(c), "first": i * COLUMNS, "band": True} for i, c in enumerate(chunks)]


def mapped_chunk(cells: list[int], maps: np.ndarray, first: int, band: bool) -> list[dict]:
    """Chunks of result columns that are linear maps (rows) of the cells, cohorts and a constant."""
    return [
        {"cells": cells, "map": maps[i : i + COLUMNS].T, "n": len(maps[i : i + COLUMNS]), "first": first + i, "band": band}
        for i in range(0, len(maps), COLUMNS)
    ]


def covariance(fit: Fit, units: DataFrame, at: list[int]) -> np.ndarray:
    """Cross products of the influence values of some cells, put together from blocks.

    Each task adds up blocks of two chunks of cells; the whole square is only put together here.
    """
    chunks = [at[i : i + BLOCK_CELLS] for i in range(0, len(at), BLOCK_CELLS)]
    blocks = [(i, j) for i in range(len(chunks)) for j in range(i, len(chunks))]
    spec = {**influence_spec(fit, 0), "chunks": chunks, "blocks": blocks}
    sums = _grouped(units, kernels.cross_sums, spec, [len(chunks[i]) * len(chunks[j]) for i, j in blocks]).toArrow()
    out = np.zeros((len(at), len(at)))
    for chunk, row, values in zip(*[sums.column(c).to_pylist() for c in ("chunk", "i", "values")], strict=True):
        i, j = blocks[chunk]
        x, y = i * BLOCK_CELLS + row, j * BLOCK_CELLS
        out[x, y : y + len(values)] = out[y : y + len(values), x] = values
    return out
