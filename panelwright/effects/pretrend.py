"""Conditional pre-trend test: integrated moments, Cramer-von Mises form.

For every cell before treatment, ``J(u)`` is the weighted change of treated minus
controls among units whose covariates all lie at or below ``u``. The statistic
adds ``n * J(u)^2`` over cells, averaged over the evaluation points ``u``.

Every moment, drawn ones too, is a dominance sum: terms of units added over those at
or below the point. With one covariate or none these are running sums: units lie in strips of the
covariate, totals of strips are added up first, then each strip goes on from the total below it.
A strip of a single point is known from its total alone, so points that many units share are no burden.

With several covariates the square of a moment, added over points, is a sum over pairs of units of the
product of their terms times the number of points at or above both. Units are sorted into
blocks by quantiles of the covariates, and each pair of blocks is a task's row. Blocks of
points that lie below a pair in some covariate are not sent to it. What a term adds to a unit's
multiplier is linear in a few numbers of the draw, so cells are added over pairs of units before
draws are looked at. No point passes the driver, and
the number of jobs depends on neither points nor draws.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.effects import kernels
from panelwright.effects.design import Design
from panelwright.effects.fit import fit, solve, tidy_rows
from panelwright.effects.influence import (
    NUMBERS,
    SUMS,
    added_up,
    cell_spec,
    matrices,
    unit_arrays,
)
from panelwright.session import materialise
from panelwright.sources.scan import literal_table

PRETEST = (
    "statistic DOUBLE, critical_value DOUBLE, p_value DOUBLE, "
    "n_units BIGINT, n_dropped BIGINT, n_cells INT, n_points BIGINT, note STRING"
)
# Units in a strip, times this in a block that is paired with others, and cells that are handled at once.
BLOCK_UNITS = 512
PAIR_TIMES = 4
CELLS_AT_ONCE = 64


def _running_squares(units: DataFrame, spec: dict, n_units: int) -> np.ndarray:
    """Squared moments added over the weighted points of one covariate or none."""
    n_cells, width = len(spec["cells"]), 1 + spec["draws"]
    most = NUMBERS // (2 * n_cells * width)
    strips = max(1, min(-(-n_units // BLOCK_UNITS), most))
    point = F.col("x1") if spec["k"] else F.lit(0.0)
    cuts = units.approxQuantile("x1", [i / strips for i in range(1, strips)], 0.25 / strips) if spec["k"] and strips > 1 else []
    place = F.lit(0)
    if cuts:
        # Points on a cut have a strip of their own.
        places = F.array(*[F.lit(c) for c in sorted(set(cuts))])
        place = F.size(F.filter(places, lambda c: c < point)) + F.size(F.filter(places, lambda c: c <= point))
    placed = units.withColumn("place", place)
    rows = matrices(added_up(placed.mapInArrow(kernels.strip_sums(spec), schema=SUMS)).filter("kind = 'strip'").withColumn("kind", F.concat("kind", (F.col("i") / n_cells).cast("int"))))
    boxes = {r["place"]: r for r in placed.groupBy("place").agg(
        F.min(point).alias("low"), F.max(point).alias("high"), F.sum("weight").alias("weight")).collect()}
    squares, held, below, wide = np.zeros(width), np.zeros((n_cells, width)), {}, []
    for strip in sorted(boxes):
        below[strip] = held
        held = held + rows[f"strip{strip}"]
        if boxes[strip]["low"] == boxes[strip]["high"]:
            squares += boxes[strip]["weight"] * (held**2).sum(axis=0)
        else:
            wide.append(strip)
    if wide:
        spec = {**spec, "below": {s: below[s] for s in wide}}
        rest = placed.where(F.col("place").isin(wide)).repartition(len(wide), "place").sortWithinPartitions("place", "x1")
        squares += matrices(added_up(rest.mapInArrow(kernels.strip_squares(spec), schema=SUMS)))["sum"][0]
    return squares


def _blocked(units: DataFrame, k: int, n_units: int) -> DataFrame:
    """Units with their block: ranges of every covariate, crowded ones split by hash."""
    limit = PAIR_TIMES * BLOCK_UNITS
    if n_units <= limit:
        return units.withColumn("block", F.lit(0).cast("long"))
    strips = int(np.ceil((n_units / limit) ** (1 / k)))
    names = [f"x{i}" for i in range(1, k + 1)]
    shares = [i / strips for i in range(1, strips)]
    cuts = units.approxQuantile(names, shares, 0.25 / strips) if shares else [[]] * k
    place = F.lit(0).cast("long")
    for name, bounds in zip(names, cuts, strict=True):
        bounds = sorted(set(bounds))
        if bounds:
            passed = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda c: c < F.col(name)))  # noqa: B023
            place = place * strips + passed
    placed = units.withColumn("place", place)
    crowd = placed.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / limit).alias("parts"))
    split = placed.join(crowd, "place").withColumn("part", F.pmod("hash", F.col("parts")))
    return split.select(*units.columns, (F.col("place") * (1 << 20) + F.col("part")).alias("block"))


def _pairs(blocks: DataFrame, k: int) -> DataFrame:
    """Rows for ``kernels.pair_sums``: units of every pair of blocks, and the points they need."""
    box = [f"{end}{i}" for end in ("low", "high") for i in range(1, k + 1)]
    boxes = materialise(blocks.select("block", *box))
    left = boxes.select(F.col("block").alias("a"), *[F.col(f"low{i}").alias(f"al{i}") for i in range(1, k + 1)])
    right = boxes.select(F.col("block").alias("b"), *[F.col(f"low{i}").alias(f"bl{i}") for i in range(1, k + 1)])
    pairs = left.join(right, F.col("a") <= F.col("b"))
    reached = F.lit(True)
    for i in range(1, k + 1):
        reached = reached & (F.col(f"high{i}") >= F.col(f"al{i}")) & (F.col(f"high{i}") >= F.col(f"bl{i}"))
    fields = ("hash", "cohort", "x", "y")
    sides = {
        side: blocks.select(F.col("block").alias(side), *[F.col(f).alias(f"{side}_{f}") for f in fields]) for side in "ab"
    }
    points = blocks.select(F.col("block").alias("p"), F.col("x").alias("p_x"), F.col("weight").alias("p_weight"))
    unit_rows = pairs.select("a", "b").join(sides["a"], "a").join(sides["b"], "b").withColumn("kind", F.lit(0))
    point_rows = pairs.join(boxes.withColumnRenamed("block", "p"), reached).select("a", "b", "p").join(points, "p")
    rows = unit_rows.unionByName(point_rows.drop("p").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    n = boxes.count()
    # A task goes through several pairs, so that the terms' settings are sent to few tasks.
    parts = min(n * (n + 1) // 2, 8 * blocks.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, parts), "a", "b").sortWithinPartitions("a", "b", "kind")


def _paired_squares(units: DataFrame, spec: dict, n_units: int) -> np.ndarray:
    """Squared moments added over the weighted points of several covariates."""
    k = spec["k"]
    names = [f"x{i}" for i in range(1, k + 1)]
    per_unit = _blocked(units, k, n_units)
    entries = F.collect_list(F.struct("hash", "cohort", F.array(*names).cast("array<double>").alias("x"), "y", "weight")).alias("_u")
    bounds = [f(c).alias(f"{end}{i}") for i, c in enumerate(names, 1) for end, f in (("low", F.min), ("high", F.max))]
    blocks = per_unit.groupBy("block").agg(entries, *bounds).select(
        "block", *[f"_u.{c}" for c in ("hash", "cohort", "weight")], F.flatten("_u.x").alias("x"), F.flatten("_u.y").alias("y"),
        *[f"{end}{i}" for end in ("low", "high") for i in range(1, k + 1)],
    )
    pairs = _pairs(materialise(blocks), k)
    return matrices(added_up(pairs.mapInArrow(kernels.pair_sums(spec), schema=SUMS)))["sum"][0]


def pretest(
    panel: DataFrame,
    y: str,
    unit: str,
    time: str,
    group: str,
    covariates: Iterable[str] = (),
    control="notyettreated",
    eval_points: int | None = None,
    draws=1000,
    seed=1,
    alpha=0.05,
    design: Design | None = None,
) -> DataFrame:
    """One row: statistic, critical value and p-value.

    Units seen in every month take part; ``n_dropped`` counts the others. By default all their
    distinct covariate points are evaluated; ``eval_points`` asks for a sample of about that many
    (chosen by hash, so repeatable).
    """
    spark = panel.sparkSession
    covariates = list(covariates)
    k = len(covariates)
    design = design or Design.discover(panel, time, group, control)
    rows = tidy_rows(panel, y, unit, time, group, covariates, design)
    counted = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    full = counted.where(F.col("n") == len(design.periods))
    n_all = counted.count()
    fitted = fit(rows.join(full.select("unit"), "unit", "left_semi"), design, k, "ipw", "panel")
    usable = [r for r in fitted.results if not r.cell.post and r.att is not None]
    if not usable:
        row = (None, None, None, None, None, 0, 0, "no cells before treatment")
        return literal_table(spark, [row], PRETEST)

    units = materialise(unit_arrays(fitted, seed))
    n_units = units.count()
    names = [f"x{i}" for i in range(1, k + 1)]
    point = F.xxhash64(*names, F.lit(seed)) if k else F.lit(0).cast("long")
    n_points = units.select(point.alias("point")).distinct().count()
    chosen = F.lit(True)
    if eval_points and k:
        chosen = F.pmod(point, F.lit(n_points)) < eval_points
    evaluated = units.where(chosen).agg(F.count(F.lit(1)).alias("weight"), F.count_distinct(point).alias("points")).first()

    spec = {"k": k, "months": len(design.periods), "draws": draws, "chunk": CELLS_AT_ONCE}
    spec["cells"] = [cell_spec(fitted, r) for r in usable]
    for cell, result in zip(spec["cells"], usable, strict=True):
        part = result.parts[0]
        cell.update(n1=part.n1, w0=part.w0, inverse=solve(fitted.hessians[result.problem], np.eye(k + 1)))
    spec["rows"] = BLOCK_UNITS
    totals = matrices(added_up(units.mapInArrow(kernels.moment_scalars(spec), schema=SUMS)))
    _, model = kernels.models_of(spec["cells"])
    spec["drawn"] = totals.get("draw", np.zeros(0)).reshape(draws, -1, k + 3)[:, model] if draws else np.zeros((0, len(usable), k + 3))
    for c, cell in enumerate(spec["cells"]):
        spec["drawn"][:, c, :2] /= cell["n1"], cell["w0"]
        cell["odds_x"] = totals["odds"][model[c]]

    weighted = units.withColumn("weight", chosen.cast("double"))
    squares = _running_squares(weighted, spec, n_units) if k < 2 else _paired_squares(weighted, spec, n_units)
    squares *= n_units / evaluated["weight"]
    statistic, drawn = float(squares[0]), squares[1:]
    critical = float(np.quantile(drawn, 1 - alpha, method="inverted_cdf")) if draws else None
    p_value = float((drawn > statistic).mean()) if draws else None
    row = (statistic, critical, p_value, n_units, n_all - n_units, len(usable), evaluated["points"], None)
    return literal_table(spark, [row], PRETEST)
