"""Array work on batches of units, run inside Spark tasks.

A batch is a block of units with their cohort, covariates and outcomes by month.
Each function returns partial sums that Spark adds up. The module is shipped by
value, so executors need no installed copy.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Two-point multiplier: mean 0, variance 1, third moment 1.
ROOT5 = 5.0**0.5
LOW, HIGH = (1 - ROOT5) / 2, (1 + ROOT5) / 2
P_LOW = (1 + ROOT5) / (2 * ROOT5)


def multipliers(hashes: np.ndarray, draws: int) -> np.ndarray:
    """Multipliers per unit and draw from a 64-bit hash of the unit.

    They depend on unit, draw and seed only: not on partitioning, and a task that
    runs again gives the same numbers.
    """
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        z = hashes.astype(np.int64).view(np.uint64)[:, None] + step * np.arange(
            1, draws + 1, dtype=np.uint64
        )
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    uniform = (z >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.where(uniform < P_LOW, LOW, HIGH)


def unpack(batch: pa.RecordBatch, k: int, months: int):
    """Hash, cohort, covariates with intercept, and outcomes (NaN where missing)."""
    columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    n = batch.num_rows
    X = np.ones((n, k + 1))
    for i in range(1, k + 1):
        X[:, i] = columns[f"x{i}"].to_numpy(zero_copy_only=False)
    Y = columns["y"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, months)
    hashes = columns["hash"].to_numpy(zero_copy_only=False)
    cohort = columns["cohort"].to_numpy(zero_copy_only=False)
    return hashes, cohort, X, Y


def chance(score: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-score))


def influence(spec: dict, cohort: np.ndarray, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """Influence of every unit on every cell: units x cells, zero where not involved."""
    psi = np.zeros((len(cohort), len(spec["cells"])))
    where = {g: np.flatnonzero(cohort == g) for g in np.unique(cohort)}
    none = np.empty(0, dtype=int)
    for c, cell in enumerate(spec["cells"]):
        if not cell["parts"]:
            continue
        treated = where.get(cell["group"], none)
        control = np.concatenate([where.get(g, none) for g in cell["controls"]] or [none])
        fill = _months_cell if spec["layout"] == "months" else _difference_cell
        fill(psi[:, c], spec, cell, treated, control, X, Y)
    return psi


def _difference_cell(out, spec, cell, treated, control, X, Y):
    part = cell["parts"][0]
    gamma = cell["gamma"]
    for rows, is_treated in ((treated, True), (control, False)):
        value = Y[rows, cell["time"]] - Y[rows, cell["base"]]
        seen = ~np.isnan(value)
        rows, value = rows[seen], value[seen]
        x = X[rows]
        rest = value - x @ part["beta"]
        if is_treated:
            effect = (rest - part["level1"]) / part["n1"]
        else:
            weight = 1.0 if gamma is None else np.exp(x @ gamma)
            effect = rest * (x @ part["u_beta"]) - weight * (rest - part["level0"]) / part["w0"]
        if gamma is not None:
            effect += (is_treated - chance(x @ gamma)) * (x @ part["u_gamma"])
        out[rows] = effect


def _months_cell(out, spec, cell, treated, control, X, Y):
    gamma = cell["gamma"]
    present = (~np.isnan(Y[:, cell["time"]])).astype(float) + ~np.isnan(Y[:, cell["base"]])
    for part in cell["parts"]:
        sign, slot = part["sign"], part["slot"]
        for rows, is_treated in ((treated, True), (control, False)):
            x, copies = X[rows], present[rows]
            total = np.zeros(len(rows))
            if is_treated and part["n1_all"]:
                if part["beta1"] is None:
                    predicted = -(x @ part["beta"])
                else:
                    predicted = x @ (part["beta1"] - part["beta"])
                total += copies * (predicted - part["gap_all"]) / part["n1_all"]
            if gamma is not None:
                total += copies * (is_treated - chance(x @ gamma)) * (x @ part["u_gamma"])
            y = Y[rows, slot]
            seen = ~np.isnan(y)
            x, y = x[seen], y[seen]
            if is_treated and spec["method"] == "reg":
                effect = (y - part["level1"]) / part["n1"]
            elif is_treated:
                effect = (y - x @ part["beta"] - part["level1"]) / part["n1"]
                if part["beta1"] is not None:
                    gap = x @ (part["beta1"] - part["beta"])
                    effect -= (gap - part["gap_level"]) / part["n1"]
                    effect += (y - x @ part["beta1"]) * (x @ part["u_beta1"])
            else:
                rest = y - x @ part["beta"]
                weight = 1.0 if gamma is None else np.exp(x @ gamma)
                effect = rest * (x @ part["u_beta"]) - weight * (rest - part["level0"]) / part["w0"]
            total[seen] += effect
            out[rows] += sign * total


# Cells whose influence values are held at once.
CELLS_HELD = 256


def column_values(spec: dict, column: dict, cohort, X, Y) -> np.ndarray:
    """Values of every unit on a few result columns: its influence on cells, or a linear map of it.

    A map has rows for the cells, the cohorts and a constant; cells are gone through a few at a
    time, so that only the result columns are held.
    """
    cells = column["cells"]
    if column["map"] is None:
        return influence({**spec, "cells": [spec["cells"][c] for c in cells]}, cohort, X, Y)
    weights = column["map"]
    out = (cohort[:, None] == np.array(spec["cohorts"])) @ weights[len(cells) : -1] + weights[-1]
    for start in range(0, len(cells), CELLS_HELD):
        some = cells[start : start + CELLS_HELD]
        out += influence({**spec, "cells": [spec["cells"][c] for c in some]}, cohort, X, Y) @ weights[start : start + len(some)]
    return out


def _by_group(batches, spec):
    """(group, hashes, cohort, X, Y) of batches that are sorted by group."""
    for batch in batches:
        groups = batch.column(batch.schema.get_field_index("group")).to_numpy(zero_copy_only=False)
        for group in np.unique(groups):
            yield int(group), *unpack(batch.filter(pa.array(groups == group)), spec["k"], spec["months"])


def _partial(chunk: int, part: int, matrix: np.ndarray) -> pa.RecordBatch:
    n = len(matrix)
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(matrix), pa.list_(pa.float64()))],
        names=["chunk", "part", "i", "values"],
    )


def column_sums(spec: dict):
    """mapInArrow function: squares (row 0) and bootstrap sums (rows 1..) of result columns.

    A task holds draws x columns of one group of chunks, never cells x cells.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        current, totals = None, {}
        for group, hashes, cohort, X, Y in _by_group(batches, spec):
            if group != current:
                yield from (_partial(c, part, total) for c, total in totals.items())
                current, totals = group, {c: 0.0 for c in spec["groups"][group]}
            V = multipliers(hashes, spec["draws"]).T if spec["draws"] else None
            for c in totals:
                values = column_values(spec, spec["columns"][c], cohort, X, Y)
                squares = (values**2).sum(axis=0)[None, :]
                totals[c] = totals[c] + (squares if V is None else np.concatenate([squares, V @ values]))
        yield from (_partial(c, part, total) for c, total in totals.items())

    return run


def cross_sums(spec: dict):
    """mapInArrow function: blocks of the cross products of influence values, one for each two chunks of cells."""

    def run(batches):
        part = TaskContext.get().partitionId()
        current, totals = None, {}
        for group, _, cohort, X, Y in _by_group(batches, spec):
            if group != current:
                yield from (_partial(c, part, total) for c, total in totals.items())
                current, totals = group, {c: 0.0 for c in spec["groups"][group]}
            held = {}
            for c in totals:
                one, two = (
                    held.setdefault(i, influence({**spec, "cells": [spec["cells"][x] for x in spec["chunks"][i]]}, cohort, X, Y))
                    if i not in held else held[i] for i in spec["blocks"][c]
                )
                totals[c] = totals[c] + one.T @ two
        yield from (_partial(c, part, total) for c, total in totals.items())

    return run


def add_partials(table: pa.Table) -> pa.Table:
    """applyInArrow function: add the partial rows of a few tasks for one chunk."""
    values = table.column("values").combine_chunks()
    index = table.column("i").to_numpy()
    total = np.zeros((int(index.max()) + 1, len(values[0].values)))
    np.add.at(total, index, values.flatten().to_numpy(zero_copy_only=False).reshape(len(index), -1))
    return pa.Table.from_batches([_partial(table.column("chunk")[0].as_py(), table.column("part")[0].as_py(), total)])


def column_spread(spec: dict):
    """applyInArrow function: per column of a chunk its squares and its error, per draw the largest scaled deviation."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        values = table.column("values").combine_chunks()
        order = np.argsort(table.column("i").to_numpy())
        sums = values.flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order]
        squares, spread = sums[0], sums[1:]
        at = spec["columns"][chunk]["first"] + np.arange(len(squares))
        kinds, index, found = ["square"] * len(at), [*at], [*squares]
        if len(spread):
            low, high = np.quantile(spread, [0.25, 0.75], axis=0, method="inverted_cdf")
            errors = (high - low) / spec["width"]
            kinds, index, found = kinds + ["error"] * len(at), index + [*at], found + [*errors]
            if spec["columns"][chunk]["band"]:
                with np.errstate(divide="ignore", invalid="ignore"):
                    scaled = np.abs(spread / errors)
                scaled[:, errors <= 1e-12] = 0.0
                kinds, index = kinds + ["max"] * len(spread), index + [*range(len(spread))]
                found += [*scaled.max(axis=1)]
        return pa.table({"kind": pa.array(kinds, pa.string()), "i": pa.array(index, pa.int32()), "value": pa.array(found, pa.float64())})

    return run


def sums_batch(matrices: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds, index, values = [], [], []
    for kind, matrix in matrices.items():
        kinds += [kind] * len(matrix)
        index += range(len(matrix))
        values += list(matrix)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(kinds, pa.string()),
            pa.array(index, pa.int32()),
            pa.array(values, pa.list_(pa.float64())),
        ],
        names=["kind", "i", "values"],
    )


def add_sums(table: pa.Table) -> pa.Table:
    """applyInArrow function: add the partial rows of one (kind, i)."""
    values = table.column("values").combine_chunks()
    total = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).sum(axis=0)
    return pa.table(
        {
            "kind": table.column("kind").slice(0, 1),
            "i": table.column("i").slice(0, 1),
            "values": pa.array([total], pa.list_(pa.float64())),
        }
    )


def moment_terms(spec: dict, cohort, X, Y):
    """Per cell of a pre-test: outcome terms of treated and controls, odds and scores."""
    terms = []
    where = {g: np.flatnonzero(cohort == g) for g in np.unique(cohort)}
    none = np.empty(0, dtype=int)
    for cell in spec["cells"]:
        treated = where.get(cell["group"], none)
        control = np.concatenate([where.get(g, none) for g in cell["controls"]] or [none])
        rows = np.concatenate([treated, control])
        d = np.arange(len(rows)) < len(treated)
        score = X[rows] @ cell["gamma"]
        odds = np.where(d, 0.0, np.exp(score))
        change = Y[rows, cell["time"]] - Y[rows, cell["base"]]
        terms.append((rows, d, odds, chance(score), change))
    return terms


def models_of(cells: list[dict]) -> tuple[list[int], list[int]]:
    """The first cell of every model (same treated, controls and coefficients), and the model of each cell."""
    found: dict[tuple, int] = {}
    firsts, model = [], []
    for c, cell in enumerate(cells):
        key = (cell["group"], tuple(cell["controls"]), np.asarray(cell["gamma"]).tobytes())
        if key not in found:
            found[key] = len(firsts)
            firsts.append(c)
        model.append(found[key])
    return firsts, model


def moment_scalars(spec: dict):
    """mapInArrow function: sums over units that neither a point nor the months of a cell change.

    Row ``draw`` b: per model the drawn number of treated, odds and scores; row ``odds`` m: the
    odds-weighted covariates of model m. All models are one product of matrices.
    """

    def run(batches):
        p = spec["k"] + 1
        models = {**spec, "cells": [spec["cells"][c] for c in models_of(spec["cells"])[0]]}
        n = len(models["cells"])
        drawn = np.zeros((spec["draws"], n * (2 + p)))
        odds_x = np.zeros((n, p))
        for batch in _parts(batches, spec["rows"]):
            hashes, cohort, X, Y = unpack(batch, spec["k"], spec["months"])
            weights = np.zeros((len(hashes), n, 2 + p))
            for m, (rows, d, odds, p_hat, _) in enumerate(moment_terms(models, cohort, X, Y)):
                weights[rows, m] = np.column_stack([d, odds, (d - p_hat)[:, None] * X[rows]])
                odds_x[m] += odds @ X[rows]
            drawn += multipliers(hashes, spec["draws"]).T @ weights.reshape(len(hashes), -1)
        yield sums_batch({"draw": drawn, "odds": odds_x})

    return run


def moment_sides(spec: dict, cohort, X, Y):
    """Per cell: rows of the block in use, their terms as treated and as controls, and how the estimated
    weights of the controls move the moment, per unit."""
    for cell, (rows, d, odds, _, change) in zip(spec["cells"], moment_terms(spec, cohort, X, Y), strict=True):
        one, other = d * change / cell["n1"], odds * change / cell["w0"]
        slope = -(other[:, None] * X[rows] - np.outer(other, cell["odds_x"]) / cell["w0"]) @ cell["inverse"]
        yield rows, one, other, slope


def moment_columns(spec: dict, first: int, last: int, hashes, cohort, X, Y):
    """Per cell first..last: rows of the block in use and their terms, one column for the test and one per draw.

    The moment at a point adds the terms of all units at or below it.
    """
    V = multipliers(hashes, spec["draws"])
    part = {**spec, "cells": spec["cells"][first:last]}
    for c, (rows, one, other, slope) in enumerate(moment_sides(part, cohort, X, Y), first):
        treated, controls, scores = spec["drawn"][:, c, 0], spec["drawn"][:, c, 1], spec["drawn"][:, c, 2:]
        drawn = V[rows] * (one - other)[:, None] - np.outer(one, treated) + np.outer(other, controls) + slope @ scores.T
        yield rows, np.column_stack([one - other, drawn])


def _block(get, side: str, k: int, months: int):
    hashes = get(f"{side}_hash")
    X = np.ones((len(hashes), k + 1))
    X[:, 1:] = get(f"{side}_x").reshape(len(hashes), k)
    return hashes, get(f"{side}_cohort"), X, get(f"{side}_y").astype(float).reshape(len(hashes), months)


def _factors(spec: dict, first: int, last: int, block):
    """What the terms of cells first..last are made of, zero for units that a cell does not use.

    The term of a unit and draw is its multiplier times ``P`` plus ``L`` times numbers of the draw.
    """
    _, cohort, X, Y = block
    cells = spec["cells"][first:last]
    P, L = np.zeros((len(X), len(cells))), np.zeros((len(X), len(cells), 3 + spec["k"]))
    for c, (rows, one, other, slope) in enumerate(moment_sides({**spec, "cells": cells}, cohort, X, Y)):
        P[rows, c] = one - other
        L[rows, c] = np.column_stack([one, other, slope])
    return P, L.reshape(len(X), -1)


def _pair_total(spec: dict, same: bool, one, two, above: np.ndarray) -> np.ndarray:
    """Sum of products of the terms of two blocks, weighted by the points at or above both units.

    As the part of a term that units share is linear in numbers of the draw, draws meet sums over
    pairs of units that were taken once: no product over pairs is made per cell and draw.
    """
    V, W = multipliers(one[0], spec["draws"]), multipliers(two[0], spec["draws"])
    total = np.zeros(1 + spec["draws"])
    weights = np.zeros_like(above)
    for first in range(0, len(spec["cells"]), spec["chunk"]):
        last = min(first + spec["chunk"], len(spec["cells"]))
        P, L = _factors(spec, first, last, one)
        Q, M = (P, L) if same else _factors(spec, first, last, two)
        n, m = last - first, 3 + spec["k"]
        weights += P @ Q.T
        if not spec["draws"]:
            continue
        drawn = spec["drawn"][:, first:last] * np.where(np.arange(m) == 0, -1.0, 1.0)
        numbers = drawn.reshape(len(drawn), -1)
        near = above @ M
        met = V.T @ (np.repeat(P, m, axis=1) * near)
        met += met if same else W.T @ (np.repeat(Q, m, axis=1) * (above.T @ L))
        total[1:] += (met * numbers).sum(axis=1)
        shared = np.einsum("icx,icy->cxy", L.reshape(-1, n, m), near.reshape(-1, n, m))
        total[1:] += np.einsum("bcx,cxy,bcy->b", drawn, shared, drawn, optimize=True)
    weights *= above
    total[0] = weights.sum()
    if spec["draws"]:
        total[1:] += (V * (weights @ W)).sum(axis=0)
    return total if same else 2 * total


def _count_above(above: np.ndarray, one: np.ndarray, two: np.ndarray, points: np.ndarray, weight: np.ndarray) -> None:
    """Add the weight of the points at or above both units, for every unit of ``one`` and of ``two``."""
    used = (weight != 0) & (points >= np.maximum(one.min(axis=0), two.min(axis=0))).all(axis=1)
    points, weight = points[used], weight[used]
    if not len(points):
        return
    flags = []
    for x in (one, two):
        # Covariates in which every point lies above all units say nothing.
        told = np.flatnonzero(points.min(axis=0) < x.max(axis=0))
        inside = None
        for j in told:
            passed = x[:, j][:, None] <= points[:, j][None, :]
            inside = passed if inside is None else inside & passed
        flags.append(inside)
    left, right = flags
    if left is None and right is None:
        above += weight.sum()
    elif right is None:
        above += (left @ weight)[:, None]
    elif left is None:
        above += right @ weight
    else:  # whole numbers no larger than a block, which single precision holds exactly
        above += (left * weight.astype(np.float32)) @ right.T.astype(np.float32)


def pair_sums(spec: dict):
    """mapInArrow function: sums over pairs of blocks of units.

    Rows come sorted by pair: first the units of both blocks, then blocks of points, which are
    counted for every two units. Memory is bounded by two blocks and ``chunk`` cells.
    """

    def run(batches):
        total = np.zeros(1 + spec["draws"])
        pair = above = None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                if batch.column("kind")[i].as_py() == 0:
                    if pair is not None:
                        total += _pair_total(spec, *pair, above)
                    same = batch.column("a")[i].as_py() == batch.column("b")[i].as_py()
                    one = _block(get, "a", spec["k"], spec["months"])
                    two = one if same else _block(get, "b", spec["k"], spec["months"])
                    pair, above = (same, one, two), np.zeros((len(one[0]), len(two[0])))
                    continue
                weight = get("p_weight")
                _count_above(above, pair[1][2][:, 1:], pair[2][2][:, 1:], get("p_x").reshape(len(weight), spec["k"]), weight)
        if pair is not None:
            total += _pair_total(spec, *pair, above)
        yield sums_batch({"sum": total[None, :]})

    return run


def _parts(batches, rows: int):
    """The batches cut to so many rows, so that what is drawn for them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _added_by(keys: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    """Rows of terms added by their key, 0 to n - 1."""
    out = np.zeros((n, terms.shape[1]))
    if len(keys):
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=-1))
        out[keys[order][first]] = np.add.reduceat(terms[order], first, axis=0)
    return out


def strip_sums(spec: dict):
    """mapInArrow function: terms added by strip; row ``strip * cells + cell`` holds the test and its draws."""

    def run(batches):
        n, p = len(spec["cells"]), spec["k"] + 1
        found: dict[int, np.ndarray] = {}
        shared: dict[int, np.ndarray] = {}
        for batch in _parts(batches, spec["rows"]):
            place = batch.column("place").to_numpy(zero_copy_only=False)
            hashes, cohort, X, Y = unpack(batch, spec["k"], spec["months"])
            V = multipliers(hashes, spec["draws"])
            # Per unit and cell: the term, its two sides, and how estimated weights move it.
            terms = np.zeros((len(hashes), n, 3 + p))
            for c, (rows, one, other, slope) in enumerate(moment_sides(spec, cohort, X, Y)):
                terms[rows, c] = np.column_stack([one - other, one, other, slope])
            for strip in np.unique(place):
                inside = np.flatnonzero(place == strip)
                here = terms[inside]
                total = found.setdefault(int(strip), np.zeros((n, 1 + spec["draws"])))
                total[:, 1:] += here[:, :, 0].T @ V[inside]
                shared[int(strip)] = shared.get(int(strip), 0.0) + here.sum(axis=0)
        for strip, total in found.items():
            sums = shared[strip]
            total[:, 0] = sums[:, 0]
            treated, controls, scores = spec["drawn"][:, :, 0].T, spec["drawn"][:, :, 1].T, spec["drawn"][:, :, 2:]
            total[:, 1:] += sums[:, 2:3] * controls - sums[:, 1:2] * treated + np.einsum("cj,bcj->cb", sums[:, 3:], scores)
        keys = [strip * n + c for strip in found for c in range(n)]
        values = [row for matrix in found.values() for row in matrix]
        yield pa.RecordBatch.from_arrays(
            [pa.array(["strip"] * len(keys), pa.string()), pa.array(keys, pa.int32()), pa.array(values, pa.list_(pa.float64()))],
            names=["kind", "i", "values"],
        )

    return run


def strip_squares(spec: dict):
    """mapInArrow function: squared moments added over the points of strips, rows sorted by strip and point.

    A strip starts from the moments of all lower strips; a point counts once its last unit is in.
    """

    def run(batches):
        total = np.zeros(1 + spec["draws"])
        strip, point, weight, held = None, None, 0.0, None
        for batch in _parts(batches, spec["rows"]):
            columns = (*unpack(batch, spec["k"], spec["months"]), batch.column("place").to_numpy(), batch.column("weight").to_numpy())
            for here in np.unique(columns[4]):
                hashes, cohort, X, Y, _, weights = (c[columns[4] == here] for c in columns)
                x = X[:, 1]
                if held is not None and (here != strip or x[0] != point):
                    total += weight * (held**2).sum(axis=0)
                    weight = 0.0
                if here != strip:
                    held = spec["below"][here].copy()
                run_of = np.cumsum(np.diff(x, prepend=x[0]) != 0)
                of_point = np.bincount(run_of, weights)
                of_point[0] += weight
                for c, (rows, terms) in enumerate(moment_columns(spec, 0, len(spec["cells"]), hashes, cohort, X, Y)):
                    moments = held[c] + np.cumsum(_added_by(run_of[rows], terms, len(of_point)), axis=0)
                    total += of_point[:-1] @ moments[:-1] ** 2
                    held[c] = moments[-1]
                strip, point, weight = here, x[-1], of_point[-1]
        if held is not None:
            total += weight * (held**2).sum(axis=0)
        yield sums_batch({"sum": total[None, :]})

    return run
