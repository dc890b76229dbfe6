"""Standard errors, simultaneous bands and the pre-trend test."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.effects.aggregate import KINDS
from panelwright.effects.design import Design
from panelwright.effects.fit import Fit, fit, tidy_rows
from panelwright.effects.influence import cell_chunks, column_errors, covariance, mapped_chunk, unit_arrays
from panelwright.effects.numbers import chi2_tail, normal_quantile
from panelwright.session import materialise
from panelwright.sources.scan import literal_table

BANDS = (
    "kind STRING, group INT, time INT, level INT, estimate DOUBLE, std_error DOUBLE, "
    "crit DOUBLE, conf_low DOUBLE, conf_high DOUBLE, significant BOOLEAN"
)
WALD = "statistic DOUBLE, df INT, rank INT, p_value DOUBLE, note STRING"


def estimate(
    panel: DataFrame,
    y: str,
    unit: str,
    time: str,
    group: str,
    covariates: Iterable[str] = (),
    control="notyettreated",
    base="varying",
    method="dr",
    panel_mode="auto",
    design: Design | None = None,
    draws=1000,
    seed=1,
    alpha=0.05,
) -> Estimate:
    """Fit all cells and sum up their influence values; see :class:`Estimate`."""
    design = design or Design.discover(panel, time, group, control, base)
    covariates = list(covariates)
    rows = tidy_rows(panel, y, unit, time, group, covariates, design)
    # Without covariates all methods are the same difference of means.
    fitted = fit(rows, design, len(covariates), method if covariates else "reg", panel_mode)
    fitted.shape.require_units()
    units = materialise(unit_arrays(fitted, seed))
    sizes = {r["cohort"]: r["n"] for r in units.groupBy("cohort").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Estimate(fitted, units, sizes, draws, alpha, panel.sparkSession)


@dataclass
class Estimate:
    """Effects with the units that every standard error and band is computed from.

    All averages are linear in the influence of units on cells, cohort shares and a constant. Each
    band is one pass over the units, in which a task maps influence values to the rows of the
    band at once; nothing has the size of cells x cells.
    """

    fit: Fit
    units: DataFrame
    sizes: dict[int, int]
    draws: int
    alpha: float
    spark: SparkSession

    def att(self) -> DataFrame:
        return self.fit.table(self.spark)

    @property
    def n_units(self) -> float:
        return float(sum(self.sizes.values()))

    def size(self, group: int) -> float:
        return float(self.sizes.get(group, 0))

    def _usable(self):
        return [(c, r) for c, r in enumerate(self.fit.results) if r.att is not None]

    def _weighted(self, cells, groups=None, values=None):
        """Size-weighted mean of values as a linear map of the influence columns.

        ``cells`` holds, per item, a map over columns; sizes are estimated too,
        and their influence is part of the map.
        """
        maps = np.array(cells)
        pg = np.array([self.size(g) for g in groups]) / self.n_units
        total = pg.sum()
        weights = pg / total
        value = float(weights @ values)
        out = weights @ maps
        first = len(self.fit.results)
        slopes = (np.array(values) - value) / total
        for g, slope, share in zip(groups, slopes, pg, strict=True):
            out[first + self.fit.design.cohorts.index(g)] += slope / self.n_units
            out[-1] -= slope * share / self.n_units
        return value, out

    def _unit(self, c: int) -> np.ndarray:
        out = np.zeros(len(self.fit.results) + len(self.fit.design.cohorts) + 2)
        out[c] = 1.0
        return out

    def linear(self, kind: str):
        """(levels, values, maps) and the overall (value, map) of an average."""
        cells = self._usable()
        if kind == "simple":
            used = [(c, r) for c, r in cells if r.cell.post]
            overall = self._weighted(
                [self._unit(c) for c, _ in used],
                [r.cell.group for _, r in used],
                [r.att for _, r in used],
            )
            return [], [], [], overall
        key = {
            "group": lambda cell: cell.group,
            "dynamic": lambda cell: cell.time - cell.group,
            "calendar": lambda cell: cell.time,
        }[kind]
        by_level: dict[int, list] = {}
        for c, r in cells:
            if kind == "dynamic" or r.cell.post:
                by_level.setdefault(key(r.cell), []).append((c, r))
        levels, values, maps = sorted(by_level), [], []
        for level in levels:
            used = by_level[level]
            value, linear = self._weighted(
                [self._unit(c) for c, _ in used],
                [r.cell.group for _, r in used],
                [r.att for _, r in used],
            )
            values.append(value)
            maps.append(linear)
        if kind == "group":
            overall = self._weighted(maps, levels, values)
        else:
            at = [i for i, level in enumerate(levels) if kind == "calendar" or level >= 0]
            overall = (
                float(np.mean([values[i] for i in at])),
                np.mean([maps[i] for i in at], axis=0),
            )
        return levels, values, maps, overall

    def _errors(self, columns) -> tuple[np.ndarray, float]:
        """Standard error per column and the simultaneous critical value of the band."""
        found = column_errors(self.fit, self.units, columns, self.draws)
        pointwise = normal_quantile(1 - self.alpha / 2)
        if not self.draws:
            return np.sqrt(found["square"]), pointwise
        crit = float(np.quantile(found["max"], 1 - self.alpha, method="inverted_cdf")) if len(found["max"]) else 0.0
        return found["error"], crit if crit > 0 else pointwise

    def analytic_errors(self) -> dict[tuple[int, int], float]:
        cells = self._usable()
        squares = column_errors(self.fit, self.units, cell_chunks([c for c, _ in cells]), 0)["square"]
        return {(r.cell.group, r.cell.time): float(np.sqrt(x)) for (_, r), x in zip(cells, squares, strict=True)}

    def bands(self, kind: str = "cells") -> DataFrame:
        """Estimates with errors and a band that covers all rows at once.

        ``kind`` is ``cells`` or one of the averages, whose overall row has level
        NULL and a pointwise interval.
        """
        rows = []
        if kind == "cells":
            cells = self._usable()
            errors, crit = self._errors(cell_chunks([c for c, _ in cells])) if cells else ([], 0.0)
            for (_, r), se in zip(cells, errors, strict=True):
                rows.append(_row(kind, r.cell.group, r.cell.time, None, r.att, se, crit))
            return literal_table(self.spark, rows, BANDS)
        if kind not in KINDS:
            raise ValueError(f"kind must be 'cells' or one of {KINDS}, not {kind!r}")
        levels, values, maps, (value, overall) = self.linear(kind)
        every = list(range(len(self.fit.results)))
        columns = mapped_chunk(every, np.array(maps), 0, True) if levels else []
        errors, crit = self._errors([*columns, *mapped_chunk(every, np.array([overall]), len(levels), False)])
        for level, v, se in zip(levels, values, errors[: len(levels)], strict=True):
            rows.append(_row(kind, None, None, level, v, se, crit))
        crit = normal_quantile(1 - self.alpha / 2)
        rows.append(_row(kind, None, None, None, value, errors[-1], crit))
        return literal_table(self.spark, rows, BANDS)

    def pretest_wald(self) -> DataFrame:
        """Joint test that all effects before treatment are zero.

        With a singular covariance matrix there is no statistic, only its rank and the reason.
        """
        pre = [
            (c, r)
            for c, r in self._usable()
            if not r.cell.post and r.cell.time != r.cell.base
        ]
        if not pre:
            row = (None, 0, 0, None, "no cells before treatment")
            return literal_table(self.spark, [row], WALD)
        values = np.array([r.att for _, r in pre])
        statistic, rank = quadratic_form(covariance(self.fit, self.units, [c for c, _ in pre]), values)
        if rank < len(pre):
            row = (None, len(pre), rank, None, "singular covariance matrix")
        else:
            row = (statistic, len(pre), rank, chi2_tail(statistic, len(pre)), None)
        return literal_table(self.spark, [row], WALD)


def quadratic_form(V: np.ndarray, x: np.ndarray, tolerance=1e-11) -> tuple[float, int]:
    """x' V^-1 x and the rank of V, by a Cholesky factorisation that takes the largest pivot left.

    Rows are scaled to a unit diagonal first; pivots at or below the tolerance are zero.
    """
    spread = np.sqrt(np.maximum(V.diagonal(), 0))
    scale = np.where(spread > 1e-12, spread, np.inf)
    rest, x = V / np.outer(scale, scale), x / scale
    left, total, rank = np.arange(len(x)), 0.0, 0
    while len(left):
        at = left[np.argmax(rest[left, left])]
        pivot = rest[at, at]
        if pivot <= tolerance:
            break
        total += x[at] ** 2 / pivot
        left, rank = left[left != at], rank + 1
        column = rest[left, at] / pivot
        x[left] -= column * x[at]
        rest[np.ix_(left, left)] -= np.outer(column, rest[at, left])
    return float(total), rank


def _row(kind, group, time, level, value, error, crit):
    error = float(error)
    if not np.isfinite(error) or error <= 1e-12:
        return (kind, group, time, level, float(value), None, float(crit), None, None, None)
    low, high = value - crit * error, value + crit * error
    return (
        kind, group, time, level, float(value), error, float(crit),
        float(low), float(high), bool(low > 0 or high < 0),
    )
