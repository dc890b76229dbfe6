"""Covariate-adjusted effects from aggregates.

Regressions need only Gram sums by cohort and month; the propensity model needs
a few rounds of such sums. Each round is one Spark aggregate over the rows, and
what comes back has the size of the design, not of the data.

Every sum is over ``x = (1, x1, .., xk)``: ``G = sum(w * x x')`` and
``V = sum(w * x * v)``.

Three layouts of the rows:

* ``balanced``: value = outcome, slot = month. Differences are differences of
  sums, and cohorts with the same controls share one propensity model.
* ``pairs``: value = difference of a unit seen in both months, slot = pair.
* ``months``: value = outcome, slot = month, each row counts (repeated cross
  sections); regressions are fitted per month and side.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.effects.design import Cell, Design
from panelwright.operators.panel import by_unit
from panelwright.session import materialise
from panelwright.sources.scan import literal_table

METHODS = ("dr", "reg", "ipw")
MAX_ROUNDS = 25
MAX_MEMBERS = 500_000
RESULT = (
    "group INT, time INT, base INT, post BOOLEAN, att DOUBLE, "
    "n_treated BIGINT, n_control BIGINT, note STRING"
)


class NotIdentified(ValueError):
    """A matrix of a cell is singular or its propensity model has no optimum."""


@dataclass
class Sums:
    """Gram sums of a set of rows."""

    G: np.ndarray
    V: np.ndarray

    @classmethod
    def zero(cls, p: int) -> Sums:
        return cls(np.zeros((p, p)), np.zeros(p))

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.G + other.G, self.V + other.V)

    @property
    def n(self) -> float:
        return float(self.G[0, 0])

    @property
    def mean_x(self) -> np.ndarray:
        return self.G[0] / self.G[0, 0]

    def mean_residual(self, beta: np.ndarray) -> float:
        return float(self.V[0] - self.G[0] @ beta) / self.n


@dataclass
class Part:
    """What the influence of a row on one cell needs, per slot.

    ``beta`` is the regression of the controls and ``level1``, ``level0`` the mean
    residuals of treated and controls, over ``n1`` rows and weight ``w0``. The
    ``u_`` vectors carry the effect of estimating beta and the propensity model.
    The remaining fields belong to repeated cross sections: ``beta1`` is the
    regression of the treated, ``gap_level`` and ``gap_all`` the mean predicted
    gaps over the treated of this slot and of both slots.
    """

    slot: int
    sign: float
    beta: np.ndarray
    level1: float
    n1: float
    level0: float
    w0: float
    u_beta: np.ndarray
    u_gamma: np.ndarray
    beta1: np.ndarray | None = None
    u_beta1: np.ndarray | None = None
    gap_level: float = 0.0
    gap_all: float = 0.0
    n1_all: float = 0.0


@dataclass
class Result:
    """One cell: its effect or the reason there is none, and its influence parts."""

    cell: Cell
    n_treated: int = 0
    n_control: int = 0
    att: float | None = None
    note: str | None = None
    problem: int | None = None
    parts: list[Part] = field(default_factory=list)


def tidy_rows(
    panel: DataFrame, y: str, unit: str, time: str, group: str, covariates: Iterable[str], design: Design
) -> DataFrame:
    """unit, time, cohort, y, x1..xk with incomplete rows and baseless cohorts left out."""
    xs = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates, 1)]
    return (
        panel.where(design.has_base(group))
        .select(
            F.col(unit).alias("unit"),
            F.col(time).cast("int").alias("time"),
            design.cohort_of(group).alias("cohort"),
            F.col(y).cast("double").alias("y"),
            *xs,
        )
        .dropna(subset=["time", "y", *[f"x{i}" for i in range(1, len(xs) + 1)]])
    )


@dataclass
class Shape:
    """What a survey finds: whether every unit has each month once, how many rows repeat a
    unit-month (a NULL unit counts as one unit), and in how many units cohort or covariates change."""

    balanced: bool
    repeats: int
    changing: int

    def require_units(self):
        """Refuse rows that cannot be gathered to one row per unit."""
        if self.repeats:
            raise ValueError(f"{self.repeats} rows repeat a unit and month; combine them first")
        if self.changing:
            raise ValueError(f"cohort or covariates change over time in {self.changing} units; take one value per unit")


def survey(rows: DataFrame, design: Design, k: int) -> tuple[DataFrame, Shape]:
    """Rows with centred and scaled covariates, and the shape of the panel.

    Scaling changes no effect and conditions the sums better. The months of a unit are gathered
    to a set (bounded by the calendar), so that a repeated one cannot make up for a missing one.
    """
    names = [f"x{i}" for i in range(1, k + 1)]
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.stddev(c).alias(f"s_{c}") for c in names],
    ).first()
    scaled = {}
    for c in names:
        centre, scale = facts[f"m_{c}"] or 0.0, facts[f"s_{c}"] or 1.0
        scaled[c] = (F.col(c) - F.lit(centre)) / F.lit(scale)
    changing = F.min("cohort") < F.max("cohort")
    for c in names:
        changing = changing | (F.min(c) < F.max(c))
    per_unit = rows.groupBy("unit").agg(
        F.size(F.collect_set("time")).alias("months"), changing.alias("changing")
    )
    units = per_unit.agg(
        F.min("months").alias("least"),
        F.coalesce(F.sum("months"), F.lit(0)).alias("months"),
        F.count_if("changing").alias("changing"),
    ).first()
    repeats = facts["n"] - units["months"]
    balanced = repeats == 0 and units["least"] == len(design.periods)
    return (rows.withColumns(scaled) if scaled else rows), Shape(balanced, repeats, units["changing"])


def _x(i: int) -> Column:
    return F.lit(1.0) if i == 0 else F.col(f"x{i}")


def gram_sums(df: DataFrame, keys: list[str], p: int, weight: Column | None = None) -> dict:
    """Collect G and V per key: one aggregate job, one small row per key."""
    w = F.lit(1.0) if weight is None else F.col("_w")
    if weight is not None:
        df = df.withColumn("_w", weight)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    aggregates = [F.sum(w * _x(i) * _x(j)).alias(f"g_{i}_{j}") for i, j in pairs]
    aggregates += [F.sum(w * _x(i) * F.col("v")).alias(f"v_{i}") for i in range(p)]
    out = {}
    for row in df.groupBy(*keys).agg(*aggregates).collect():
        sums = Sums.zero(p)
        for i, j in pairs:
            sums.G[i, j] = sums.G[j, i] = row[f"g_{i}_{j}"]
        sums.V[:] = [row[f"v_{i}"] for i in range(p)]
        out[tuple(row[k] for k in keys)] = sums
    return out


def solve(matrix: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    if not np.isfinite(matrix).all() or np.linalg.cond(matrix) > 1e12:
        raise NotIdentified("singular covariate matrix")
    return np.linalg.solve(matrix, rhs)


def pair_rows(rows: DataFrame, design: Design, k: int) -> DataFrame:
    """One row per unit and difference, for units seen in both of its months."""
    slots = F.array(
        *[
            F.struct(F.lit(s).alias("slot"), F.lit(t).alias("_t"), F.lit(b).alias("_b"))
            for s, (t, b) in enumerate(design.pairs())
        ]
    )
    names = [f"x{i}" for i in range(1, k + 1)]
    per_unit = by_unit(rows, "unit").groupBy("unit").agg(
        F.min("cohort").alias("cohort"),
        *[F.min(c).alias(c) for c in names],
        F.map_from_entries(F.collect_list(F.struct("time", "y"))).alias("_y"),
    )
    spread = per_unit.select("unit", "cohort", *names, "_y", F.inline(slots))
    value = F.try_element_at("_y", F.col("_t")) - F.try_element_at("_y", F.col("_b"))
    return spread.select("unit", "cohort", *names, "slot", value.alias("v")).where(
        F.col("v").isNotNull()
    )


@dataclass
class Fit:
    """All cells of a design with their effects and influence parts."""

    design: Design
    layout: str
    method: str
    k: int
    rows: DataFrame
    results: list[Result]
    gammas: dict[int, np.ndarray]
    hessians: dict[int, np.ndarray]
    problems: list[tuple[int, tuple[int, ...], tuple[int, ...]]]
    shape: Shape

    def table(self, spark: SparkSession) -> DataFrame:
        data = [
            (r.cell.group, r.cell.time, r.cell.base, r.cell.post, r.att, r.n_treated, r.n_control, r.note)
            for r in self.results
        ]
        return literal_table(spark, data, RESULT)


def fit(rows: DataFrame, design: Design, k: int, method="dr", panel_mode="auto") -> Fit:
    """Estimate every cell of a design from tidy rows.

    Where differences within units are taken, repeated unit-months, and cohorts or covariates
    that change over time, are refused; cross sections use every row with its own covariates.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    rows, shape = survey(materialise(rows), design, k)
    balanced = shape.balanced
    if panel_mode not in ("auto", "panel", "cross_section"):
        raise ValueError(f"unknown panel mode {panel_mode!r}")
    if panel_mode == "cross_section" or (panel_mode == "auto" and not balanced):
        layout = "months"
    else:
        layout = "balanced" if balanced else "pairs"
        shape.require_units()

    p = k + 1
    if layout == "pairs":
        data = materialise(pair_rows(rows, design, k))
    else:
        data = rows.withColumnRenamed("time", "slot").withColumnRenamed("y", "v")
    sums = gram_sums(data, ["cohort", "slot"], p)

    problems, problem_of = _problems(design, layout)
    gammas, hessians, weighted = {}, {}, {}
    if method != "reg":
        gammas, hessians = _propensity(data, design, layout, problems, sums, p)
        weighted = _control_weights(data, layout, problems, gammas, p)

    solver = _month_cell if layout == "months" else _difference_cell
    results = []
    for cell in design.cells():
        problem = problem_of[cell]
        result = Result(cell, problem=problem)
        results.append(result)
        try:
            solver(result, design, layout, method, sums, hessians.get(problem), weighted, p)
        except NotIdentified as reason:
            result.att, result.note, result.parts = None, str(reason), []
    return Fit(design, layout, method, k, rows, results, gammas, hessians, problems, shape)


def _problems(design: Design, layout: str):
    """Propensity models: treated cohort, control cohorts, and the slots to fit on."""
    cells = design.cells()
    pair_slot = {pair: s for s, pair in enumerate(design.pairs())}
    problems, ids, problem_of = [], {}, {}
    for cell in cells:
        controls = design.controls(cell)
        if layout == "balanced":
            slots: tuple[int, ...] = (design.periods[0],)
        elif layout == "pairs":
            slots = (pair_slot[cell.time, cell.base],)
        else:
            slots = tuple(sorted({cell.time, cell.base}))
        key = (cell.group, controls, slots)
        if key not in ids:
            ids[key] = len(problems)
            problems.append(key)
        problem_of[cell] = ids[key]
    if sum((len(c) + 1) * len(s) for _, c, s in problems) > MAX_MEMBERS:
        raise ValueError("too many cohorts and months for covariate adjustment")
    return problems, problem_of


def _scored(data: DataFrame, problems, gammas, controls_only: bool, by_slot: bool, p: int):
    """Rows paired with the models they take part in, and their linear score.

    The table of models has one row per model, cohort and slot with the current
    coefficients: its size is bounded by the design (see MAX_MEMBERS), so it is
    broadcast and the rows are not shuffled.
    """
    members = []
    for problem, gamma in gammas.items():
        g, controls, slots = problems[problem]
        cohorts = [(c, 0) for c in controls] + ([] if controls_only else [(g, 1)])
        for cohort, d in cohorts:
            for slot in slots if by_slot else (0,):
                members.append((cohort, slot, problem, d, *map(float, gamma)))
    schema = "cohort INT, slot INT, problem INT, d INT, "
    schema += ", ".join(f"b{i} DOUBLE" for i in range(p))
    table = literal_table(data.sparkSession, members, schema)
    keys = ["cohort", "slot"] if by_slot else ["cohort"]
    eta = F.lit(0.0)
    for i in range(p):
        eta = eta + _x(i) * F.col(f"b{i}")
    table = F.broadcast(table if by_slot else table.drop("slot"))
    return data.join(table, keys).withColumn("eta", eta)


def _propensity(data, design, layout, problems, sums, p):
    """Logit models by Newton steps, all models in the same aggregate job."""
    fit_rows = data
    by_slot = layout != "balanced"
    if layout == "balanced":
        fit_rows = data.where(F.col("slot") == design.periods[0])

    gammas, hessians = {}, {}
    active = {}
    for problem, (g, controls, slots) in enumerate(problems):
        treated, control = Sums.zero(p), Sums.zero(p)
        for s in slots:
            treated += sums.get((g, s), Sums.zero(p))
            for c in controls:
                control += sums.get((c, s), Sums.zero(p))
        if not (treated.n and control.n):
            continue
        # Started at the raw share, the first Newton step needs no pass over the rows.
        share = treated.n / (treated.n + control.n)
        start = np.zeros(p)
        start[0] = np.log(share / (1 - share))
        H = share * (1 - share) * (treated.G + control.G)
        score = treated.G[0] - share * (treated.G[0] + control.G[0])
        try:
            active[problem] = start + solve(H, score)
        except NotIdentified:
            continue
        if p == 1:
            gammas[problem], hessians[problem] = active.pop(problem), H

    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(MAX_ROUNDS):
        if not active:
            break
        scored = _scored(fit_rows, problems, active, False, by_slot, p)
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("eta")))
        scored = scored.withColumn("_p", chance)
        w = F.col("_p") * (F.lit(1.0) - F.col("_p"))
        found = scored.groupBy("problem").agg(
            *[F.sum(w * _x(i) * _x(j)).alias(f"h_{i}_{j}") for i, j in pairs],
            *[F.sum((F.col("d") - F.col("_p")) * _x(i)).alias(f"s_{i}") for i in range(p)],
        )
        for row in found.collect():
            problem = row["problem"]
            H = np.zeros((p, p))
            for i, j in pairs:
                H[i, j] = H[j, i] = row[f"h_{i}_{j}"]
            score = np.array([row[f"s_{i}"] for i in range(p)])
            try:
                step = solve(H, score)
            except NotIdentified:
                del active[problem]
                continue
            active[problem] = active[problem] + step
            if np.abs(step).max() < 1e-9:
                gammas[problem], hessians[problem] = active.pop(problem), H
    return gammas, hessians


def _control_weights(data, layout, problems, gammas, p):
    """Sums of the controls weighted with the odds of treatment."""
    if not gammas:
        return {}
    scored = _scored(data, problems, gammas, True, layout != "balanced", p)
    return gram_sums(scored, ["problem", "slot"], p, weight=F.exp("eta"))


def _side(sums, design, cell, slot, p):
    treated = sums.get((cell.group, slot), Sums.zero(p))
    control = Sums.zero(p)
    for c in design.controls(cell):
        control += sums.get((c, slot), Sums.zero(p))
    return treated, control


def _require(result: Result, treated: Sums, control: Sums):
    result.n_treated, result.n_control = round(treated.n), round(control.n)
    if not treated.n:
        raise NotIdentified("no treated units")
    if not control.n:
        raise NotIdentified("no control units")


def _difference_cell(result, design, layout, method, sums, hessian, weighted, p):
    """Effect on differences: units present in both months."""
    cell, problem = result.cell, result.problem
    if layout == "pairs":
        slot = design.pairs().index((cell.time, cell.base))
        treated, control = _side(sums, design, cell, slot, p)
        odds = weighted.get((problem, slot))
    else:
        slot = cell.time
        t1, t0 = _side(sums, design, cell, cell.time, p)
        b1, b0 = _side(sums, design, cell, cell.base, p)
        treated, control = Sums(t1.G, t1.V - b1.V), Sums(t0.G, t0.V - b0.V)
        odds = weighted.get((problem, cell.time))
        if odds is not None:
            odds = Sums(odds.G, odds.V - weighted[problem, cell.base].V)
    _require(result, treated, control)

    beta = np.zeros(p) if method == "ipw" else solve(control.G, control.V)
    level1 = treated.mean_residual(beta)
    level0, w0 = 0.0, np.inf
    a_beta = -treated.mean_x
    u_gamma = np.zeros(p)
    if method != "reg":
        if odds is None or hessian is None:
            raise NotIdentified("propensity model not identified")
        level0, w0 = odds.mean_residual(beta), odds.n
        a_beta = odds.mean_x - treated.mean_x
        u_gamma = solve(hessian, -(odds.V - odds.G @ beta - level0 * odds.G[0]) / w0)
    u_beta = np.zeros(p) if method == "ipw" else solve(control.G, a_beta)
    result.att = float(level1 - level0)
    result.parts = [Part(slot, 1.0, beta, level1, treated.n, level0, w0, u_beta, u_gamma)]


def _month_cell(result, design, layout, method, sums, hessian, weighted, p):
    """Effect on repeated cross sections: each month and side on its own rows."""
    cell, problem = result.cell, result.problem
    sides = [(cell.time, 1.0), (cell.base, -1.0)]
    both = [_side(sums, design, cell, s, p) for s, _ in sides]
    for treated, control in both:
        _require(result, treated, control)
    result.n_treated, result.n_control = round(both[0][0].n), round(both[0][1].n)
    if cell.time == cell.base:
        result.att = 0.0
        return
    all_treated = both[0][0] + both[1][0]
    att, parts = 0.0, []
    for (slot, sign), (treated, control) in zip(sides, both, strict=True):
        zero = np.zeros(p)
        part = Part(slot, sign, zero, 0.0, treated.n, 0.0, np.inf, zero, zero)
        if method == "reg":
            part.beta = solve(control.G, control.V)
            part.level1 = treated.V[0] / treated.n
            part.gap_all = -float(all_treated.mean_x @ part.beta)
            part.n1_all = all_treated.n
            part.u_beta = solve(control.G, -all_treated.mean_x)
            part.beta1 = None
            effect = part.level1 + part.gap_all
        else:
            odds = weighted.get((problem, slot))
            if odds is None or hessian is None:
                raise NotIdentified("propensity model not identified")
            if method == "dr":
                part.beta = solve(control.G, control.V)
            part.level1 = treated.mean_residual(part.beta)
            part.level0, part.w0 = odds.mean_residual(part.beta), odds.n
            part.u_gamma = solve(
                hessian, -(odds.V - odds.G @ part.beta - part.level0 * odds.G[0]) / part.w0
            )
            effect = part.level1 - part.level0
            if method == "dr":
                part.beta1 = solve(treated.G, treated.V)
                gap = part.beta1 - part.beta
                part.gap_level = float(treated.mean_x @ gap)
                part.gap_all = float(all_treated.mean_x @ gap)
                part.n1_all = all_treated.n
                part.u_beta = solve(control.G, odds.mean_x - all_treated.mean_x)
                part.u_beta1 = solve(treated.G, all_treated.mean_x - treated.mean_x)
                effect += part.gap_all - part.gap_level
        att += sign * effect
        parts.append(part)
    result.att, result.parts = float(att), parts
