"""Group-time average effects."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.effects.design import NEVER, Design
from panelwright.effects.fit import fit, tidy_rows
from panelwright.operators.panel import by_unit


def dropped_rows(panel: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows in all, and rows an estimation drops because a value is missing."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(~complete, 1)).alias("n_dropped"),
    )


def left_out(
    panel: DataFrame,
    y: str,
    unit: str,
    time: str,
    group: str,
    covariates: Iterable[str] = (),
    design: Design | None = None,
) -> DataFrame:
    """Rows and units that an estimation leaves out, one row per reason, zero where there are none.

    Cohorts treated in the first month have no base month; the other rows are left out if a value
    is missing. A unit counts under each reason that takes a row of it.
    """
    design = design or Design.discover(panel, time, group)
    complete = F.lit(True)
    for c in (time, y, *covariates):
        complete = complete & F.col(c).isNotNull()
    early = ~design.has_base(group)
    reasons = {"treated in the first month": early, "missing value": ~early & ~complete}
    counted = panel.agg(
        *[F.count_if(where).alias(f"rows{i}") for i, where in enumerate(reasons.values())],
        *[F.count_distinct(F.when(where, F.col(unit))).alias(f"units{i}") for i, where in enumerate(reasons.values())],
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("reason"), F.col(f"rows{i}").alias("n_rows"), F.col(f"units{i}").alias("n_units"))
        for i, name in enumerate(reasons)
    ])
    return counted.select(F.inline(rows))


def att_gt(
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
) -> DataFrame:
    """Effect of treatment per cohort and month.

    ``time`` and ``group`` are month numbers; a group of 0 or NULL, or one after
    the last month, is never treated, and cohorts treated in the first month are
    left out. Without covariates the result is lazy and needs a single pass:
    cohort-by-month sums, then a join among those few rows. With covariates
    (constant within a unit) ``method`` is ``dr``, ``reg`` or ``ipw``.

    ``panel_mode="cross_section"`` uses every row; ``"panel"`` uses the units seen
    in both months of a difference; ``"auto"`` takes the first for an unbalanced
    panel. The two agree when no row is missing.
    """
    design = design or Design.discover(panel, time, group, control, base)
    covariates = list(covariates)
    if covariates:
        rows = tidy_rows(panel, y, unit, time, group, covariates, design)
        return fit(rows, design, len(covariates), method, panel_mode).table(panel.sparkSession)
    rows = tidy_rows(panel, y, unit, time, group, [], design)
    if panel_mode == "panel":
        sums = _pair_sums(rows, design)
        return _effects_from_pairs(sums, design)
    return _effects_from_months(rows, design)


def _controls_of(design: Design, cohort, cell_group, threshold):
    other = cohort != cell_group
    if design.control == "nevertreated":
        return other & (cohort == NEVER)
    return other & (cohort > threshold)


def _effects_from_months(rows: DataFrame, design: Design) -> DataFrame:
    """Cell means of treated and controls in the month and in its base month."""
    spark = rows.sparkSession
    sums = rows.groupBy("cohort", "time").agg(
        F.count("y").alias("n"), F.sum("y").alias("s")
    )
    cells = F.broadcast(design.cell_table(spark))
    # One row per cell and side (month or base month), keyed by the month it reads.
    sides = cells.withColumn("_side", F.explode(F.array(F.lit("t"), F.lit("b")))).withColumn(
        "_month", F.when(F.col("_side") == "t", F.col("time")).otherwise(F.col("base"))
    )
    joined = sums.withColumnRenamed("time", "_month").join(F.broadcast(sides), "_month")
    treated = F.col("cohort") == F.col("group")
    control = _controls_of(design, F.col("cohort"), F.col("group"), F.col("threshold"))

    def total(value, who, side):
        return F.sum(F.when(who & (F.col("_side") == side), F.col(value)))

    wide = joined.where(treated | control).groupBy("group", "time", "base", "post").agg(
        *[
            total(v, who, side).alias(f"{v}_{name}_{side}")
            for v in ("n", "s")
            for name, who in (("1", treated), ("0", control))
            for side in ("t", "b")
        ]
    )

    def mean(name, side):
        return F.try_divide(F.col(f"s_{name}_{side}"), F.col(f"n_{name}_{side}"))

    att = (mean("1", "t") - mean("1", "b")) - (mean("0", "t") - mean("0", "b"))
    return _finish(
        cells, wide.withColumns({"att": att, "n_treated": F.col("n_1_t"), "n_control": F.col("n_0_t")})
    )


def _pair_sums(rows: DataFrame, design: Design) -> DataFrame:
    """Moments of the two values of every difference, by cohort.

    The months of a unit are gathered to one map (bounded by the calendar) and
    spread to the differences in use, so the panel meets itself without a join.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(t).alias("time"), F.lit(b).alias("base"))
            for t, b in design.pairs()
        ]
    )
    per_unit = by_unit(rows, "unit").groupBy("unit").agg(
        F.min("cohort").alias("cohort"),
        F.map_from_entries(F.collect_list(F.struct("time", "y"))).alias("_y"),
    )
    spread = per_unit.select("cohort", "_y", F.inline(pairs))
    both = spread.select(
        "cohort",
        "time",
        "base",
        F.try_element_at("_y", F.col("time")).alias("a"),
        F.try_element_at("_y", F.col("base")).alias("b"),
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    d = F.col("a") - F.col("b")
    return both.groupBy("cohort", "time", "base").agg(
        F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("ss")
    )


def _effects_from_pairs(sums: DataFrame, design: Design) -> DataFrame:
    """Mean differences, and their analytic errors, from the pair moments."""
    cells = F.broadcast(design.cell_table(sums.sparkSession))
    joined = sums.join(cells, ["time", "base"])
    treated = F.col("cohort") == F.col("group")
    control = _controls_of(design, F.col("cohort"), F.col("group"), F.col("threshold"))
    wide = joined.where(treated | control).groupBy("group", "time", "base", "post").agg(
        *[
            F.sum(F.when(who, F.col(v))).alias(f"{v}_{name}")
            for v in ("n", "s", "ss")
            for name, who in (("1", treated), ("0", control))
        ]
    )

    def mean(name):
        return F.try_divide(F.col(f"s_{name}"), F.col(f"n_{name}"))

    def error(name):
        spread = F.try_divide(F.col(f"ss_{name}"), F.col(f"n_{name}")) - mean(name) * mean(name)
        return F.try_divide(F.greatest(spread, F.lit(0.0)), F.col(f"n_{name}"))

    return _finish(
        cells,
        wide.withColumns(
            {
                "att": mean("1") - mean("0"),
                "std_error": F.sqrt(error("1") + error("0")),
                "n_treated": F.col("n_1"),
                "n_control": F.col("n_0"),
            }
        ),
        extra=["std_error"],
    )


def _finish(cells: DataFrame, found: DataFrame, extra=()) -> DataFrame:
    """All cells of the design, with a note where no effect can be computed."""
    keys = ["group", "time", "base", "post"]
    out = cells.select(*keys).join(found, keys, "left")
    none = F.lit(0).cast("long")
    n1, n0 = F.coalesce("n_treated", none), F.coalesce("n_control", none)
    note = (
        F.when(n1 == 0, "no treated units")
        .when(n0 == 0, "no control units")
        .when(F.col("att").isNull(), "no rows in the base month")
    )
    return out.select(
        *keys, "att", *extra, n1.alias("n_treated"), n0.alias("n_control"), note.alias("note")
    )


def att_std_errors(
    panel: DataFrame,
    y: str,
    unit: str,
    time: str,
    group: str,
    control="notyettreated",
    base="varying",
    design: Design | None = None,
) -> DataFrame:
    """Effects without covariates and their analytic standard errors.

    The error is the root of the mean squared influence value, which for a
    difference of means needs only the second moment of each difference.
    """
    design = design or Design.discover(panel, time, group, control, base)
    rows = tidy_rows(panel, y, unit, time, group, [], design)
    return _effects_from_pairs(_pair_sums(rows, design), design)
