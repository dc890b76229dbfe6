"""Which cohort is compared with whom, and when.

A design is known from two short lists: the observed months and the months in
which cohorts are first treated. Both are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.scan import literal_table

# Stand-in for "first treated after everything we see".
NEVER = 2**31 - 1

MAX_CELLS = 100_000


@dataclass(frozen=True)
class Cell:
    """One group-time effect: cohort, month, base month and the control cut-off."""

    group: int
    time: int
    base: int
    threshold: int

    @property
    def post(self) -> bool:
        return self.time >= self.group


@dataclass(frozen=True)
class Design:
    """Months, cohorts and comparison rules of one estimation.

    ``control="notyettreated"`` compares with units first treated after both the
    month and its base month; ``"nevertreated"`` with untreated units only.
    ``base="varying"`` takes the previous month before treatment, ``"universal"``
    always the last month before treatment.
    """

    periods: tuple[int, ...]
    cohorts: tuple[int, ...]
    control: str = "notyettreated"
    base: str = "varying"

    @classmethod
    def of(cls, periods: Iterable[int], cohorts: Iterable[int], control="notyettreated", base="varying"):
        if control not in ("notyettreated", "nevertreated"):
            raise ValueError(f"unknown control group {control!r}")
        if base not in ("varying", "universal"):
            raise ValueError(f"unknown base period {base!r}")
        months = tuple(sorted(set(periods)))
        first, last = months[0], months[-1]
        treated = tuple(sorted({g for g in cohorts if g and first < g <= last}))
        return cls(months, treated, control, base)

    @classmethod
    def discover(cls, panel: DataFrame, time: str, group: str, control="notyettreated", base="varying"):
        """Read months and cohorts off the panel: one job, one row per pair of them."""
        pairs = panel.select(F.col(time).alias("t"), F.col(group).alias("g")).distinct()
        found = pairs.limit(MAX_CELLS + 1).collect()
        if len(found) > MAX_CELLS:
            raise ValueError("too many cohorts and periods; use coarser periods")
        months = [r["t"] for r in found if r["t"] is not None]
        return cls.of(months, [r["g"] for r in found], control, base)

    @property
    def last_months(self) -> dict[int, int]:
        """Last observed month before treatment, per cohort."""
        return {g: max(p for p in self.periods if p < g) for g in self.cohorts}

    def cells(self) -> list[Cell]:
        if len(self.periods) * len(self.cohorts) > MAX_CELLS:
            raise ValueError("too many cohort-month cells; use coarser periods")
        before = dict(zip(self.periods[1:], self.periods[:-1], strict=True))
        out = []
        for g, last in self.last_months.items():
            for t in self.periods:
                base = last if (t >= g or self.base == "universal") else before.get(t)
                if base is not None:
                    out.append(Cell(g, t, base, max(t, base)))
        return out

    def is_control(self, cell: Cell, cohort: int) -> bool:
        if cohort == cell.group:
            return False
        if self.control == "nevertreated":
            return cohort == NEVER
        return cohort > cell.threshold

    def controls(self, cell: Cell) -> tuple[int, ...]:
        return tuple(c for c in (*self.cohorts, NEVER) if self.is_control(cell, c))

    def pairs(self) -> list[tuple[int, int]]:
        """The distinct (month, base month) differences in use."""
        return sorted({(c.time, c.base) for c in self.cells()})

    def cell_table(self, spark: SparkSession) -> DataFrame:
        """The cells as a table, one row per cohort and month."""
        rows = [(c.group, c.time, c.base, c.threshold, c.post) for c in self.cells()]
        return literal_table(spark, 
            rows, "group INT, time INT, base INT, threshold INT, post BOOLEAN"
        )

    def cohort_of(self, group) -> Column:
        """A group column with 0, NULL and after-study dates mapped to NEVER."""
        g = F.col(group) if isinstance(group, str) else group
        late = g.isNull() | (g == 0) | (g > self.periods[-1])
        return F.when(late, F.lit(NEVER)).otherwise(g).cast("int")

    def has_base(self, group) -> Column:
        """False for cohorts already treated in the first month: no base month."""
        g = F.col(group) if isinstance(group, str) else group
        return g.isNull() | (g == 0) | (g > self.periods[0])
