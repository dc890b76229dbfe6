"""Summary tables: treated months, profiles, sub-populations, descriptive statistics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.effects.numbers import chi2_tails, f_tails
from panelwright.functions import constants as K
from panelwright.functions.scalars import map_values
from panelwright.operators.grouping import profile, with_total
from panelwright.operators.quantiles import exact_quantiles
from panelwright.operators.reshape import pivot_wider

PROFILE_MEANS = {
    "violation_rate": "n_violations_per_1k_units",
    "evict_rate": "evict_rate_17",
    "rs_rate": "rs_rate_17",
    "pct_pov": "pct_pov_17",
    "hh_inc": "med_hh_inc_rou_2020_adj",
    "rent_burden": "med_rent_burden",
    "pct_college_grads": "pct_college_deg_rou",
    "pct_wh": "pct_wh_rou",
    "pct_bl": "pct_bl_rou",
    "pct_asn": "pct_asn_rou",
    "pct_ltx": "pct_ltx_rou",
}


def cohort_profile(panel: DataFrame, by=("cohort",), means: Mapping[str, str] = PROFILE_MEANS, **others):
    """Means of all measures per cohort in one pass; ``by=()`` for the whole panel."""
    return profile(panel, by, means, **others)


def cohort_months(
    panel: DataFrame,
    unit="zip",
    period="inspection_yr_mo",
    labels: Mapping[int, str] = K.COHORT_MONTH_LABELS,
    total=True,
) -> DataFrame:
    """Months observed before (``0``) and after (``1``) treatment, and units, per cohort.

    The totals row sums the units only; sums of months would mean nothing.
    """
    counted = panel.groupBy("cohort", "treated").agg(
        F.count_distinct(period).alias("n_months_treated"),
        F.count_distinct(unit).alias("n_units"),
    )
    wide = pivot_wider(counted, ["cohort", "n_units"], "treated", "n_months_treated", [0, 1])
    wide = wide.fillna(0).withColumn("rtc_date", map_values("cohort", labels))
    if not total:
        return wide
    return with_total(wide, ["cohort", "rtc_date", "0", "1"], ["n_units"])


def units_by(panel: DataFrame, key: str, unit: str, name="n_units", total=True) -> DataFrame:
    """Distinct units per key with a total of the displayed counts."""
    counts = panel.groupBy(key).agg(F.count_distinct(unit).alias(name))
    return with_total(counts, [key], [name]) if total else counts


def _long(df: DataFrame, variables: Iterable[str], ids: Iterable[str]) -> DataFrame:
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in variables])
    return cast.unpivot(list(ids), list(variables), "variable", "value")


def sumtable(df: DataFrame, variables: Iterable[str], by: str | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of every variable.

    All variables go through one unpivoted aggregate; ``by`` adds groups.
    """
    ids = [by] if by else []
    moments = {
        "n": F.count("value"),
        "mean": F.avg("value"),
        "sd": F.stddev_samp("value"),
        "min": F.min("value"),
        "max": F.max("value"),
    }
    quartiles = {"pctile_25": 0.25, "pctile_75": 0.75}
    keys = [*ids, "variable"]
    found = exact_quantiles(_long(df, variables, ids), keys, "value", quartiles, also=moments)
    return found.select(*keys, "n", "mean", "sd", "min", *quartiles, "max")


def group_test(df: DataFrame, variables: Iterable[str], by: str) -> DataFrame:
    """One-way analysis of variance of every variable over the groups.

    The statistic comes from counts, means and variances per group; the p-value
    is computed on the one row per variable that remains.
    """
    groups = (
        _long(df, variables, [by])
        .where(F.col("value").isNotNull() & F.col(by).isNotNull())
        .groupBy("variable", by)
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("m"),
            F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"),
        )
    )
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    # The window runs over finished groups; distances from the grand mean keep the digits that a
    # difference of two large sums would lose.
    whole = Window.partitionBy("variable")
    groups = groups.withColumn("_grand", F.sum(n * m).over(whole) / F.sum(n).over(whole))
    sums = groups.groupBy("variable").agg(
        F.sum(n).alias("total"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(n * (m - F.col("_grand")) * (m - F.col("_grand"))).alias("_between"),
        F.sum((n - 1) * v).alias("_within"),
    )
    out = sums.select(
        "variable",
        (F.col("groups") - 1).alias("df_between"),
        (F.col("total") - F.col("groups")).alias("df_within"),
        F.try_divide(
            F.try_divide(F.col("_between"), F.col("groups") - 1),
            F.try_divide(F.col("_within"), F.col("total") - F.col("groups")),
        ).alias("f_statistic"),
    )
    return out.withColumn(
        "p_value",
        F.pandas_udf(f_tails, "double")(
            "f_statistic", F.col("df_between").cast("double"), F.col("df_within").cast("double")
        ),
    )


def category_test(df: DataFrame, variable: str, by: str) -> DataFrame:
    """Chi-square test of independence of a category and the groups."""
    pairs = df.select(F.col(variable).alias("_level"), F.col(by).alias("_group")).dropna()
    counts = pairs.groupBy("_level", "_group").agg(F.count(F.lit(1)).alias("n"))
    # As doubles: the square of a count above three billion does not fit a long.
    n = F.col("n").cast("double")
    rows = counts.groupBy("_level").agg(F.sum("n").alias("_row"))
    cols = counts.groupBy("_group").agg(F.sum("n").alias("_col"))
    # Sum over cells of n^2 / (row * column): absent cells add nothing to it.
    ratio = n * n / (F.col("_row").cast("double") * F.col("_col"))
    out = counts.join(rows, "_level").join(cols, "_group").agg(
        F.sum("n").alias("total"),
        F.sum(ratio).alias("_sum"),
        F.count_distinct("_level").alias("_levels"),
        F.count_distinct("_group").alias("_groups"),
    )
    out = out.select(
        F.lit(variable).alias("variable"),
        (F.col("total") * (F.col("_sum") - 1)).alias("chi2"),
        ((F.col("_levels") - 1) * (F.col("_groups") - 1)).alias("df"),
    )
    return out.withColumn("p_value", F.pandas_udf(chi2_tails, "double")("chi2", F.col("df").cast("double")))


def category_shares(df: DataFrame, variable: str, by: str | None = None) -> DataFrame:
    """Counts and shares of the levels of a category, per group if given."""
    ids = [by] if by else []
    counts = df.groupBy(*ids, variable).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        total = df.agg(F.count(F.lit(1)).alias("_all")).scalar()
        return counts.withColumn("share", F.col("n") / total)
    # The window runs over finished counts: one row per level and group.
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
