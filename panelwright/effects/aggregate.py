"""Averages of group-time effects: simple, group, dynamic and calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("simple", "group", "dynamic", "calendar")


def cohort_sizes(panel: DataFrame, unit: str, group: str) -> DataFrame:
    """Units per cohort, the weights of all averages."""
    return panel.groupBy(F.col(group).alias("group")).agg(
        F.count_distinct(unit).alias("size")
    )


def aggregate_att(att: DataFrame, sizes: DataFrame, kind: str) -> DataFrame:
    """One row per level of the average plus the overall row (level NULL).

    Cells without an effect are left out. ``simple`` weights all cells after
    treatment by cohort size; ``group`` averages each cohort over its treated
    months, then over cohorts by size; ``dynamic`` averages by months since
    treatment, and overall over months from 0 on; ``calendar`` averages by month
    over the cohorts treated so far, and overall over those months.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    cells = (
        att.where(F.col("att").isNotNull())
        .join(sizes.select("group", "size"), "group")
        .withColumn("exposure", F.col("time") - F.col("group"))
    )
    weighted = F.try_divide(F.sum(F.col("att") * F.col("size")), F.sum("size"))
    level = {"simple": F.lit(None), "group": F.col("group"), "dynamic": F.col("exposure"), "calendar": F.col("time")}[kind]
    used = cells if kind == "dynamic" else cells.where("post")
    if kind == "simple":
        return used.agg(weighted.alias("att")).select(
            F.lit("simple").alias("kind"), F.lit(None).cast("int").alias("level"), "att"
        )
    by_level = used.groupBy(level.cast("int").alias("level")).agg(
        weighted.alias("att"), F.max("size").alias("size")
    )
    # Rows and overall row from one pass over the few level rows.
    overall = {
        "group": F.try_divide(F.sum(F.col("att") * F.col("size")), F.sum("size")),
        "dynamic": F.avg(F.when(F.col("level") >= 0, F.col("att"))),
        "calendar": F.avg("att"),
    }[kind]
    return by_level.groupingSets([["level"], []], "level").agg(
        F.grouping_id().alias("_all"), F.max("att").alias("_own"), overall.alias("_overall")
    ).select(
        F.lit(kind).alias("kind"),
        "level",
        F.when(F.col("_all") > 0, F.col("_overall")).otherwise(F.col("_own")).alias("att"),
    )
