"""Ranks and running sums over a whole table, without one task holding a group.

A window without partitions (or with one hot partition) sorts everything in one
task. Here rows are range-partitioned on the full order, which also splits a hot
group; each range gets a running value of its own, and the totals of the ranges
before it are added. The table of totals has one row per range and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut


def running_sum(
    df: DataFrame, group: list[str], order: list[str], value: str, out: str
) -> DataFrame:
    """Add `out`: the sum of `value` over the earlier rows of the group (exclusive).

    `group + order` must identify a row.
    """
    # Sampling the ranges reads the input once more, so it is written down first. The
    # range numbers hold for one shuffle only, so they are too, before two readers
    # (totals and rows) rely on them.
    ranged = cut(
        cut(df).repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    )
    earlier_ranges = (
        Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_rows = (
        Window.partitionBy("_range", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        ranged.groupBy("_range", *group)
        .agg(F.sum(value).alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(earlier_ranges), F.lit(0)))
        .drop("_total")
    )
    return (
        ranged.join(totals, ["_range", *group])
        .withColumn(
            out,
            (F.col("_base") + F.coalesce(F.sum(value).over(earlier_rows), F.lit(0))).cast("bigint"),
        )
        .drop("_range", "_base")
    )


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Add `out`: position in the order of the whole table, from 1."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_all", F.lit(0))
    ranked = running_sum(ones, ["_all"], order, "_one", out)
    return ranked.withColumn(out, F.col(out) + 1).drop("_one", "_all")
