"""Complexity as data: a method table, file metrics, bands, hotspots.

File metrics are computed inside the row from an array of methods. The method
table is that array exploded. Neither needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import code
from corpusloom.functions.text import explode_structs, half_even


def with_methods(files: DataFrame) -> DataFrame:
    """Add nloc and `methods`, an array<struct<pos, name, ccn>> in text order."""
    blanked = files.withColumn("_code", code.blank_comments(F.col("content"), F.col("language")))
    found = blanked.withColumn("_segments", code.segments(F.col("_code"), F.col("language")))
    return found.withColumns({
        "nloc": code.code_lines(F.col("_code")),
        "methods": F.transform(F.col("_segments"), lambda s, i: F.struct(
            (i + 1).cast("bigint").alias("pos"),
            s["name"].alias("name"),
            (code.decision_points(s["body"], F.col("language")) + 1).cast("bigint").alias("ccn"),
        )),
    }).drop("_code", "_segments")


def method_table(files: DataFrame, keys: list[str]) -> DataFrame:
    """One row per method: keys, pos, name, ccn."""
    return explode_structs(with_methods(files), keys, "methods")


def with_metrics(files: DataFrame) -> DataFrame:
    """Add the flat metrics of a file. Without methods: zeros, lowest band."""
    df = with_methods(files)
    ccns = F.transform("methods", lambda m: m["ccn"])
    df = df.withColumns({
        "function_count": F.size("methods").cast("bigint"),
        "_total": F.aggregate(ccns, F.lit(0).cast("bigint"), lambda a, n: a + n),
        "max_cyclomatic_complexity": F.coalesce(F.array_max(ccns), F.lit(0).cast("bigint")),
    })
    mean = F.when(F.col("function_count") > 0, F.col("_total") / F.col("function_count"))
    df = df.withColumn("_mean", F.coalesce(mean, F.lit(0.0)))
    first_max = F.filter(
        "methods", lambda m: m["ccn"] == F.col("max_cyclomatic_complexity")
    )
    return df.withColumns({
        "average_cyclomatic_complexity": half_even(F.col("_mean"), 2),
        "most_complex_function": F.get(first_max, F.lit(0))["name"],
        "band": code.band(F.col("_mean"), F.col("max_cyclomatic_complexity")),
    }).drop("_total", "_mean", "methods")


METRICS = [
    "nloc", "function_count", "average_cyclomatic_complexity",
    "max_cyclomatic_complexity", "most_complex_function", "band",
]


def file_complexity(files: DataFrame, keys: list[str]) -> DataFrame:
    return with_metrics(files).select(*keys, *METRICS)


def band_counts(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Files per band as columns, in one aggregation."""
    names = [name for _, _, name in fv.COMPLEXITY_BANDS] + [fv.LOWEST_BAND]
    return metrics.groupBy(*by).agg(
        *[F.count_if(F.col("band") == n).alias(n) for n in names]
    )


def hotspots(methods: DataFrame, k: int) -> DataFrame:
    """The k most complex methods; ties by path and position."""
    return methods.orderBy(F.desc("ccn"), "path", "pos").limit(k)


def hotspots_per(methods: DataFrame, by: str, k: int) -> DataFrame:
    """The k most complex methods of every group.

    The rank filter is applied before the shuffle too (a window group limit), so a
    hot group sends at most k rows per task.
    """
    order = Window.partitionBy(by).orderBy(F.desc("ccn"), "path", "pos")
    return methods.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
