"""Replies per part to one insight per file.

Input: (path, part, insight). A group is the parts of one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.insight import merged


def merge_methods(parts: DataFrame) -> DataFrame:
    """One row per path and signature, the first by (part, position): path, ord, method.

    The minimum is taken before the shuffle as well, so repeats collapse early.
    """
    methods = parts.select("path", "part", F.posexplode("insight.key_methods").alias("pos", "m"))
    first = methods.groupBy("path", F.col("m.signature").alias("signature")).agg(
        F.min_by("m", F.struct("part", "pos")).alias("m"),
        F.min(F.struct("part", "pos")).alias("at"),
    )
    return first.select(
        "path", "signature", F.col("m.name").alias("name"), F.col("m.description").alias("description"),
        F.col("at.part").alias("part"), (F.col("at.pos") + 1).cast("bigint").alias("pos"), "m",
    )


def merge_list(parts: DataFrame, field: str) -> DataFrame:
    """One row per path and item of a list field, with its place in the union."""
    items = parts.select(
        "path", "part", F.posexplode(f"insight.{field}").alias("pos", "item")
    )
    first = items.groupBy("path", "item").agg(F.min(F.struct("part", "pos")).alias("at"))
    return first.select(
        "path", "item", F.col("at.part").alias("part"),
        (F.col("at.pos") + 1).cast("bigint").alias("pos"),
    )


def merge_scalars(parts: DataFrame, limit: int | None = None) -> DataFrame:
    """Role of the first part; summaries in part order, joined. `limit` cuts to characters."""
    told = F.array_sort(F.collect_list(
        F.when(F.col("insight.summary") != "", F.struct("part", F.col("insight.summary")))
    ))
    joined = F.array_join(F.transform(told, lambda s: s["summary"]), " ")
    if limit is not None:
        joined = F.substring(joined, 1, limit)
    return parts.groupBy("path").agg(
        F.count("*").alias("parts"),
        F.min_by("insight.role", "part").alias("role"),
        F.when(F.count("*") == 1, F.first("insight.summary")).otherwise(joined).alias("summary"),
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """(path, part, insight) to (path, parts, insight): all merge rules together."""
    whole = parts.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("part", "insight"))).alias("numbered")
    )
    in_order = F.transform("numbered", lambda p: p["insight"])
    return whole.select(
        "path", F.size("numbered").cast("bigint").alias("parts"), in_order.alias("ordered")
    ).select("path", "parts", merged(F.col("ordered")).alias("insight"))
