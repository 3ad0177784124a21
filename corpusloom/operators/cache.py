"""Content keys, cache lookup and the list of work that is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.operators.prefilter import prefiltered
from corpusloom.session import cut


def content_key(content: Column, model: str, version: str = fv.PROMPT_VERSION) -> Column:
    """SHA-256 of version, model and content; the path is not part of it."""
    return F.sha2(F.concat(F.lit(f"{version}\x00{model}\x00"), content), 256)


def with_key(files: DataFrame, model: str) -> DataFrame:
    return files.withColumn("key", content_key(F.col("content"), model))


def cache_lookup(keyed: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Add the stored insight (null = miss) and from_cache to rows with path and key.

    `stored` has one row per key. Pass narrow rows: everything in `keyed` crosses the
    shuffle. Many paths may share one key; Spark splits such a partition when it sees its
    size (the left side of a join with one row per key can be split). Without a store
    (cache off, or rule-based results that must not mix with it) every row misses.
    """
    if stored is None:
        return keyed.withColumns({"insight": F.lit(None), "from_cache": F.lit(False)})
    hit = stored.withColumn("_hit", F.lit(True))
    return keyed.join(hit, "key", "left").withColumn(
        "from_cache", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def worklist(keyed: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(key, path) to be processed: one path, the first, per key that is not stored.

    Grouping comes first: copies collapse before the shuffle, and the anti-join then
    meets every key once.
    """
    firsts = keyed.groupBy("key").agg(F.min("path").alias("path"))
    return firsts if stored is None else firsts.join(stored.select("key"), "key", "left_anti")


def work_files(files: DataFrame, keyed: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The files to be processed, with content: a join on the unique path, before which a
    filter of the paths drops the texts of the others."""
    todo = cut(worklist(keyed, stored))
    return prefiltered(files, todo, "path").join(todo, "path")
