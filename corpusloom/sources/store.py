"""Insight store: Parquet files by key prefix under a log of commits.

An append writes its files first, in a folder of its own, and then publishes one small
manifest; files without a manifest are never read, so a writer that dies leaves nothing.
A manifest names the commits that its writer had seen. Keys of a commit and of those it had
seen are different, so most reads are a plain scan; only commits written side by side may
hold a key twice, and then the later one counts. Compaction is a commit that replaces
others. Files lie by the first digits of the key, so that a lookup reads its own prefixes.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import fixed_values as fv
from corpusloom.functions.insight import is_valid
from corpusloom.schemas import INSIGHT
from corpusloom.session import cut

# Hexadecimal digits of the key that name a folder.
PREFIX_DIGITS = 1
_DATA = ["key", "insight"]
_STORED = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("insight", INSIGHT),
    T.StructField("commit", T.StringType()),
    T.StructField("prompt_version", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prefix", T.StringType()),
])
_MANIFEST = "id string, seen array<string>, replaces array<string>"


def _prefix(key: Column) -> Column:
    return F.substring(key, 1, PREFIX_DIGITS)


def commits(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """The commits that count, in order: id, and the commits its writer had seen. Only a
    missing folder is an empty store: any other error is raised."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{path}/commits/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    # What was replaced after a writer had seen it is seen in its replacement's place.
    gone = {old for r in rows for old in r.replaces}
    seen = {r.id: set(r.seen) for r in rows}
    for r in rows:
        for known in seen.values():
            if known & set(r.replaces):
                known.add(r.id)
    return {i: seen[i] for i in sorted(seen) if i not in gone}


def _side_by_side(found: dict[str, set[str]]) -> set[str]:
    """Commits with another one that neither had seen: only these may share keys."""
    ids = list(found)
    return {i for a in ids for b in ids if a < b and a not in found[b] and b not in found[a] for i in (a, b)}


def _rows(spark: SparkSession, path: str, ids, model: str, version: str, prefixes: list[str] | None) -> DataFrame:
    if not ids:
        return spark.createDataFrame([], _STORED)
    folders = [f"{path}/data/commit={i}" for i in ids]
    stored = spark.read.schema(_STORED).option("basePath", f"{path}/data").parquet(*folders)
    stored = stored.where((F.col("prompt_version") == version) & (F.col("model") == model))
    if prefixes is not None:
        stored = stored.where(F.col("prefix").isin(prefixes))
    return stored.where(is_valid(F.col("insight")))


def read_store(
    spark: SparkSession, path: str, model: str, version: str = fv.PROMPT_VERSION, keys: DataFrame | None = None,
) -> DataFrame:
    """Stored (key, insight) of a model, one per key; a broken entry does not count as
    stored. With `keys` (key), only the prefixes that occur there are read."""
    prefixes = None
    if keys is not None:
        # At most 16 ** PREFIX_DIGITS values.
        prefixes = [r.prefix for r in keys.select(_prefix(F.col("key")).alias("prefix")).distinct().collect() if r.prefix]
    found = commits(spark, path)
    shared = _side_by_side(found)
    alone = _rows(spark, path, [i for i in found if i not in shared], model, version, prefixes).select(*_DATA)
    if not shared:
        return alone
    contested = _rows(spark, path, sorted(shared), model, version, prefixes)
    latest = contested.groupBy("key").agg(F.max_by("insight", "commit").alias("insight"))
    return alone.unionByName(latest)


def _commit_id() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def _write(rows: DataFrame, path: str, commit: str, model: str, version: str) -> None:
    """Files of a commit: rows of a prefix together, so that there are few."""
    placed = rows.select(
        "key", "insight", F.lit(version).alias("prompt_version"), F.lit(model).alias("model"), _prefix(F.col("key")).alias("prefix"))
    placed.repartition("prefix").write.partitionBy("prompt_version", "model", "prefix").parquet(f"{path}/data/commit={commit}")


def _publish(spark: SparkSession, path: str, commit: str, seen, replaces=()) -> None:
    """One file in a folder of its own: it is there as a whole or not at all."""
    row = spark.createDataFrame([(commit, sorted(seen), sorted(replaces))], _MANIFEST)
    row.coalesce(1).write.json(f"{path}/commits/{commit}")


def append_store(
    results: DataFrame, path: str, model: str, version: str = fv.PROMPT_VERSION
) -> str | None:
    """Append the results (path, key, insight) whose key is not stored yet; returns the
    commit, None where there is nothing to add.

    Copies of a text share a key; the result of the first path is stored.
    """
    spark = results.sparkSession
    seen = commits(spark, path)
    # Copies collapse on narrow rows first; the insights then move once, by unique path.
    firsts = cut(results.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("path").alias("path")))
    known = read_store(spark, path, model, version, firsts).select("key")
    fresh = cut(firsts.join(known, "key", "left_anti").select("path"))
    if fresh.isEmpty():
        return None
    commit = _commit_id()
    _write(results.join(fresh, "path", "left_semi"), path, commit, model, version)
    _publish(spark, path, commit, seen)
    return commit


def compact_store(spark: SparkSession, path: str) -> str | None:
    """One commit in place of all there are, for every model and version; what it replaces
    is no longer read. Commits that are published meanwhile stay beside it."""
    found = commits(spark, path)
    if len(found) < 2:
        return None
    commit = _commit_id()
    folders = [f"{path}/data/commit={i}" for i in found]
    stored = spark.read.schema(_STORED).option("basePath", f"{path}/data").parquet(*folders).where(is_valid(F.col("insight")))
    latest = stored.groupBy("prompt_version", "model", "prefix", "key").agg(F.max_by("insight", "commit").alias("insight"))
    latest.select("key", "insight", "prompt_version", "model", "prefix").repartition("prefix").write.partitionBy(
        "prompt_version", "model", "prefix").parquet(f"{path}/data/commit={commit}")
    every = set(found).union(*found.values())
    _publish(spark, path, commit, every, found)
    return commit
