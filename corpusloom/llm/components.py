"""Connected components of a table of links, by hooking to smaller ids, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut


def _ordered(links: DataFrame) -> DataFrame:
    """(a, b) with a > b, each once."""
    return links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in `links` (a, b): the smallest id reachable.

    Large and small stars in turn: each id's larger neighbours, then its smaller ones,
    are linked to the smallest, until nothing changes. Every round is written down, the
    number of rounds grows with the logarithm of the longest path, and the driver gets
    two numbers a round. A star's centre is a key of an aggregation that combines before
    the shuffle; its members are joined to the centre's row, which Spark splits.
    """
    now = cut(_ordered(links))
    checked = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(_ordered(large))
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        joined = large.join(least, large["a"] == least["k"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b")))
        now = cut(_ordered(small))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == checked:
            break
        checked = seen
    smaller = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    roots = now.select(F.col("b").alias("id")).distinct().join(smaller, "id", "left_anti")
    return smaller.unionByName(roots.select("id", F.col("id").alias("component")))
