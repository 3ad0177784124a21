"""File records: what is known about a file, in one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.complexity import METRICS, with_metrics
from corpusloom.operators.insight import with_insight
from corpusloom.schemas import FILE_RECORD
from corpusloom.settings import Settings

_FILE = ["path", "language", "package", "size_bytes"]


def assemble(files: DataFrame, insights: DataFrame) -> DataFrame:
    """Records of the files that have an insight (path, insight, chunked, from_cache).

    The metrics are computed before the join on the unique path, so no text crosses it.
    """
    metrics = with_metrics(files.select(*_FILE, "content")).drop("content")
    return metrics.join(insights, "path").select(*_record_columns())


def rule_based_records(
    files: DataFrame, settings: Settings | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Records whose insight comes from the rules: one pass over the text, no shuffle.

    Metrics read the original text, the insight reads the redacted one. `keep` names
    further columns to carry along; `parts`, the chunks of a file, may be among them.
    """
    df = with_metrics(files.select(*[c for c in keep if c != "parts"], *_FILE, "content"))
    df = with_insight(df, settings)
    return df.withColumn("from_cache", F.lit(False)).select(*keep, *_record_columns())


def _record_columns() -> list:
    return [
        *_FILE,
        F.struct(*METRICS).alias("complexity"),
        "insight",
        F.col("chunked").alias("analyzed_with_chunking"),
        "from_cache",
    ]


def hits_and_results(looked_up: DataFrame, results: DataFrame) -> DataFrame:
    """(path, insight, chunked, from_cache) of cached and of newly made insights.

    A cached row never counts as chunked. `results` has (path, insight, chunked).
    """
    hits = looked_up.where("from_cache").select(
        "path", "insight", F.lit(False).alias("chunked"), "from_cache"
    )
    made = results.select("path", "insight", "chunked", F.lit(False).alias("from_cache"))
    return hits.unionByName(made)


def skipped(discovered: DataFrame, records: DataFrame) -> DataFrame:
    """Discovered files without a record."""
    return discovered.join(records.select("path"), "path", "left_anti")


def conforms(records: DataFrame) -> bool:
    """Whether names and types are those of the declared record."""
    def plain(schema):
        return [(f.name, f.dataType.simpleString()) for f in schema.fields]

    return plain(records.schema) == plain(FILE_RECORD)
