"""Rule-based insight per file, and its method table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import insight as rules
from corpusloom.functions import paths
from corpusloom.functions.text import explode_structs
from corpusloom.operators.chunk import chunks_of
from corpusloom.operators.redact import redact
from corpusloom.schemas import METHOD
from corpusloom.settings import Settings


def with_insight(
    files: DataFrame, settings: Settings | None = None, max_methods: int | None = None
) -> DataFrame:
    """Add `insight`, `chunked` and `parts` from the redacted text; the text itself goes away.

    All methods are reported unless `max_methods` says how many. A file over the chunk
    budget gets one insight per chunk, merged within the row.
    """
    settings = settings or Settings()
    df = redact(files, settings.secret_rules)
    df = df.withColumns({
        "_chunks": chunks_of(F.col("content"), settings.chunk_token_budget),
        "_role": paths.role(F.col("path")),
    })
    df = df.withColumn("_parts", F.transform("_chunks", lambda text: rules.insight(
        text, F.col("path"), F.col("_role"), max_methods
    )))
    return df.withColumns({
        "insight": rules.merged(F.col("_parts")),
        "chunked": F.size("_chunks") > 1,
        "parts": F.greatest(F.size("_chunks"), F.lit(0)).cast("bigint"),
    }).drop("_chunks", "_role", "_parts", "content")


def reported_methods(analyzed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per reported method: keys, pos and the METHOD fields."""
    numbered = F.transform("insight.key_methods", lambda m, i: F.struct(
        (i + 1).cast("bigint").alias("pos"),
        *[m[field].alias(field) for field in METHOD.fieldNames()],
    ))
    return explode_structs(analyzed.withColumn("_methods", numbered), keys, "_methods")


def framework_table(files: DataFrame, keys: list[str]) -> DataFrame:
    named = F.transform(rules.frameworks(F.col("content")), lambda f: F.struct(f.alias("framework")))
    return explode_structs(files.withColumn("_frameworks", named), keys, "_frameworks")
