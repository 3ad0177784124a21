"""Request texts for the external model, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import fill, token_count
from corpusloom.operators.chunk import chunk_table
from corpusloom.operators.redact import redact
from corpusloom.settings import Settings


def prompt_table(files: DataFrame, settings: Settings, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per request: path, part, total, prompt, prompt_tokens, and `keep`.

    Redacted and split before the text goes anywhere. A file in one part gets the
    file form, a part of a split file the chunk form.
    """
    safe = redact(files.select(*keep, "path", "language", "content"), settings.secret_rules)
    chunks = chunk_table(safe, settings.chunk_token_budget)
    fields = {name: F.col(name) for name in ("path", "language", "part", "total", "text")}
    prompt = F.when(F.col("chunked"), fill(fv.CHUNK_PROMPT, **fields)).otherwise(
        fill(fv.FILE_PROMPT, **fields)
    )
    return chunks.withColumn("prompt", prompt).select(
        *keep, "path", "part", "total", "prompt",
        token_count(F.col("prompt")).alias("prompt_tokens"),
    )
