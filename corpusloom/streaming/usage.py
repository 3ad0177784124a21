"""Usage per time window from a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.stats import usage_windows


def start_usage_windows(
    calls: DataFrame, out: str, checkpoint: str, length: str = "1 hour", late: str = "10 minutes"
) -> StreamingQuery:
    """Append closed windows of a streaming (ts, tokens) table to Parquet.

    The watermark bounds the state: a window leaves it once no row can be on time.
    """
    return (
        usage_windows(calls, length, late)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
