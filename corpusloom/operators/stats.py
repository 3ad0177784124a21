"""Run statistics, usage and cost: aggregations to a few rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import half_even

MILLION = 1_000_000


def price(model: Column, column: int) -> Column:
    """Input (0) or output (1) price of a model; the default for an unknown one."""
    known = F.create_map(*[
        F.lit(v) for v in chain(*((m, p[column]) for m, p in fv.PRICES.items()))
    ])
    return F.coalesce(F.try_element_at(known, model), F.lit(fv.DEFAULT_PRICE[column]))


def cost(prompt_tokens: Column, completion_tokens: Column, model: Column) -> Column:
    total = prompt_tokens / MILLION * price(model, 0) + completion_tokens / MILLION * price(model, 1)
    return half_even(total, 4)


def usage_totals(calls: DataFrame, by: list[str] | None = None, count_empty: bool = False) -> DataFrame:
    """calls, prompt_tokens, completion_tokens of (prompt_tokens, completion_tokens).

    A call that reports no tokens is not counted, unless `count_empty`. Rows of a
    rule-based run, where no call has any, say themselves how many `calls` they stand for.
    """
    used = (F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0)
    number = F.count("*") if count_empty else F.count_if(used)
    if "calls" in calls.columns:
        number = F.coalesce(F.sum("calls"), F.lit(0)).cast("bigint")
    return calls.groupBy(*(by or [])).agg(
        number.alias("calls"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
    )


def with_cost(totals: DataFrame, model: Column) -> DataFrame:
    return totals.withColumn(
        "estimated_cost_usd", cost(F.col("prompt_tokens"), F.col("completion_tokens"), model)
    )


def run_statistics(
    discovered: DataFrame, records: DataFrame, usage: DataFrame, model: str,
    wall_time_seconds: float | None = None,
) -> DataFrame:
    """One row. `discovered` is (path, lines); each input is aggregated once. The wall time
    is the caller's to measure; without one there is no such column."""
    found = discovered.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")
    )
    made = records.agg(F.count("*").alias("files"), F.count_if("from_cache").alias("cached"))
    used = with_cost(usage_totals(usage), F.lit(model))
    one = found.select(F.struct("*").alias("v")).scalar()
    two = made.select(F.struct("*").alias("v")).scalar()
    three = used.select(F.struct("*").alias("v")).scalar()
    row = discovered.sparkSession.range(1).select(
        one.alias("found"), two.alias("made"), three.alias("used")
    )
    timed = [] if wall_time_seconds is None else [F.lit(float(wall_time_seconds)).alias("wall_time_seconds")]
    return row.select(
        F.col("found.files").alias("files_discovered"),
        F.col("made.files").alias("files_analyzed"),
        (F.col("found.files") - F.col("made.files")).alias("files_skipped"),
        F.col("made.cached").alias("files_from_cache"),
        F.col("found.lines").alias("total_source_lines"),
        F.col("used.calls").alias("llm_calls"),
        F.col("used.prompt_tokens").alias("prompt_tokens"),
        F.col("used.completion_tokens").alias("completion_tokens"),
        F.col("used.estimated_cost_usd").alias("estimated_cost_usd"),
        *timed,
    )


def run_rates(statistics: DataFrame) -> DataFrame:
    """Skip rate, cache-hit rate and cost per file; 0 where there was no file."""
    def rate(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    return statistics.select(
        rate("files_skipped", "files_discovered").alias("skip_rate"),
        rate("files_from_cache", "files_analyzed").alias("cache_hit_rate"),
        rate("estimated_cost_usd", "files_analyzed").alias("cost_per_file"),
    )


def cost_forecast(sized: DataFrame, by: str, model: str, output_share: float) -> DataFrame:
    """files × average tokens × price per `by`, from (by, tokens).

    `output_share` is the expected completion tokens per prompt token.
    """
    return sized.groupBy(by).agg(
        F.count("*").alias("files"), F.sum("tokens").alias("tokens")
    ).select(
        by, "files",
        (F.col("tokens") / F.col("files")).alias("avg_tokens"),
        cost(F.col("tokens"), F.col("tokens") * output_share, F.lit(model)).alias("forecast_usd"),
    )


def rollup_levels(files: DataFrame, levels: int = 2) -> DataFrame:
    """files and bytes per package and per level above it, down to the whole corpus.

    A level is a leading step of the package name.
    """
    steps = F.split(F.regexp_replace("package", r"[./]+", "/"), "/")
    named = [F.coalesce(F.get(steps, F.lit(i)), F.lit("")).alias(f"level{i + 1}") for i in range(levels)]
    package = F.coalesce(F.col("package"), F.lit(fv.ROOT_PACKAGE)).alias("package")
    keys = [f"level{i + 1}" for i in range(levels)] + ["package"]
    return (
        files.select(*named, package, "size_bytes")
        .rollup(*keys)
        .agg(
            F.grouping_id().cast("bigint").alias("rolled"),
            F.count("*").alias("files"),
            F.sum("size_bytes").alias("bytes"),
        )
    )


def usage_windows(calls: DataFrame, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """Calls and tokens per tumbling window of `ts`; the same for batch and stream.

    `late` is how long a stream waits for late rows before a window is closed.
    """
    if late:
        calls = calls.withWatermark("ts", late)
    return calls.groupBy(F.window("ts", length).alias("w")).agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens")
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls", "tokens"
    )
