"""Files to chunks that fit a token budget: a 1:N table, made without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import (
    explode_structs,
    fits_budget,
    fixed_width_pieces,
    let,
    lines_with_ends,
    token_count,
)
from corpusloom import fixed_values as fv


def _pieces(text: Column, budget: int) -> Column:
    """Lines as array<struct<text, tokens, solo>>; a line over budget is cut up.

    A full cut piece estimates to budget + 1 tokens; it is still one piece.
    """
    width = max(1, budget * fv.CHARS_PER_TOKEN)

    def piece(line: Column, solo: bool) -> Column:
        return F.struct(
            line.alias("text"), token_count(line).alias("tokens"), F.lit(solo).alias("solo")
        )

    return F.flatten(F.transform(
        lines_with_ends(text),
        lambda line: F.when(
            token_count(line) > budget,
            F.transform(fixed_width_pieces(line, width), lambda cut: piece(cut, True)),
        ).otherwise(F.array(piece(line, False))),
    ))


def _chunk_starts(pieces: Column, budget: int) -> Column:
    """Positions of the pieces that open a chunk, packing greedily in order.

    A solo piece fills its chunk, so whatever follows opens the next one.
    """
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(budget + 1).cast("bigint").alias("used"),
        F.array().cast("array<int>").alias("starts"),
    )

    def add(state: Column, piece: Column) -> Column:
        opens = piece["solo"] | (state["used"] + piece["tokens"] > budget)
        used = F.when(piece["solo"], F.lit(budget + 1)).when(opens, piece["tokens"]).otherwise(
            state["used"] + piece["tokens"]
        )
        return F.struct(
            (state["at"] + 1).alias("at"),
            used.cast("bigint").alias("used"),
            F.when(opens, F.concat(state["starts"], F.array(state["at"])))
            .otherwise(state["starts"]).alias("starts"),
        )

    return F.aggregate(pieces, start, add, lambda state: state["starts"])


def chunks_of(text: Column, budget: int) -> Column:
    """array<string> of chunks whose concatenation is `text`."""

    def at_starts(pieces: Column) -> Column:
        def cut(starts: Column) -> Column:
            def chunk(start: Column, i: Column) -> Column:
                end = F.coalesce(F.get(starts, i + 1), F.size(pieces))
                return F.array_join(F.slice(pieces["text"], start + 1, end - start), "")

            return F.transform(starts, chunk)

        return let(_chunk_starts(pieces, budget), cut)

    return let(text, lambda t: F.when(fits_budget(t, budget), F.array(t)).otherwise(
        let(_pieces(t, budget), at_starts)
    ))


def chunk_table(df: DataFrame, budget: int, text: str = "content") -> DataFrame:
    """One row per chunk: the other columns, part (from 1), total, chunked, text."""
    others = [c for c in df.columns if c != text]
    n = F.size("_texts")
    numbered = F.transform("_texts", lambda chunk, i: F.struct(
        (i + 1).cast("bigint").alias("part"),
        n.cast("bigint").alias("total"),
        (n > 1).alias("chunked"),
        chunk.alias("text"),
    ))
    split = df.withColumn("_texts", chunks_of(F.col(text), budget))
    return explode_structs(split.withColumn("_chunks", numbered), others, "_chunks")


def reassemble(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks back to whole texts; a group is the chunks of one file."""
    return chunks.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda c: c["text"]),
            "",
        ).alias("content"),
        F.count("*").alias("parts"),
    )


def budget_report(docs: DataFrame, budget: int, by: str, text: str) -> DataFrame:
    """Tokens in all, and what does not fit the budget, per `by`."""
    tokens = docs.select(by, token_count(F.col(text)).alias("tokens"))
    over = F.col("tokens") > budget
    return tokens.groupBy(by).agg(
        F.count("*").alias("texts"),
        F.sum("tokens").alias("tokens"),
        F.count_if(over).alias("over_budget"),
        F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0)).alias("tokens_over_budget"),
    )
