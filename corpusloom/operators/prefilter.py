"""A filter of ids that rows meet before a shuffle.

The ids become a bit array of fixed size, which Spark evaluates once as a scalar subquery;
a row looks its two bits up. Every row with a partner passes, and of the others as many as
the bits are dense: the filter spares wide rows an exchange and decides nothing, so the
join itself follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2 ** 24 bits: 2 MB.
FILTER_BITS = 24


def _places(column: Column) -> list[Column]:
    mask = F.lit((1 << FILTER_BITS) - 1)
    hashed = F.xxhash64(column)
    return [hashed.bitwiseAND(mask), F.shiftrightunsigned(hashed, 32).bitwiseAND(mask)]


def bits_of(ids: DataFrame, column: str) -> DataFrame:
    """One row, one array of 2 ** (FILTER_BITS - 6) numbers: the bits of all ids."""
    words = (
        ids.select(F.explode(F.array(*_places(F.col(column)))).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    )
    every = ids.sparkSession.range(1 << (FILTER_BITS - 6)).select(F.col("id").alias("word"))
    filled = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))


def prefiltered(df: DataFrame, ids: DataFrame, column: str, others: bool = False) -> DataFrame:
    """Rows of `df` that may have a partner in `ids`; or the others, which have none."""
    bits = bits_of(ids, column).scalar()
    ok = F.lit(True)
    for place in _places(F.col(column)):
        word = F.get(bits, F.shiftright(place, 6).cast("int"))
        ok = ok & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    passes = F.col(column).isNotNull() & ok
    return df.where(~passes if others else passes)
