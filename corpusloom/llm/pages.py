"""Helpers for exchanges in which a row is a page: many values as one binary.

Values that must meet are dealt to buckets by their hash. Each task packs what it has for
a bucket into one page per slice, so Spark moves few rows, and a hot value is one entry
per slice. The number of buckets is a multiple of the shuffle partitions, so a bucket is a
bounded share of the values however large the input is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS_PER_PARTITION = 4
# A filter of fixed size: 2 ** 24 bits.
FILTER_BITS = 24


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession) -> int:
    return BUCKETS_PER_PARTITION * partitions(spark)


def by_bucket(df: DataFrame) -> DataFrame:
    """Rows of a bucket in one task, one bucket after another."""
    n = partitions(df.sparkSession)
    return df.repartition(n, "bucket").sortWithinPartitions("bucket")


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key of a stream that is sorted by it."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if waiting and waiting[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(part)
    if waiting:
        yield pa.Table.from_batches(waiting)


def values(table: pa.Table, column: str, dtype) -> list[np.ndarray]:
    """The pages of a column as arrays."""
    return [np.frombuffer(x.as_buffer(), dtype) for x in table.column(column)]


def split_by(bucket: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, arrays...) for each bucket that occurs; the order within is kept."""
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    start = 0
    moved = [a[order] for a in arrays]
    for b, end in enumerate(ends.tolist()):
        if end > start:
            yield b, *[a[start:end] for a in moved]
        start = end


def id_filter(ids: DataFrame, column: str) -> Broadcast:
    """A filter of the ids: a fixed number of bits, of which an id sets two. It passes
    every id of `ids`, and of others so many as its bits are dense: it spares text that
    does not matter a shuffle, and decides nothing."""
    mask = (1 << FILTER_BITS) - 1
    hashed = F.xxhash64(F.col(column))
    places = F.explode(F.array(hashed.bitwiseAND(F.lit(mask)), F.shiftright(hashed, 32).bitwiseAND(F.lit(mask))))
    words = (
        ids.select(places.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    )
    # At most 2 ** (FILTER_BITS - 6) rows.
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = words.toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(table)


def with_hash(df: DataFrame, column: str, name: str = "_h") -> DataFrame:
    """Add the hash that `passes` looks up."""
    return df.withColumn(name, F.xxhash64(F.col(column)))


def passes(table: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Mask of the hashes that the filter lets through."""
    mask = (1 << FILTER_BITS) - 1
    ok = np.ones(len(hashed), bool)
    for place in (hashed & mask, (hashed >> 32) & mask):
        ok &= (table[place >> 6].view(np.uint64) >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def filtered(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of `df` that may have a partner in `ids`, tested before any shuffle."""
    table = id_filter(ids, column)
    hashed = with_hash(df, column)
    schema = hashed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(passes(table.value, batch.column("_h").to_numpy())))

    return hashed.mapInArrow(run, schema).drop("_h")


def first_of_class(docs: DataFrame, doc: str, digest: Column) -> DataFrame:
    """(doc, class, first): a digest of the content, and its smallest document id."""
    named = docs.select(F.col(doc).alias("doc"), digest.alias("class"))
    firsts = named.groupBy("class").agg(F.min("doc").alias("first"))
    return named.join(firsts, "class")
