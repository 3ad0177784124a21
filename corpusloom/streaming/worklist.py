"""Incremental runs: new files in, requests for unseen contents out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.cache import with_key
from corpusloom.operators.discover import discover
from corpusloom.operators.prompts import prompt_table
from corpusloom.schemas import CORPUS
from corpusloom.settings import Settings

_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WORKLIST = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("batch", T.LongType()),
])


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    """The requests of all batches. Only a missing folder is an empty list."""
    try:
        return spark.read.schema(_WORKLIST).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _WORKLIST)


def start_worklist(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    settings: Settings | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process what is new in `source` (Parquet corpus files) and stop.

    Seen keys are state of the stream, one entry of a few bytes per key, which a batch
    looks up for its own keys only: no batch reads what earlier ones wrote, and state on
    disk (RocksDB, unless the session names another store) keeps memory flat. Of copies
    in one batch one is sent. State and output of a batch are committed together: a batch
    is one folder, written over when it is replayed from the same state.
    """
    settings = settings or Settings()
    if settings.max_files is not None:
        raise ValueError("max_files is a limit of a run, not of a stream")
    provider = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(provider, "").endswith("RocksDBStateStoreProvider") and not _named_by_user(spark, provider):
        spark.conf.set(provider, _STATE_STORE)

    def process(batch: DataFrame, batch_id: int) -> None:
        prompt_table(batch, settings, keep=("key",)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(CORPUS)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    keyed = with_key(discover(stream.parquet(source), settings), settings.model)
    # A file whose content could not be read has no key.
    unseen = keyed.where(F.col("key").isNotNull()).dropDuplicates(["key"])
    return (
        unseen.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _named_by_user(spark: SparkSession, key: str) -> bool:
    return spark.sparkContext.getConf().contains(key)
