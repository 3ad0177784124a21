"""Session-level helpers: shared scratch space, lineage cuts, input spreading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# The private folder of each local application that names none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it.

    Without that setting, a private folder is made in a local session only (tests): on a
    cluster every executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # The setting cannot be changed in a running application: one folder for each.
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="corpusloom-")
        named = _LOCAL[application]
    return named.rstrip("/")


# Paths handed out within each open scope, the innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes with the scope it is made in."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that operators write to the shared folder, when the work within
    is done. Results that are to stay must be written elsewhere by then."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            remove_path(spark, path)


@contextmanager
def batch_bytes(spark: SparkSession, limit: int) -> Iterator[None]:
    """Arrow batches of about `limit` bytes for the jobs that run within, whose rows may be
    of any length; the session's own setting is back afterwards."""
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", limit):
        yield


@contextmanager
def scan_bytes(spark: SparkSession, limit: int) -> Iterator[None]:
    """Files are read by tasks of about `limit` bytes, in the jobs that run within, where a
    task has more to do than its bytes tell."""
    with _setting(spark, "spark.sql.files.maxPartitionBytes", limit):
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path, on whatever file system it is; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def local_path(path: str) -> str:
    """A path that plain file calls take; it must be mounted on every executor."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"a directory tree needs a mounted file system, not {path}")
    return "/" + rest.lstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and continue from the written table.

    Column statistics, lineage and non-deterministic columns (partition ids) are
    fixed from here on; a lost executor re-reads the table and recomputes nothing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rebalance a scan that has fewer splits than the cluster has cores.

    Few big rows in one row group would keep regex work on one core. A corpus with
    enough splits is returned as it is: no shuffle at scale. Use on plain scans.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
