"""A directory tree of source files as a corpus table.

Folders are listed in tasks, one level of the tree after another, on any file system that
pyarrow opens by its address (mounted folders, object stores); Spark's own file source is
not used, as it leaves out names starting with '_' or '.'. A folder that cannot be listed
is a row with its error. Contents are read in pages of a bounded number of bytes, planned
from the listing by a running sum, so that one folder of many files is read by many tasks
and small files share one.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import decode_text
from corpusloom.operators.discover import file_filter
from corpusloom.operators.ranking import running_sum
from corpusloom.session import cut, local_path
from corpusloom.settings import Settings

# What runs on the executors is sent by value: they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a page, and what a file costs besides its bytes.
PAGE_BYTES, FILE_BYTES = 64 << 20, 64 << 10
# Bytes of file content, and rows of a listing, handed over at a time.
_BATCH_BYTES, _BATCH_ROWS = 16 << 20, 8192
_LISTED = "path string, file string, size_bytes bigint, folder boolean, error string"


def _file_system(address: str):
    """(file system, path on it) of an address; a plain path is a mounted folder."""
    from pyarrow import fs

    scheme, colon, rest = address.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if scheme == "file" else address).lstrip("/")
    return fs.FileSystem.from_uri(address)


def _mounted(address: str) -> bool:
    scheme, colon, _ = address.partition(":")
    return not colon or "/" in scheme or scheme == "file"


def _entries(system, folder: str, mounted: bool) -> Iterator[tuple[str, str, int | None, bool]]:
    """(name, path, size, is folder) of what a folder holds, as it is listed. A link to a
    folder is left out; a file that has gone meanwhile, or a link to nothing, too."""
    if mounted:
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir():
                    if not entry.is_symlink():
                        yield entry.name, entry.path, None, True
                    continue
                try:
                    yield entry.name, entry.path, entry.stat().st_size, False
                except OSError:
                    continue
        return
    from pyarrow import fs

    for info in system.get_file_info(fs.FileSelector(folder)):
        yield info.base_name, info.path, info.size, info.type == fs.FileType.Directory


def _list_folders(address: str, pruned: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(address)
        mounted = _mounted(address)
        names = ["path", "file", "size_bytes", "folder", "error"]
        types = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for at, folder in zip(batch.column("path").to_pylist(), batch.column("file").to_pylist(), strict=True):
                try:
                    for name, file, size, is_folder in _entries(system, folder, mounted):
                        if is_folder and name in pruned:
                            continue
                        rows.append((f"{at}/{name}" if at else name, file, size, is_folder, None))
                        if len(rows) >= _BATCH_ROWS:
                            yield flush()
                            rows = []
                except OSError as e:
                    rows.append((at, folder, None, False, f"{type(e).__name__}: {e}"))
        if rows:
            yield flush()

    return run


def list_tree(spark: SparkSession, root: str, settings: Settings | None = None, on_error: str = "fail") -> DataFrame:
    """(path, file, size_bytes, error) of all files outside the excluded directories.

    A folder that cannot be listed is a row with `error`: by default that fails the scan,
    `on_error="keep"` returns it. Each level of the tree is a job, whose folders are dealt
    to the tasks; the levels are written down as they are found.
    """
    settings = settings or Settings()
    address = os.path.realpath(local_path(root)) if _mounted(root) else root
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = _list_folders(address, frozenset(settings.active_exclude_dirs))
    folders = spark.createDataFrame([("", _file_system(address)[1])], "path string, file string")
    levels = []
    while True:
        listed = cut(folders.mapInArrow(run, _LISTED))
        levels.append(listed.where("not folder").drop("folder"))
        below = listed.where("folder").select("path", "file")
        number = below.count()
        if not number:
            break
        folders = below.repartition(min(tasks, number), "file")
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    if on_error == "fail":
        lost = [f"{r.path or '.'} ({r.error})" for r in found.where("error is not null").limit(5).collect()]
        if lost:
            raise OSError("folders that cannot be listed: " + ", ".join(lost))
    return found


def paged(listing: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Add `page`: files in path order, about `page_bytes` of content to a page. A file over
    that is alone with what starts before it ends."""
    costs = listing.withColumn("_cost", F.col("size_bytes") + FILE_BYTES)
    placed = running_sum(costs, [], ["path"], "_cost", "_before")
    return placed.withColumn("page", F.floor(F.col("_before") / page_bytes).cast("int")).drop("_cost", "_before")


def _read_contents(address: str):
    """Fill in the bytes of each file, a bounded amount at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(address)
        schema = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("raw", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for row in batch.select(["path", "file", "size_bytes"]).to_pylist():
                try:
                    with system.open_input_stream(row.pop("file"), compression=None) as f:
                        row["raw"] = f.read()
                except OSError:
                    row["raw"] = None
                rows.append(row)
                held += len(row["raw"] or b"")
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def scan_tree(
    spark: SparkSession, root: str, settings: Settings | None = None, on_error: str = "fail", page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """The files a run takes part in: path, size_bytes, content (decoded).

    A file that cannot be read keeps a null content.
    """
    settings = settings or Settings()
    address = os.path.realpath(local_path(root)) if _mounted(root) else root
    wanted = list_tree(spark, root, settings, on_error).where("error is null").where(file_filter(settings))
    pages = cut(paged(wanted.drop("error"), page_bytes))
    number = (pages.agg(F.max("page")).first()[0] or 0) + 1
    # A page is a task; the caller sizes pages for the cores there are.
    dealt = pages.repartitionById(number, "page")
    read = dealt.mapInArrow(_read_contents(address), "path string, size_bytes bigint, raw binary")
    return read.select("path", "size_bytes", decode_text(F.col("raw")).alias("content"))
