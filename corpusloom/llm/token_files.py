"""Token ids of a table as files: ascending document order, coded in blocks.

A file is a header and blocks. A block holds whole documents, resets the coder, and
carries its document ids, their lengths and checksums of its coded and its decoded
content; any block is read alone through the manifest. Documents are dealt to files by
ranges of their id, so the files in order hold the whole table in order.

Files are written by the tasks through Arrow's file systems, under a temporary name that
is moved into place when whole, so that a task run again replaces its own file.

A null text is empty (one end id). A null document id sorts first. Rows with equal ids
are all kept, in order of their text. A very long text is a block of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import coder, pages
from corpusloom.llm.arrays import slices
from corpusloom.llm.ship import ship
from corpusloom.llm.tokens import END_ID, encoder

MAGIC = b"TCM1"
# Ids to a block, up to the document that passes it.
BLOCK_IDS = 1 << 20
_HEADER = struct.Struct("<4sIIIIIIII")  # magic, documents, ids, id bound, lanes, words, null mask, 2 crc32
MANIFEST = "file int, block int, at bigint, size bigint, documents bigint, ids bigint"
TOKENS = "doc_id bigint, block_at bigint, n_tokens bigint, ids binary, file int, block int"


def pack_block(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One block. `known` is false where a document id is null."""
    bound = int(ids.max()) + 1 if len(ids) else 1
    if bound > coder.MAX_IDS:
        raise ValueError(f"token ids must be below {coder.MAX_IDS}")
    words, per_lane = coder.encode(ids, bound)
    body = b"".join([
        doc_ids.astype("<i8").tobytes(), np.packbits(known).tobytes(), lengths.astype("<u4").tobytes(),
        per_lane.astype("<u4").tobytes(), words.astype("<u4").tobytes(),
    ])
    return _HEADER.pack(
        MAGIC, len(doc_ids), len(ids), bound, len(per_lane), len(words), (len(known) + 7) // 8,
        zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes()),
    ) + body


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, known, lengths, ids) of a block; ValueError where it is damaged."""
    magic, docs, n, bound, lanes, words, mask, coded, plain = _HEADER.unpack_from(block)
    body = memoryview(block)[_HEADER.size:]
    if magic != MAGIC or zlib.crc32(body) != coded:
        raise ValueError("damaged block")
    ends = np.cumsum([docs * 8, mask, docs * 4, lanes * 4, words * 4])
    part = [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    ids = coder.decode(np.frombuffer(part[4], "<u4"), np.frombuffer(part[3], "<u4"), n, bound)
    if zlib.crc32(ids.astype("<u4").tobytes()) != plain:
        raise ValueError("damaged ids")
    known = np.unpackbits(np.frombuffer(part[1], np.uint8), count=docs).astype(bool)
    return np.frombuffer(part[0], "<i8"), known, np.frombuffer(part[2], "<u4"), ids


def _file_name(k: int) -> str:
    return f"part-{k:06d}.tcm"


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int | None = END_ID, block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Write the files below `path`, and their manifest beside them; returns the manifest."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("t"))
    dealt = rows.repartitionByRange("d").sortWithinPartitions("d", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType
        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId()
        system, root = FileSystem.from_uri(path)
        name = f"{root}/{_file_name(number)}"
        waiting, size, at, done = [], 0, 0, []
        encode = encoder(tokenizer).encode

        def close(out):
            nonlocal waiting, size, at
            parts = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            block = pack_block(*parts)
            out.write(block)
            done.append((number, len(done), at, len(block), len(parts[0]), len(parts[3])))
            waiting, size, at = [], 0, at + len(block)

        out = None
        for batch in slices(batches, "t", 8 << 20):
            if out is None:
                system.create_dir(root, recursive=True)
                whole = f"{name}.{task.taskAttemptId()}"
                out = system.open_output_stream(whole)
            ids, offsets = encode(batch.column("t"), end_id)
            known = batch.column("d").is_valid().to_numpy(zero_copy_only=False)
            doc = batch.column("d").fill_null(0).to_numpy()
            a = 0
            while a < len(doc):
                b = int(np.searchsorted(offsets, offsets[a] + block_ids - size))
                b = min(max(b, a + 1), len(doc))
                waiting.append((doc[a:b], known[a:b], np.diff(offsets[a:b + 1]), ids[offsets[a]:offsets[b]]))
                size += int(offsets[b] - offsets[a])
                a = b
                if size >= block_ids:
                    close(out)
        if out is None:
            return
        if waiting:
            close(out)
        out.close()
        if system.get_file_info(name).type != FileType.NotFound:
            system.delete_file(name)
        system.move(whole, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*done, strict=True), [pa.int32()] * 2 + [pa.int64()] * 4, strict=True)],
            names=["file", "block", "at", "size", "documents", "ids"],
        )

    manifest = f"{path}/_manifest"
    dealt.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, block_at, n_tokens, ids or their crc32, file, block) read back: `block_at`
    is where a document's ids start in its block. Any number of tasks share the blocks."""
    schema = TOKENS if with_ids else TOKENS.replace("ids binary", "ids_crc32 bigint")
    ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, root = FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{_file_name(row['file'])}") as f:
                    f.seek(row["at"])
                    doc, known, lengths, ids = unpack_block(f.read(row["size"]))
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                pieces = [raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                content = pa.array([p.tobytes() for p in pieces], pa.binary()) if with_ids else pa.array(
                    [zlib.crc32(p) for p in pieces], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc, pa.int64(), mask=~known), pa.array(ends - lengths), pa.array(lengths, pa.int64()),
                    content, pa.array([row["file"]] * len(doc), pa.int32()),
                    pa.array([row["block"]] * len(doc), pa.int32()),
                ], names=[x.split()[0] for x in schema.split(", ")])

    # A number of its own: by its size in bytes, the manifest would be one task.
    spread = manifest.repartition(pages.partitions(spark), "file", "block")
    return spread.mapInArrow(read, schema)


def with_start(tokens: DataFrame, path: str) -> DataFrame:
    """Add `start`: ids of all documents before, from the totals of files and blocks."""
    manifest = tokens.sparkSession.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    total: Column = F.coalesce(F.sum("ids").over(before.orderBy("file")), F.lit(0))
    # One row per file, which is one per task of the writing job.
    files = manifest.groupBy("file").agg(F.sum("ids").alias("ids")).select("file", total.alias("base"))
    inner = F.coalesce(F.sum("ids").over(before.partitionBy("file").orderBy("block")), F.lit(0))
    blocks = manifest.select("file", "block", inner.alias("inner")).join(files, "file")
    # Merged: the size of the tokens is not to be told from that of the manifest.
    return tokens.join(blocks.hint("merge"), ["file", "block"]).withColumn(
        "start", (F.col("base") + F.col("inner") + F.col("block_at")).cast("bigint")
    ).drop("base", "inner", "block_at")
