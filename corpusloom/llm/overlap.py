"""Which windows of a document also start in an earlier document, over a whole table.

The two substring operators share this frame and differ in how they choose anchors and
how they decide:

1. anchors: every match of a window length shares an anchor, so an anchor that one
   document alone holds rules its windows out. Anchors meet by hash;
2. contexts: documents with shared anchors send, for these anchors only, what is needed to
   decide their windows; a bucket decides exactly, and answers per document;
3. documents with answers are cut.

Each exchange sends pages (see `pages`). A task settles by itself what it can: an anchor
of two documents of its slice is shared, and of equal contexts of a slice all but those of
the smallest document are covered. So of a passage that a third of all documents hold, a
slice sends one entry, and no task gathers its occurrences.

Documents with equal texts are one class. The smallest id stands for it; all others are
removed whole if they are long enough. Rows are told apart by id and digest of the text,
so rows with equal ids are documents each, of which none is smaller. A row without an id
is neither smaller nor larger than any, and is left as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays, pages
from corpusloom.llm.ship import ship
from corpusloom.session import cut

PAGE = (
    "bucket int, settled boolean, docs binary, tags binary, keys binary, rows binary, places binary, flags binary"
)
# Answers for many documents: their rows lie one after another.
TOLD = "bucket int, docs binary, tags binary, counts binary, places binary, flags binary"
ANSWER = "doc bigint, tag bigint, places binary, flags binary"


@dataclass(frozen=True)
class Contexts:
    keys: np.ndarray    # n x width bytes that decide
    bucket: np.ndarray  # hash of what all equal windows share
    row: np.ndarray
    place: np.ndarray
    flags: np.ndarray   # uint16: windows of the context that are asked for


@dataclass(frozen=True)
class Method:
    """How an operator finds and decides. All work on the bytes of a slice of rows."""

    anchors: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    contexts: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Contexts]
    decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    key_width: int
    # Bytes of text whose arrays are in memory at a time.
    slice_bytes: int = arrays.SLICE_BYTES


def fixed_width(packed: np.ndarray) -> pa.Array:
    """A numpy array of fixed-size byte strings as an Arrow array."""
    kind = pa.binary(packed.dtype.itemsize)
    return pa.Array.from_buffers(kind, len(packed), [None, pa.py_buffer(packed.tobytes())])


def _page(bucket, settled, docs, tags, row, place, keys=None, flags=None) -> tuple:
    """A row of PAGE; only the documents that occur are in its table."""
    used, local = np.unique(row, return_inverse=True)
    return (
        bucket, settled, docs[used].tobytes(), tags[used].tobytes(), b"" if keys is None else keys.tobytes(),
        local.astype("<u4").tobytes(), place.astype("<u4").tobytes(), b"" if flags is None else flags.tobytes(),
    )


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "bigint": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class _Answers:
    """What a task tells documents, as one page per bucket of documents."""

    def __init__(self, n_buckets: int):
        self.n, self.parts = n_buckets, []

    def add(self, docs, tags, row, place, flags) -> None:
        self.parts.append((docs[row], tags[row], place.astype("<u4"), flags))

    def batch(self) -> pa.RecordBatch:
        out = []
        if self.parts:
            doc, tag, place, flags = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.lexsort((tag, doc))
            doc, tag, place, flags = doc[order], tag[order], place[order], flags[order]
            bucket = (arrays.mix(doc.view(np.uint64) ^ tag.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % self.n
            for b, d, t, p, f in pages.split_by(bucket, self.n, doc, tag, place, flags):
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
                starts = np.nonzero(new)[0]
                counts = np.diff(np.append(starts, len(d))).astype("<u4")
                out.append((b, d[starts].tobytes(), t[starts].tobytes(), counts.tobytes(), p.tobytes(), f.tobytes()))
        return _batch(out, TOLD)


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document from the pages of its bucket."""
    for table in pages.grouped(batches, "bucket"):
        docs, tags = (np.concatenate(pages.values(table, c, np.int64)) for c in ("docs", "tags"))
        counts = np.concatenate(pages.values(table, "counts", "<u4")).astype(np.int64)
        places = np.concatenate(pages.values(table, "places", "<u4"))
        flags = np.concatenate(pages.values(table, "flags", np.uint16))
        doc, tag = np.repeat(docs, counts), np.repeat(tags, counts)
        order = np.lexsort((tag, doc))
        doc, tag = doc[order], tag[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
        starts = np.nonzero(new)[0]
        ends = np.append(starts[1:], len(doc))
        raw, bits = memoryview(places[order].tobytes()), memoryview(flags[order].tobytes())
        yield _batch([
            (int(doc[a]), int(tag[a]), raw[4 * a:4 * b].tobytes(), bits[2 * a:2 * b].tobytes())
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
        ], ANSWER)


def _gathered(told: DataFrame) -> DataFrame:
    return pages.by_bucket(told).mapInArrow(_per_document, ANSWER)


def _runs(order: np.ndarray, *sorted_keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys, for each position of the order."""
    new = np.zeros(len(order), bool)
    for keys in sorted_keys:
        new[1:] |= keys[1:] != keys[:-1]
    return np.cumsum(new)


def _anchor_pages(method: Method, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = count()
        for batch in arrays.slices(batches, "text", method.slice_bytes):
            docs, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            raw, offsets = arrays.text_bytes(batch.column("text"))
            hashes, row, place = method.anchors(raw, offsets)
            order = np.argsort(hashes, kind="stable")
            hashes, row, place = hashes[order], row[order], place[order]
            run_of = _runs(order, hashes)
            starts = np.nonzero(np.diff(run_of, prepend=-1))[0]
            # Rows ascend within a run, so its ends tell whether it is of one document.
            ends = np.append(starts[1:], len(hashes)) - 1
            several = (row[starts] != row[ends]) if len(starts) else np.zeros(0, bool)
            shared = several[run_of] if len(starts) else np.zeros(0, bool)
            out = []
            if shared.any():
                out.append(_page(next(turn) % n_buckets, True, docs, tags, row[shared], place[shared],
                                 flags=np.ones(int(shared.sum()), np.uint16)))
            # All places of an anchor of one document; of a shared one, a single entry.
            first = np.zeros(len(hashes), bool)
            first[starts] = True
            sent = np.nonzero(~shared | first)[0]
            h, known = hashes[sent], shared[sent].astype(np.uint16)
            for b, hb, rb, pb, kb in pages.split_by(
                (h >> np.uint64(33)).astype(np.int64) % n_buckets, n_buckets, h, row[sent], place[sent], known
            ):
                out.append(_page(b, False, docs, tags, rb, pb, keys=hb, flags=kb))
            yield _batch(out, PAGE)

    return run


def _add_settled(out: _Answers, table: pa.Table) -> None:
    docs, tags, rows, places, flags = (
        pages.values(table, c, t) for c, t in
        (("docs", np.int64), ("tags", np.int64), ("rows", "<u4"), ("places", "<u4"), ("flags", np.uint16)))
    for d, t, r, p, f in zip(docs, tags, rows, places, flags, strict=True):
        out.add(d, t, r, p, f)


def _joined_pages(table: pa.Table):
    """(docs, tags, row, place, flags) of all pages of a bucket, rows numbered through."""
    docs, tags = (np.concatenate(pages.values(table, c, np.int64)) for c in ("docs", "tags"))
    sizes = [len(x) for x in pages.values(table, "docs", np.int64)]
    base = np.cumsum([0, *sizes[:-1]])
    row = np.concatenate([r.astype(np.int64) + b for r, b in zip(pages.values(table, "rows", "<u4"), base, strict=True)])
    place = np.concatenate(pages.values(table, "places", "<u4"))
    return docs, tags, row, place, np.concatenate(pages.values(table, "flags", np.uint16))


def _split_settled(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    mask = table.column("settled")
    return table.filter(mask), table.filter(pc.invert(mask))


def _shared_anchors(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    for table in pages.grouped(batches, "bucket"):
        settled, asked = _split_settled(table)
        out = _Answers(n_buckets)
        _add_settled(out, settled)
        if asked.num_rows:
            hashes = np.concatenate(pages.values(asked, "keys", np.uint64))
            docs, tags, row, place, known = _joined_pages(asked)
            # Sorted by hash, then document: a run of two documents is shared.
            order = np.lexsort((row, hashes))
            hashes, row, place, known = hashes[order], row[order], place[order], known[order]
            run_of = _runs(order, hashes)
            starts = np.nonzero(np.diff(run_of, prepend=-1))[0]
            ends = np.append(starts[1:], len(hashes)) - 1
            shared = (row[starts] != row[ends]) | (np.maximum.reduceat(known, starts) > 0)
            told = shared[run_of] & (known == 0)
            out.add(docs, tags, row[told], place[told], np.ones(int(told.sum()), np.uint16))
        yield out.batch()


def _context_pages(method: Method, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = count()
        for batch in arrays.slices(batches, "text", method.slice_bytes):
            # By id, so that the first of equal contexts is that of the smallest.
            batch = batch.sort_by([("doc", "ascending")])
            docs, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            raw, offsets = arrays.text_bytes(batch.column("text"))
            places = [np.unique(np.frombuffer(x, "<u4")) for x in batch.column("places").to_pylist()]
            owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
            found = method.contexts(raw, offsets, owner, np.concatenate(places).astype(np.int64))
            if not len(found.row):
                continue
            width = method.key_width
            whole = np.concatenate([found.keys, found.flags[:, None].view(np.uint8)], axis=1)
            packed = np.ascontiguousarray(whole).view(f"V{width + 2}").ravel()
            code = fixed_width(packed).dictionary_encode().indices.to_numpy()
            # Contexts come by row, and rows by id.
            first = np.full(int(code.max()) + 1, len(code))
            np.minimum.at(first, code, np.arange(len(code)))
            later = docs[found.row] > docs[found.row[first[code]]]
            out = []
            if later.any():
                out.append(_page(next(turn) % n_buckets, True, docs, tags, found.row[later], found.place[later],
                                 flags=found.flags[later]))
            sent = np.nonzero(~later)[0]
            for b, at in pages.split_by(
                (found.bucket[sent] >> np.uint64(33)).astype(np.int64) % n_buckets, n_buckets, sent
            ):
                out.append(_page(b, False, docs, tags, found.row[at], found.place[at],
                                 keys=found.keys[at], flags=found.flags[at]))
            yield _batch(out, PAGE)

    return run


def _decided(method: Method, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pages.grouped(batches, "bucket"):
            settled, asked = _split_settled(table)
            out = _Answers(n_buckets)
            _add_settled(out, settled)
            if asked.num_rows:
                keys = np.concatenate(pages.values(asked, "keys", np.uint8)).reshape(-1, method.key_width)
                docs, tags, row, place, flags = _joined_pages(asked)
                told = method.decide(keys, flags, docs[row])
                at = np.nonzero(told)[0]
                out.add(docs, tags, row[at], place[at], told[at])
            yield out.batch()

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text): `tag` tells rows with one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def repeated_windows(rows: DataFrame, method: Method, buckets_factor: int = 4) -> tuple[DataFrame, DataFrame]:
    """(classes, answers) of `keyed` rows.

    classes: doc, tag, first of every row with an id: the smallest id with its text.
    answers: doc, tag, `places` and `flags` for documents that stand for
    their class and have windows that also start in a document with a smaller id.
    """
    spark = rows.sparkSession
    ship(spark)
    named = rows.where("doc is not null")
    classes = named.select("doc", "tag", F.md5("text").alias("class"))
    firsts = classes.groupBy("class").agg(F.min("doc").alias("first"))
    classes = cut(classes.join(firsts, "class").select("doc", "tag", "first"))

    n = pages.partitions(spark)
    anchors = pages.by_bucket(named.mapInArrow(_anchor_pages(method, n), PAGE))
    per_doc = _gathered(anchors.mapInArrow(lambda batches: _shared_anchors(batches, n), TOLD))
    standing = classes.where("doc = first").select("doc", "tag").distinct()
    asked = cut(per_doc.join(standing, ["doc", "tag"]))
    texts = pages.filtered(named, asked, "tag").dropDuplicates(["doc", "tag"])
    wanted = texts.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "places")

    m = n * buckets_factor
    contexts = pages.by_bucket(wanted.mapInArrow(_context_pages(method, m), PAGE))
    answers = cut(_gathered(contexts.mapInArrow(_decided(method, n), TOLD)))
    return classes, answers


def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc, tag, text, places, flags) of the documents that have answers."""
    texts = pages.filtered(rows.where("doc is not null"), answers, "tag").dropDuplicates(["doc", "tag"])
    return texts.join(answers, ["doc", "tag"]).select("doc", "tag", "text", "places", "flags")
