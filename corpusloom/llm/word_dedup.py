"""Substring dedup on words, by difference-cover anchors.

A window is a run of words. Anchors are shorter runs from the word positions that lie in a
difference cover modulo a period: for any two positions there is a shift below the period
that puts both into the cover. So of two equal windows some aligned anchors are equal,
although only three of seven positions are hashed. Windows around shared anchors are then
compared whole, by a digest of 96 bits.

A word is removed if a window that covers it also starts in a document with a smaller id.
An empty or null text has no words. See `overlap` for ties, repeated rows and null ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays, overlap
from corpusloom.llm.ship import ship

WINDOW = 13
# Differences of members of the cover are all residues of the period.
PERIOD, COVER = 7, (1, 2, 4)

#: Bytes of text at a time: a word has more arrays than a byte of it.
SLICE = 1 << 20

def _hashed(raw: np.ndarray, offsets: np.ndarray, seed: int = 0):
    starts, ends, rows = arrays.words(raw, offsets)
    return arrays.word_hashes(raw, starts, ends, seed), rows


def method(window: int = WINDOW) -> overlap.Method:
    width = window - PERIOD + 1
    if width < 1:
        raise ValueError(f"a window needs at least {PERIOD} words")

    def anchors(raw, offsets):
        hashes, rows = _hashed(raw, offsets)
        at = arrays.whole_windows(rows, width)
        owner = arrays.owners(rows)[at]
        place = at - rows[owner]
        # An anchor only helps a document that has a whole window.
        used = np.isin(place % PERIOD, COVER) & (np.diff(rows)[owner] >= window)
        return arrays.window_hashes(hashes, width)[at[used]], owner[used], place[used]

    def contexts(raw, offsets, owner, places):
        hashes, rows = _hashed(raw, offsets)
        more, _ = _hashed(raw, offsets, seed=1)
        starts = (places[:, None] - np.arange(PERIOD)[None, :]).ravel()
        owner = np.repeat(owner, PERIOD)
        fits = (starts >= 0) & (starts + window <= np.diff(rows)[owner])
        at = np.unique(starts[fits] + rows[owner[fits]])
        row = arrays.owners(rows)[at]
        one = arrays.window_hashes(hashes, window)[at]
        two = arrays.window_hashes(more, window)[at]
        keys = np.concatenate([
            one[:, None].view(np.uint8).reshape(-1, 8),
            two.astype(np.uint32)[:, None].view(np.uint8).reshape(-1, 4)], axis=1)
        return overlap.Contexts(keys, one, row, at - rows[row], np.ones(len(at), np.uint16))

    return overlap.Method(anchors, contexts, _decide, 12, SLICE)


def _decide(keys: np.ndarray, flags: np.ndarray, docs: np.ndarray) -> np.ndarray:
    one = np.ascontiguousarray(keys[:, :8]).view(np.uint64).ravel()
    two = np.ascontiguousarray(keys[:, 8:]).view(np.uint32).ravel()
    order = np.lexsort((docs, two, one))
    one, two, ranked = one[order], two[order], docs[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    smallest = ranked[np.nonzero(new)[0]][np.cumsum(new) - 1]
    told = np.zeros(len(order), np.uint16)
    told[order] = ranked > smallest
    return told


def _kept_words(raw: np.ndarray, offsets: np.ndarray, removed: np.ndarray | None):
    """(words, removed words, kept words joined by a space) per row."""
    starts, ends, rows = arrays.words(raw, offsets)
    data = raw.tobytes()
    for k in range(len(offsets) - 1):
        a, b = int(rows[k]), int(rows[k + 1])
        if removed is None:
            text = b" ".join(data[offsets[k]:offsets[k + 1]].split())
            yield b - a, 0, text
        else:
            kept = np.nonzero(~removed[a:b])[0] + a
            yield b - a, b - a - len(kept), b" ".join(
                [data[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)])


CLEAN = "doc bigint, tag bigint, n_words bigint, n_removed bigint, kept {kind}"


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept text or kept_sha256) for every row."""
    ship(docs.sparkSession)
    rows = overlap.keyed(docs, id_col, text_col)
    classes, answers = overlap.repeated_windows(rows, method(window))
    schema = CLEAN.format(kind="string")

    def content(text: bytes) -> str:
        return text.decode() if with_text else hashlib.sha256(text).hexdigest()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text", SLICE):
            found = [(n, r, content(t)) for n, r, t in _kept_words(*arrays.text_bytes(batch.column("text")), None)]
            yield _rows(batch, found)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text", SLICE):
            raw, offsets = arrays.text_bytes(batch.column("text"))
            _, _, word_rows = arrays.words(raw, offsets)
            starts = [np.unique(np.frombuffer(p, "<u4")) + word_rows[k]
                      for k, p in enumerate(batch.column("places").to_pylist())]
            removed = arrays.covered(np.concatenate(starts).astype(np.int64), window, int(word_rows[-1]))
            yield _rows(batch, [(n, r, content(t)) for n, r, t in _kept_words(raw, offsets, removed)])

    def _rows(batch, found):
        n, removed, text = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(text, pa.string())], names=[x.split()[0] for x in schema.split(", ")])

    changed = overlap.with_answers(rows, answers).mapInArrow(cleaned, schema).select(
        "doc", "tag", F.col("n_removed").alias("_n"), F.col("kept").alias("_kept"))
    copies = classes.where("doc > first").select("doc", "tag", F.lit(True).alias("_copy")).distinct()
    every = rows.mapInArrow(whole, schema).join(changed, ["doc", "tag"], "left").join(copies, ["doc", "tag"], "left")
    # A copy long enough for a window is covered from end to end.
    gone = F.coalesce(F.col("_copy"), F.lit(False)) & (F.col("n_words") >= window)
    nothing = F.lit("") if with_text else F.sha2(F.lit(""), 256)
    return every.select(
        F.col("doc").alias("doc_id"), "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, nothing).otherwise(F.coalesce("_kept", "kept")).alias("kept" if with_text else "kept_sha256"),
    )
