"""Substring dedup on bytes, by distributed difference-cover suffix sorting.

Suffixes of all texts cannot be sorted in one place, nor need they be: equal windows of
50 bytes must meet. Each window has an anchor, a 30-byte string chosen by its content alone
(the place of the smallest 9-byte hash in it, modulo 21). Windows whose anchor only one
document has are out. For the others, a context of 60 bytes holds 11 windows, and contexts
meet in buckets by the 40 bytes that all their windows share. A bucket sorts the suffixes
of its contexts by the difference cover (see `suffixes`), and compares the 50-byte
prefixes of adjacent suffixes, byte by byte: no hash decides.

A byte is removed if a window that covers it also starts in a document with a smaller id.
A null text is empty. See `overlap` for ties, repeated rows and null ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays, overlap, suffixes
from corpusloom.llm.ship import ship

WINDOW = 50
_SMALL = 9    # bytes whose hash chooses
_STEP = 11    # windows of a context
# Symbols sorted at once: a bucket is sorted in parts, in which equal windows stay together.
_AT_ONCE = 1 << 18


def _anchors_of(raw: np.ndarray, offsets: np.ndarray, window: int):
    """(window starts, owner row, anchor start) for every whole window."""
    period = (window - _SMALL + 1) // 2
    at = arrays.whole_windows(offsets, window)
    if not len(at):
        return at, np.zeros(0, np.int32), at
    n = len(raw) - _SMALL + 1
    prefix = arrays.prefix_hashes(raw)
    every = np.arange(n)
    small = arrays.range_hashes(prefix, every, every + _SMALL)
    # Hash above, place below: the least has the smallest hash, and of equal ones is leftmost.
    bits = np.uint64(max(1, int(n).bit_length()))
    least = (small >> bits << bits) | every.astype(np.uint64)
    span, width = window - _SMALL + 1, 1
    while width < span:
        by = min(width, span - width)
        least = np.minimum(least[:len(least) - by], least[by:])
        width += by
    chosen = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at, arrays.owners(offsets)[at], at + (chosen - at) % period


def method(window: int = WINDOW) -> overlap.Method:
    if window < 2 * _SMALL + 2 * _STEP:
        raise ValueError("the window is too short for anchors")
    period = (window - _SMALL + 1) // 2
    length = window - period + 1
    width = window + _STEP - 1

    def anchors(raw, offsets):
        _, owner, anchor = _anchors_of(raw, offsets, window)
        first = np.ones(len(anchor), bool)
        first[1:] = anchor[1:] != anchor[:-1]
        anchor, owner = anchor[first], owner[first]
        _, once = np.unique(anchor, return_index=True)
        anchor, owner = anchor[once], owner[once]
        hashes = arrays.range_hashes(arrays.prefix_hashes(raw), anchor, anchor + length)
        return hashes, owner, anchor - offsets[owner]

    def contexts(raw, offsets, owner, places):
        at, row, anchor = _anchors_of(raw, offsets, window)
        shared = np.zeros(len(raw) + 1, bool)
        shared[places + offsets[owner]] = True
        asked = shared[anchor]
        at, row, anchor = at[asked], row[asked], anchor[asked]
        # Windows of one anchor whose offsets fall into one step make a context.
        step = (anchor - at) // _STEP
        base = anchor - step * _STEP - (_STEP - 1)
        order = np.lexsort((at, base))
        at, row, base = at[order], row[order], base[order]
        new = np.ones(len(at), bool)
        new[1:] = base[1:] != base[:-1]
        group = np.cumsum(new) - 1
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(at)) - 1
        flags = np.zeros(len(first), np.uint16)
        np.bitwise_or.at(flags, group, (1 << (at - base[first[group]])).astype(np.uint16))
        base, row = base[first], row[first]
        # Only the bytes of windows that are asked for; the rest is zero.
        low, high = at[first], at[last] + window
        cells = base[:, None] + np.arange(width)[None, :]
        inside = (cells >= low[:, None]) & (cells < high[:, None])
        keys = np.where(inside, raw[np.clip(cells, 0, len(raw) - 1)], 0).astype(np.uint8)
        core = arrays.range_hashes(arrays.prefix_hashes(raw), base + _STEP - 1, base + window)
        # The place may lie before the text; it is kept from its row's start plus a step.
        return overlap.Contexts(keys, core, row, base - offsets[row] + _STEP, flags)

    def decide(keys, flags, docs):
        return _decide(keys, flags, docs, window)

    return overlap.Method(anchors, contexts, decide, width)


def _decide(keys: np.ndarray, flags: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Bits of the windows of each context that a smaller document has, too."""
    width = keys.shape[1]
    packed = np.ascontiguousarray(keys).view(f"V{width}").ravel()
    code = overlap.fixed_width(packed).dictionary_encode().indices.to_numpy()
    _, first = np.unique(code, return_index=True)
    distinct = keys[first]
    # Smallest document per context and window; the largest number where none asks.
    none = np.iinfo(np.int64).max
    smallest = np.full((len(distinct), _STEP), none)
    for k in range(_STEP):
        asks = np.nonzero(flags >> k & 1)[0]
        np.minimum.at(smallest[:, k], code[asks], docs[asks])
    flat = smallest.ravel()
    for part in _parts(distinct):
        if len(part) * (width + 1) > 4 * _AT_ONCE:
            _by_ends(distinct, part, smallest)
            continue
        symbols = np.zeros((len(part), width + 1), np.int64)
        symbols[:, :width] = distinct[part].astype(np.int64) + 2
        symbols[:, width] = 1
        text = symbols.ravel()
        rank = suffixes.ranks(text, window)
        # Suffixes at which a window starts, in order.
        begin = np.arange(len(part))[:, None] * (width + 1) + np.arange(_STEP)[None, :]
        which = (part[:, None] * _STEP + np.arange(_STEP)[None, :]).ravel()
        used = flat[which] != none
        begin, which = begin.ravel()[used], which[used]
        order = np.argsort(rank[begin])
        begin, which = begin[order], which[order]
        if not len(which):
            continue
        # Adjacent prefixes, compared symbol by symbol while they agree.
        pair = np.arange(len(begin) - 1)
        for k in range(window):
            pair = pair[text[begin[pair] + k] == text[begin[pair + 1] + k]]
        new = np.ones(len(begin), bool)
        new[pair + 1] = False
        starts = np.nonzero(new)[0]
        flat[which] = np.minimum.reduceat(flat[which], starts)[np.cumsum(new) - 1]
    told = np.zeros(len(keys), np.uint16)
    for k in range(_STEP):
        told |= (((flags >> k) & 1) * (smallest[code, k] < docs)).astype(np.uint16) << k
    return told


def _by_ends(distinct: np.ndarray, part: np.ndarray, smallest: np.ndarray) -> None:
    """For very many contexts with the same shared bytes: windows at one place are equal
    if the few bytes before and after those are, and the rest of the context is not asked."""
    width = distinct.shape[1]
    for k in range(_STEP):
        ends = np.zeros((len(part), 16), np.uint8)
        ends[:, :_STEP - 1 - k] = distinct[part, k:_STEP - 1]
        ends[:, _STEP - 1 - k:_STEP - 1] = distinct[part, width - _STEP + 1:width - _STEP + 1 + k]
        packed = ends.view(np.uint64)
        order = np.lexsort((packed[:, 1], packed[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (packed[order][1:] != packed[order][:-1]).any(axis=1)
        values = smallest[part[order], k]
        least = np.minimum.reduceat(values, np.nonzero(new)[0])[np.cumsum(new) - 1]
        smallest[part[order], k] = np.where(values == np.iinfo(np.int64).max, values, least)


def _parts(distinct: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of contexts that are sorted together: those with equal shared bytes
    stay together, also where they alone are more than is sorted at once. A context whose
    shared bytes no other has is left out: none of its windows equals another's."""
    width = distinct.shape[1]
    most = max(1, _AT_ONCE // (width + 1))
    core = np.ascontiguousarray(distinct[:, _STEP - 1:width - _STEP + 1])
    rows = core.view(f"V{core.shape[1]}").ravel()
    code = overlap.fixed_width(rows).dictionary_encode().indices.to_numpy()
    sizes = np.bincount(code)
    order = np.argsort(code, kind="stable")
    order = order[sizes[code[order]] > 1]
    ends = np.cumsum(np.where(sizes > 1, sizes, 0))
    start = 0
    while start < len(order):
        k = int(np.searchsorted(ends, start + most, side="right"))
        end = int(ends[k - 1]) if k and ends[k - 1] > start else int(ends[np.searchsorted(ends, start, side="right")])
        yield order[start:end]
        start = end


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_bytes: bool = True,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes or kept_sha256) for every row.

    Kept bytes are binary: what is left need not be whole characters.
    """
    ship(docs.sparkSession)
    rows = overlap.keyed(docs, id_col, text_col)
    classes, answers = overlap.repeated_windows(rows, method(window))
    kind = "binary" if with_bytes else "string"
    schema = f"doc bigint, tag bigint, _n bigint, _spans bigint, _kept {kind}"

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text"):
            raw, offsets = arrays.text_bytes(batch.column("text"))
            starts = []
            for k, (places, flags) in enumerate(zip(
                batch.column("places").to_pylist(), batch.column("flags").to_pylist(), strict=True
            )):
                base = np.frombuffer(places, "<u4").astype(np.int64) - _STEP + offsets[k]
                bits = np.frombuffer(flags, np.uint16)
                starts += [base[bits >> j & 1 == 1] + j for j in range(_STEP)]
            removed = arrays.covered(np.concatenate(starts), window, len(raw))
            found = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                gone = removed[a:b]
                kept = raw[a:b][~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                found.append((int(gone.sum()), spans, kept if with_bytes else hashlib.sha256(kept).hexdigest()))
            n, spans, kept = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(spans, pa.int64()),
                pa.array(kept, pa.binary() if with_bytes else pa.string()),
            ], names=[x.split()[0] for x in schema.split(", ")])

    changed = overlap.with_answers(rows, answers).mapInArrow(cleaned, schema)
    copies = classes.where("doc > first").select("doc", "tag", F.lit(True).alias("_copy")).distinct()
    content = F.col("text").cast("binary")
    whole = rows.select("doc", "tag", F.octet_length("text").cast("bigint").alias("n_bytes"),
                        (content if with_bytes else F.sha2(content, 256)).alias("_whole"))
    every = whole.join(changed, ["doc", "tag"], "left").join(copies, ["doc", "tag"], "left")
    gone = F.coalesce(F.col("_copy"), F.lit(False)) & (F.col("n_bytes") >= window)
    nothing = F.lit("").cast("binary") if with_bytes else F.sha2(F.lit("").cast("binary"), 256)
    return every.select(
        F.col("doc").alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("_kept", "_whole")).alias("kept" if with_bytes else "kept_sha256"),
    )
