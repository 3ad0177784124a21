"""Sum-of-squares packing of documents into windows of a fixed number of tokens.

A document of more than a window gives full windows; the rest goes online to the fill
level whose use leaves the smallest sum of squared counts of partly filled windows, kept
in an array of counts per level. A piece may be cut to fill a window, at a price. When a
task's documents have ended, the emptiest windows are taken apart and placed by the same
array until one is left, which is cut at powers of two, which need no padding. A task packs
what it reads, with memory bounded by its few open windows: no document moves, and a hot
source is as any other.

A null or empty text is its end id. Equal ids are packed each; of equal choices the fullest
window is taken. A very long text gives full windows as it is read. An empty table gives an
empty table; other columns are not read. A window never holds ids of two tasks, so a task
that runs again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import slices
from corpusloom.llm.ship import ship
from corpusloom.llm.tokens import END_ID, encoder

WINDOW = 4096
#: Levels of fill that are counted, and what a cut costs in units of the sum of squares.
LEVELS, CUT_PRICE = 8, 1.5
PIECES = "doc_id bigint, start bigint, length bigint, {content}, doc_tokens bigint, sequence_id bigint, offset bigint"


class Levels:
    """Open windows, and an array of how many there are at each level of fill.

    A piece goes where the sum of the squared counts grows least: to a new window, to an
    open one it fits, or to one that it fills, by being cut. A cut has a price, so that a
    piece is cut only where counts would grow otherwise. The counts bound the open windows
    to a few per level.
    """

    def __init__(self, window: int, levels: int = LEVELS, price: float = CUT_PRICE):
        self.window, self.step, self.price = window, max(1, window // levels), price
        self.counts = np.zeros(window // self.step + 1, np.int64)
        self.open: list[list] = []   # [fill, pieces]

    def _choice(self, size: int, price: float, opening: bool) -> list | None:
        """The open window that a piece goes to; None for a new one."""
        counts, step = self.counts, self.step
        best, chosen = (2 * counts[size // step] + 1 if opening else np.inf, 0), None
        for one in self.open:
            fill = one[0]
            level, after = fill // step, fill + size
            if after < self.window:
                moved = after // step
                growth = 0 if moved == level else 2 - 2 * counts[level] + 2 * counts[moved]
            else:
                growth = 1 - 2 * counts[level]
                if after > self.window:
                    # What is left is counted as a window of its own.
                    left = (after - self.window) // step
                    growth += 2 * (counts[left] - (left == level)) + 1 + price
            # Of equal choices the fullest.
            if (growth, -fill) < best:
                best, chosen = (growth, -fill), one
        return chosen

    def place(self, key, start: int, length: int, price: float | None = None, opening: bool = True) -> Iterator[list]:
        """Place a piece; yields the pieces of the windows that are full by it."""
        price = self.price if price is None else price
        while length:
            one = self._choice(length, price, opening) if length < self.window else None
            if one is None:
                one = [0, []]
                self.open.append(one)
            else:
                self.counts[one[0] // self.step] -= 1
            k = min(length, self.window - one[0])
            one[0] += k
            one[1].append((key, start, k))
            start, length = start + k, length - k
            if one[0] == self.window:
                # The one that was chosen, not one that is equal to it.
                self.open = [other for other in self.open if other is not one]
                yield one[1]
            else:
                self.counts[one[0] // self.step] += 1

    def drain(self) -> Iterator[list]:
        """Close what is open: the emptiest window is taken apart and its pieces are placed
        in the others, with cuts for nothing, until one window is left."""
        while len(self.open) > 1:
            least = min(self.open, key=lambda one: one[0])
            self.open = [other for other in self.open if other is not least]
            self.counts[least[0] // self.step] -= 1
            for piece in least[1]:
                yield from self.place(*piece, price=0.0, opening=False)


def powers_of_two(pieces: list) -> Iterator[list]:
    """The pieces of the last window as windows of powers of two, which need no padding."""
    now = list(pieces)
    fill = sum(length for _, _, length in now)
    for bit in (1 << b for b in reversed(range(fill.bit_length()))):
        if fill & bit:
            part, need = [], bit
            while need:
                key, start, length = now[0]
                k = min(length, need)
                part.append((key, start, k))
                need -= k
                now[0:1] = [(key, start + k, length - k)] if length > k else []
            yield part


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """(doc_id, start, length, ids or ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    ship(docs.sparkSession)
    content = "ids binary" if with_ids else "ids_crc32 bigint"
    schema = PIECES.format(content=content)
    rows = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        encode, levels = encoder(tokenizer).encode, Levels(window)
        fields: list[list] = [[] for _ in range(7)]

        def put(pieces):
            nonlocal sequence
            at = 0
            for key, start, length in pieces:
                doc, base, raw, total = key
                ids = raw[4 * (start - base):4 * (start - base + length)]
                for field, value in zip(fields, (
                    doc, start, length, ids.tobytes() if with_ids else zlib.crc32(ids), total, sequence, at,
                ), strict=True):
                    field.append(value)
                at += length
            sequence += 1

        def flush():
            nonlocal fields
            types = [pa.int64()] * 3 + [pa.binary() if with_ids else pa.int64()] + [pa.int64()] * 3
            batch = pa.RecordBatch.from_arrays(
                [pa.array(f, t) for f, t in zip(fields, types, strict=True)],
                names=[x.split()[0] for x in schema.split(", ")])
            fields = [[] for _ in range(7)]
            return batch

        for batch in slices(batches, "t", 4 << 20):
            ids, offsets = encode(batch.column("t"), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = offsets.tolist()
            for k, doc in enumerate(batch.column("d").to_pylist()):
                a, total = ends[k], ends[k + 1] - ends[k]
                key = (doc, 0, raw[4 * a:4 * (a + total)], total)
                whole = total - total % window
                for start in range(0, whole, window):
                    put([(key, start, window)])
                if total > whole:
                    # An open window keeps its own bytes only, not those of the slice.
                    kept = (doc, whole, memoryview(key[2][4 * whole:].tobytes()), total)
                    for full in levels.place(kept, whole, total - whole):
                        put(full)
            yield flush()
        for full in levels.drain():
            put(full)
        for one in levels.open:
            for part in powers_of_two(one[1]):
                put(part)
        if fields[0]:
            yield flush()

    return rows.mapInArrow(run, schema)
