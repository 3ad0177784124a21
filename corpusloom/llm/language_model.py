"""Scoring documents with a gated recurrent language model, trained here in numpy.

The base score is the add-one unigram score over exact counts of all training tokens. The
model is a gated recurrent unit over a vocabulary of the most frequent words, with a
softmax that is factored into classes of words and words within a class. It is trained by
truncated backpropagation: each task runs through every window of all its training
documents, and rounds of tasks start from the mean of the parameters of the round before,
weighted by tokens. A lane reads whole documents one after another; its state is carried
from window to window and begins anew with a document. Scoring carries the state across
windows, so a document's likelihood is that of its whole text. Texts are numbered once, into
a written table of ids that the rounds and the scoring read. A word outside the vocabulary costs the class of unknown words times its share of
the add-one unigram probability outside, so probabilities sum to one.

Counts: distinct words of a slice are counted before the shuffle. To score, words that are
not among the frequent ones of the broadcast table (a fixed number) are joined with the
counts; those rows are per document and word, so a hot word is not a hot key: it is in the
broadcast table, or rare.

Words are runs of characters other than space and 0x09 to 0x0D with A-Z lower-cased, then
one end. A null text is empty: its end alone is scored. A row with a null id is scored and
not learnt from. Repeated rows are scored each; all copies are learnt from. Without
training tokens, the model knows nothing and scores are the base scores. Words of one count
at the edge of the vocabulary, or of the broadcast table, are taken in alphabetical order. A
very long text is learnt from and scored whole, its state carried from window to window. An
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusloom.llm import arrays, pages
from corpusloom.llm.ship import ship
from corpusloom.session import cut, scan_bytes

END = "\n"  # no word holds it
#: Words of the model's vocabulary, and in the broadcast table of counts.
VOCABULARY = 4096
FREQUENT = 1 << 17
CLASSES = 64
HIDDEN = 24
#: Steps between truncations, lanes trained side by side, rounds.
STEPS, LANES, ROUNDS = 16, 256, 2
RATE = 0.05
#: Share of the lanes that have work, below which long rows wait for more rows.
BUSY = 0.75
#: Weights that are summed up as one row.
BLOCK = 4096
#: Bytes of ids that are learnt from in one go, and of a written table that a task reads,
#: where its files are that large: about what a task has of the texts.
IDS_BYTES, SPLIT_BYTES = 3 << 20, 16 << 20


@dataclass
class Params:
    """Gated recurrent unit with factored output; E: vocabulary and unknown."""

    e: np.ndarray   # words x 3 hidden: input part of the gates, biases included
    u: np.ndarray   # hidden x 3 hidden
    c: np.ndarray   # hidden + 1 x classes
    w: np.ndarray   # classes x hidden + 1 x words of a class

    def arrays(self) -> list[np.ndarray]:
        return [self.e, self.u, self.c, self.w]


def initial(words: int, class_size: int, classes: int, hidden: int) -> Params:
    r = np.random.default_rng(11)
    return Params(*(x.astype(np.float32) for x in (
        r.normal(0, 0.1, (words, 3 * hidden)), r.normal(0, 0.3 / np.sqrt(hidden), (hidden, 3 * hidden)),
        r.normal(0, 0.1, (hidden + 1, classes)), r.normal(0, 0.1, (classes, hidden + 1, class_size)),
    )))


def _step(p: Params, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of all lanes: (new state, update, reset, candidate), lanes by hidden."""
    gates = np.ascontiguousarray(p.e.take(x, axis=0).T)
    k = h.shape[1]
    new = _cell(p.u.T, gates, h.T, np.empty((3 * k, len(h)), np.float32))
    return new.T, gates[:k].T, gates[k:2 * k].T, gates[2 * k:].T


def _cell(ut: np.ndarray, gates: np.ndarray, h: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The new state, hidden by lanes, so that gates are rows side by side. `gates` holds the
    input's part and becomes update, reset and candidate; `inner` takes the state's part."""
    k = len(h)
    np.matmul(ut, h, out=inner)
    # The sigmoid through the hyperbolic tangent, which does not overflow.
    zr, cand = gates[:2 * k], gates[2 * k:]
    zr += inner[:2 * k]
    zr *= np.float32(0.5)
    np.tanh(zr, out=zr)
    zr *= np.float32(0.5)
    zr += np.float32(0.5)
    cand += zr[k:] * inner[2 * k:]
    np.tanh(cand, out=cand)
    new = cand - h
    new *= zr[:k]
    new += h
    return new


def _bounded(weights: np.ndarray) -> bool:
    """States are within -1 and 1: whether no score can be too large or small for exp."""
    return float(np.abs(weights).sum(axis=-2).max()) < 80


def _exp(x: np.ndarray, bounded: bool) -> np.ndarray:
    """exp of the scores in place, as a column's softmax needs it."""
    if not bounded:
        x -= x.max(axis=0)
    return np.exp(x, out=x)


def _with_one(h: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Columns of states, and a row of ones."""
    out = np.ones((len(h) + 1, len(columns)), np.float32)
    np.take(h, columns, axis=1, out=out[:-1], mode="clip")
    return out


def _by_class(cls: np.ndarray, classes: int) -> tuple[np.ndarray, list[int]]:
    """(order of rows by class, where each class ends)."""
    return _order(cls, classes), np.cumsum(np.bincount(cls, minlength=classes)).tolist()


def _order(x: np.ndarray, bound: int) -> np.ndarray:
    """Stable order of numbers below `bound`; short types are sorted by their digits."""
    return np.argsort(x.astype(np.min_scalar_type(bound)), kind="stable")


def log_probabilities(p: Params, h: np.ndarray, y: np.ndarray, of_class: np.ndarray, in_class: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each next word, given the states before it."""
    cls = of_class[y]
    order, ends = _by_class(cls, len(sizes))
    # Rows of a class side by side, so that each class is one product.
    one, word, rows = _with_one(h.T, order), in_class[y[order]], np.arange(len(y))
    scores = p.c.T @ one
    bounded = _bounded(p.c), _bounded(p.w)
    if not bounded[0]:
        scores -= scores.max(axis=0)
    told = scores[cls[order], rows]
    total = np.exp(scores, out=scores).sum(axis=0)
    start = 0
    for c, end in enumerate(ends):
        # The word of a class of one is certain.
        if end > start and sizes[c] > 1:
            inner = p.w[c, :, :sizes[c]].T @ one[:, start:end]
            if not bounded[1]:
                inner -= inner.max(axis=0)
            told[start:end] += inner[word[start:end], rows[:end - start]]
            # Logs of sums apart: their product may be too small or large.
            total[start:end] = np.log(total[start:end]) + np.log(np.exp(inner, out=inner).sum(axis=0))
        else:
            total[start:end] = np.log(total[start:end])
        start = end
    out = np.empty_like(told)
    out[order] = told - total
    return out


def train_window(p: Params, h: np.ndarray, xs: np.ndarray, ys: np.ndarray, live: np.ndarray, of_class, in_class, sizes, rate: float) -> np.ndarray:
    """Truncated backpropagation through one window (steps x lanes); returns the state.
    Arrays are hidden by lanes: gates and states are rows, and sums run along columns."""
    (lanes, k), steps = h.shape, len(xs)
    whole = live.all(axis=1)
    every = bool(whole.all())
    ut = np.ascontiguousarray(p.u.T)
    gates = np.ascontiguousarray(p.e.take(xs, axis=0).transpose(0, 2, 1))
    inner = np.empty_like(gates)
    states = np.empty((steps + 1, k, lanes), np.float32)
    states[0] = h.T
    for t in range(steps):
        new = _cell(ut, gates[t], states[t], inner[t])
        states[t + 1] = new if whole[t] else np.where(live[t], new, states[t])
    at = np.flatnonzero(live)
    n = max(1, len(at))
    scale = np.float32(rate / np.sqrt(n))
    # The output of all steps at once: its gradients need no later step. Columns of a class
    # are side by side; the weights change once all gradients are told.
    y = ys.ravel()[at]
    cls = of_class[y]
    order, ends = _by_class(cls, len(sizes))
    flat = np.ascontiguousarray(states[1:].transpose(1, 0, 2)).reshape(k, -1)
    at_order = at[order]
    one, word, columns = _with_one(flat, at_order), in_class[y[order]], np.arange(len(y))
    d = _exp(p.c.T @ one, _bounded(p.c))
    d *= 1 / d.sum(axis=0)
    d[cls[order], columns] -= 1
    # One more column, of zeros, for what is not read.
    into = np.zeros((k, len(y) + 1), np.float32)
    np.matmul(p.c[:k], d, out=into[:, :-1])
    of_c = one @ d.T
    of_w, bounded, start = np.zeros_like(p.w), _bounded(p.w), 0
    for c, end in enumerate(ends):
        # The word of a class of one is certain: nothing to learn.
        if end > start and sizes[c] > 1:
            own, weights = one[:, start:end], p.w[c, :, :sizes[c]]
            d = _exp(weights.T @ own, bounded)
            d *= 1 / np.add.reduce(d, axis=0)
            d[word[start:end], columns[:end - start]] -= 1
            into[:, start:end] += weights[:k] @ d
            of_w[c, :, :sizes[c]] = own @ d.T
        start = end
    p.c -= scale * np.clip(of_c, -5, 5)
    np.clip(of_w, -5, 5, out=of_w)
    of_w *= scale
    p.w -= of_w
    column = np.full(steps * lanes, len(y))
    column[at_order] = columns
    back = into.take(column, axis=1).reshape(k, steps, lanes)
    # What the gates pass on, for all steps at once.
    z, r, cand = gates[:, :k], gates[:, k:2 * k], gates[:, 2 * k:]
    by_z = cand - states[:-1]
    by_z *= z
    keep = 1 - z
    by_z *= keep
    by_c = cand * cand
    np.subtract(1, by_c, out=by_c)
    by_c *= z
    by_r = 1 - r
    by_r *= r
    by_r *= inner[:, 2 * k:]
    ge = np.empty_like(gates)
    dh = np.zeros((k, lanes), np.float32)
    # Of the last part, what the state's own part of the candidate takes.
    own = inner
    for t in reversed(range(steps)):
        dh += back[:, t]
        dn = dh if whole[t] else dh * live[t]
        g, into = ge[t], own[t]
        np.multiply(dn, by_z[t], out=g[:k])
        dc = np.multiply(dn, by_c[t], out=g[2 * k:])
        np.multiply(dc, by_r[t], out=g[k:2 * k])
        into[:2 * k] = g[:2 * k]
        np.multiply(dc, r[t], out=into[2 * k:])
        after = p.u @ into
        dn = dn * keep[t]
        after += dn
        dh = after if whole[t] else np.where(live[t], after, dh)
    gu = np.matmul(states[:-1], own.transpose(0, 2, 1)).sum(axis=0)
    p.u -= scale * np.clip(gu, -5, 5)
    if len(y):
        np.clip(ge, -1, 1, out=ge)
        by_id = np.ascontiguousarray(ge.transpose(0, 2, 1)).reshape(-1, 3 * k)
        x = xs.ravel() if every else xs.ravel()[at]
        order = _order(x, len(p.e))
        x = x[order]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        p.e[x[first]] -= scale * np.add.reduceat(by_id.take(at[order], axis=0), first, axis=0)
    return states[-1].T


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 7 == 2


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all rows, offsets per row) of texts, A-Z lower-cased, without ends."""
    # Lower-cased before the cast: pyarrow reads the cast of a slice from its first row on.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")).cast(pa.large_string()))
    words, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # White space at the ends of a text leaves empty words.
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), kept[offsets]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) of the training rows, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text", 16 << 20):
            words, _ = _words(batch.column("text"))
            counted = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([counted.field(0).cast(pa.string()), pa.array([END])]),
                pa.concat_arrays([counted.field(1), pa.array([batch.num_rows], pa.int64())]),
            ], names=["word", "n"])

    return rows.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Lexicon:
    """Frequent words with their counts (a bounded number), and the model's classes."""

    known: pa.Array
    counts: np.ndarray
    size: int            # of the model's vocabulary: the first of the known words
    of_class: np.ndarray  # with the unknown word last
    in_class: np.ndarray
    sizes: np.ndarray
    tokens: int
    distinct: int

    @property
    def unknown(self) -> int:
        return self.size

    @property
    def id_type(self) -> np.dtype:
        return np.dtype("<u2" if self.size < 1 << 16 else "<u4")

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Place of each word among the known ones, or -1."""
        coded = words.dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known.cast(coded.dictionary.type)), -1).to_numpy()
        return at[coded.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)


def lexicon(counts: DataFrame, vocabulary: int, frequent: int) -> Lexicon:
    """Totals over all words, and the `frequent` most frequent: a fixed number of rows."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    top = top.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    known = top.column("word").combine_chunks() if top.num_rows else pa.array([], pa.string())
    if isinstance(known, pa.ChunkedArray):
        known = known.chunk(0)
    n = top.column("n").to_numpy() if top.num_rows else np.zeros(0, np.int64)
    size = min(vocabulary, len(n))
    # Classes of like total frequency, by rank; the unknown word is a class of its own.
    share = np.cumsum(np.sqrt(n[:size].astype(float)))
    classes = min(CLASSES - 1, max(1, size))
    cls = np.minimum((share / share[-1] * classes).astype(int), classes - 1) if size else np.zeros(0, int)
    _, cls = np.unique(cls, return_inverse=True)
    cls = np.append(cls, cls.max() + 1 if size else 0)
    sizes = np.bincount(cls)
    within = np.arange(size + 1) - np.concatenate([[0], np.cumsum(sizes)])[cls]
    return Lexicon(known, n, size, cls, within, sizes, int(total["n"]), int(total["v"]))


def _sequence(lex: Lexicon, words: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among the known words with the end of each row, model ids, offsets)."""
    end = lex.lookup(pa.array([END]))[0] if len(lex.known) else -1
    place = np.insert(lex.lookup(words), offsets[1:], end)
    ids = np.where((place >= 0) & (place < lex.size), place, lex.unknown)
    return place, ids, offsets + np.arange(len(offsets))


def _start_from_counts(p: Params, lex: Lexicon) -> None:
    """Biases of the output such that the untrained model is about the unigram model."""
    share = (lex.counts[:lex.size] + 1) / (lex.tokens + lex.distinct + 1)
    share = np.append(share, max(1e-9, 1 - share.sum()))
    per_class = np.bincount(lex.of_class, weights=share)
    p.c[-1] = np.log(per_class)
    p.w[lex.of_class, -1, lex.in_class] = np.log(share / per_class[lex.of_class])


def schedule(length: np.ndarray, lanes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per step, the rows that the lanes read and the window of each: all windows of all
    rows. A lane reads its rows whole, one after another. Long rows are dealt first, each
    to the lane with least to do, and lanes with more to do come first, so that those that
    go on are the first of the step before."""
    windows = -(-length // STEPS)
    order = np.argsort(-windows, kind="stable")
    loads = [(0, lane) for lane in range(min(lanes, len(length)))]
    lane_of, start = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for row in order.tolist():
        load, lane = loads[0]
        lane_of[row], start[row] = lane, load
        heapq.heapreplace(loads, (load + int(windows[row]), lane))
    rank = np.zeros(len(loads), np.int64)
    rank[[lane for _, lane in sorted(loads, key=lambda x: (-x[0], x[1]))]] = np.arange(len(loads))
    row = np.repeat(np.arange(len(length)), windows)
    number = arrays.ranges(windows)
    step = start[row] + number
    order = np.lexsort((rank[lane_of[row]], step))
    cuts = np.cumsum(np.bincount(step))[:-1]
    return list(zip(np.split(row[order], cuts), np.split(number[order], cuts), strict=True))


@dataclass
class Rows:
    """Rows of ids to learn from: where each ends, and the state and id before it."""

    ids: np.ndarray
    ends: np.ndarray     # rows + 1
    state: np.ndarray    # rows x hidden
    before: np.ndarray

    @classmethod
    def fresh(cls, ids: np.ndarray, ends: np.ndarray, hidden: int) -> Rows:
        """Whole documents: the state is zero, and an end came before."""
        n = len(ends) - 1
        end_id = ids[ends[1] - 1] if n else 0
        return cls(ids, ends, np.zeros((n, hidden), np.float32), np.full(n, end_id))

    def joined(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, self.ends[-1] + other.ends[1:]]),
                    np.concatenate([self.state, other.state]), np.concatenate([self.before, other.before]))


def learn(p: Params, lex: Lexicon, rows: Rows, rate: float, last: bool = True) -> tuple[int, Rows]:
    """Trains `p` on the windows of the rows, each row's in order. Where more rows follow
    (not `last`), it stops when few lanes have something left: long rows go on beside the
    next ones. Returns the number of ids seen and what is left, with its states."""
    ids, ends = rows.ids, rows.ends
    length = np.diff(ends)
    windows = -(-length // STEPS)
    done = np.zeros(len(length), np.int64)
    states = rows.state.copy()
    seen, state = 0, np.zeros((LANES, rows.state.shape[1]), np.float32)
    for row, number in schedule(length, LANES) if len(length) else []:
        if not last and len(row) < LANES * BUSY:
            break
        at = ends[:-1][row] + number * STEPS
        cells = at[None, :] + np.arange(STEPS)[:, None]
        live = cells < ends[1:][row][None, :]
        ys = ids[np.minimum(cells, len(ids) - 1)]
        xs = np.roll(ys, 1, axis=0)
        xs[0] = np.where(number == 0, rows.before[row], ids[np.maximum(at - 1, 0)])
        state = np.where((number == 0)[:, None], rows.state[row], state[:len(row)])
        # A step counts by its ids, so that a few long rows at the end do not outweigh the rest.
        n = int(live.sum())
        part = rate * np.sqrt(n / (LANES * STEPS))
        state = train_window(p, state, xs, ys, live, lex.of_class, lex.in_class, lex.sizes, part)
        done[row] = number + 1
        states[row] = state
        seen += n
    left = np.nonzero(done < windows)[0]
    start = ends[:-1][left] + done[left] * STEPS
    size = ends[1:][left] - start
    kept = ids[np.repeat(start, size) + arrays.ranges(size)]
    before = np.where(done[left] == 0, rows.before[left], ids[np.maximum(start - 1, 0)]) if len(ids) else rows.before[left]
    return seen, Rows(kept, np.concatenate([[0], np.cumsum(size)]), states[left], before)


def train(rows: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Params:
    """Parameters after `rounds` rounds over the texts of the training rows."""
    known = rows.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = known.value
        for batch in arrays.slices(batches, "text", 8 << 20):
            _, ids, ends = _sequence(lex, *_words(batch.column("text")))
            yield pa.RecordBatch.from_arrays([_packed(lex, ids, ends)], names=["ids"])

    return train_ids(cut(rows.select("text").mapInArrow(run, "ids binary")), lex, rounds)


def _packed(lex: Lexicon, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Model ids of each row as bytes."""
    flat = ids.astype(lex.id_type)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])


def _unpacked(lex: Lexicon, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(model ids of all rows, offsets per row) of what `_packed` gave."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // lex.id_type.itemsize
    flat = np.frombuffer(column.buffers()[2], lex.id_type)[offsets[0]:offsets[-1]]
    return flat.astype(np.int64), offsets.astype(np.int64) - offsets[0]


def train_ids(rows: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Params:
    """The same over written ids of rows. A task sends its parameters as blocks, which Spark
    averages; the driver gets the mean, whose size is fixed."""
    spark = rows.sparkSession
    p = initial(lex.size + 1, int(lex.sizes.max()), len(lex.sizes), HIDDEN)
    _start_from_counts(p, lex)
    schema = "block int, tokens bigint, weights array<float>"

    for turn in range(rounds):
        start = spark.sparkContext.broadcast((lex, p))

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            lex, p = start.value
            own = Params(*(a.copy() for a in p.arrays()))
            rate = RATE * (0.3 if turn else 1.0)
            seen, left = 0, Rows.fresh(np.zeros(0, np.int64), np.zeros(1, np.int64), HIDDEN)
            for batch in arrays.slices(batches, "ids", IDS_BYTES):
                ids, ends = _unpacked(lex, batch.column("ids"))
                n, left = learn(own, lex, left.joined(Rows.fresh(ids, ends, HIDDEN)), rate, last=False)
                seen += n
            n, _ = learn(own, lex, left, rate)
            seen += n
            if not seen:
                return
            flat = np.concatenate([a.ravel() for a in own.arrays()])
            blocks = np.array_split(flat, -(-len(flat) // BLOCK))
            yield pa.RecordBatch.from_arrays([
                pa.array(range(len(blocks)), pa.int32()), pa.array([seen] * len(blocks), pa.int64()),
                pa.array(blocks, pa.list_(pa.float32())),
            ], names=["block", "tokens", "weights"])

        sent = rows.select("ids").mapInArrow(run, schema)
        # A block of all tasks' weights meets in one task, which sums them up as it reads.
        dealt = sent.repartition(pages.partitions(spark), "block").sortWithinPartitions("block")
        with scan_bytes(spark, SPLIT_BYTES):
            got = dealt.mapInArrow(_mean_blocks, schema).toArrow().sort_by("block")
        if got.num_rows:
            flat, at, parts = got.column("weights").combine_chunks().flatten().to_numpy(), 0, []
            for a in p.arrays():
                parts.append(flat[at:at + a.size].reshape(a.shape).copy())
                at += a.size
            p = Params(*parts)
    return p


def _mean_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each block of weights, by tokens; blocks come one after another."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, tokens, weights in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist(), batch.column("weights"), strict=True):
            values = weights.values.to_numpy().astype(np.float64) * tokens
            if block in sums:
                sums[block][0] += tokens
                sums[block][1] += values
            else:
                sums[block] = [tokens, values]
    yield pa.RecordBatch.from_arrays([
        pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()),
        pa.array([(total / n).astype(np.float32) for n, total in sums.values()], pa.list_(pa.float32())),
    ], names=["block", "tokens", "weights"])


def score_texts(lex: Lexicon, p: Params, ids: np.ndarray, ends: np.ndarray, lanes: int = 1024) -> np.ndarray:
    """Natural log-likelihood of each row's ids, states carried from start to end. Rows of
    like length run side by side; a lane stops when its row ends."""
    length = np.diff(ends)
    out = np.zeros(len(length))
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), lanes):
        rows = order[k:k + lanes]
        h = np.zeros((len(rows), p.u.shape[0]), np.float32)
        x = np.full(len(rows), ids[ends[1] - 1])
        at = ends[:-1][rows]
        left = length[rows]
        states, nexts, owners = [], [], []
        steps = int(left[0])
        for t in range(steps):
            n = int(np.searchsorted(-left, -t, side="left"))
            h, x = h[:n], x[:n]
            h = _step(p, h, x)[0]
            y = ids[at[:n] + t]
            states.append(h)
            nexts.append(y)
            owners.append(rows[:n])
            x = y
            if sum(map(len, nexts)) >= 1 << 13 or t == steps - 1:
                got = log_probabilities(p, np.concatenate(states), np.concatenate(nexts), lex.of_class, lex.in_class, lex.sizes)
                out += np.bincount(np.concatenate(owners), weights=got, minlength=len(out))
                states, nexts, owners = [], [], []
    return out


ENCODED = "n_tokens bigint, n_frequent bigint, base double, outside double, ids binary, rare array<string>"
SCORED = "n_tokens bigint, n_frequent bigint, base double, score double"


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, frequent: int = FREQUENT,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.coalesce(held_out(F.col(id_col)), F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text"),
    )
    of_row = ["row", "doc_id", "held_out"]
    counts = cut(word_counts(rows.where("not held_out")))
    lex = lexicon(counts, vocabulary, frequent)
    known = spark.sparkContext.broadcast(lex)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = known.value
        total = lex.tokens + lex.distinct + 1
        known_log = np.log10((lex.counts + 1) / total)
        # An unknown word costs its class, and its share of what the vocabulary leaves.
        mass = 1 - float(((lex.counts[:lex.size] + 1) / total).sum())
        for batch in arrays.slices(batches, "text", 8 << 20):
            words, offsets = _words(batch.column("text"))
            place, ids, ends = _sequence(lex, words, offsets)
            owner = arrays.owners(ends)
            seen = place >= 0
            shares = np.where(seen, known_log[np.maximum(place, 0)] if len(known_log) else 0.0, 0.0)

            def summed(weights, owner=owner, n=batch.num_rows):
                return np.bincount(owner, weights=weights, minlength=n)

            unknown = ids == lex.unknown
            outside = summed(np.where(unknown, shares, 0.0)) - summed(unknown) * np.log10(mass)
            is_end = np.zeros(len(ids), bool)
            is_end[ends[1:] - 1] = True
            # An end that no training row has.
            lost = summed(is_end & ~seen) * np.log10(1 / total)
            rare = ~seen[~is_end]
            first = np.concatenate([[0], np.cumsum(rare)])[offsets]
            yield pa.RecordBatch.from_arrays([
                *map(batch.column, of_row), pa.array(np.diff(ends)), pa.array(summed(seen).astype(np.int64)),
                pa.array(summed(shares) + lost), pa.array(outside + lost), _packed(lex, ids, ends),
                pa.ListArray.from_arrays(first.astype(np.int32), words.filter(pa.array(rare)).cast(pa.string())),
            ], names=encoded_schema.names)

    # The texts are cut into words once; the rows are numbered from here on.
    encoded_schema = _schema(rows.select(of_row), ENCODED)
    encoded = cut(rows.mapInArrow(encode, encoded_schema))
    model = spark.sparkContext.broadcast((lex, train_ids(encoded.where("not held_out"), lex)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, p = model.value
        for batch in arrays.slices(batches, "ids", IDS_BYTES):
            model_score = score_texts(lex, p, *_unpacked(lex, batch.column("ids"))) / np.log(10)
            yield pa.RecordBatch.from_arrays([
                *map(batch.column, [*of_row, "n_tokens", "n_frequent", "base"]), pa.array(model_score + batch.column("outside").to_numpy()),
            ], names=scored_schema.names)

    scored_schema = _schema(rows.select(of_row), SCORED)
    with scan_bytes(spark, SPLIT_BYTES):
        scored = cut(encoded.drop("rare").mapInArrow(run, scored_schema))
    # Per document and distinct rare word.
    asked = encoded.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    found = asked.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(lex.tokens + lex.distinct + 1)))).alias("more"),
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("more_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(lex.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def _schema(rows: DataFrame, more: str) -> StructType:
    """The columns of `rows` and further ones; any may be null."""
    fields = [*rows.schema, *StructType.fromDDL(more)]
    return StructType([StructField(f.name, f.dataType) for f in fields])
