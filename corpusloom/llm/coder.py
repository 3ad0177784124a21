"""A context-mixing range coder for token ids, in numpy.

A block is coded by many lanes in step: each lane codes one run of the block's ids, and
all lanes share the block's models, which learn from every lane after each step. So
the work per step is a few vector operations, and blocks depend on nothing else.

An id is predicted by the id last seen after its two predecessors (order 2), by the one
last seen after its predecessor (order 1), and by id frequencies (order 0). Weights of
the three are counts kept for each pair of confidences. Arithmetic is on integers only,
so any machine decodes what any other has encoded.
"""

from __future__ import annotations

import numpy as np

MAX_LANES, MIN_STEPS = 2048, 64
GATE_BITS = 10
MAX_IDS = 1 << 18
_CONTEXTS = 1 << 17
_TOP = 15
_WORD = np.uint64(32)
_TOTAL = 1 << GATE_BITS


def lanes_of(n: int) -> tuple[int, int]:
    """(lanes, steps) for `n` ids; the last lanes may be shorter, or empty."""
    lanes = max(1, min(MAX_LANES, n // MIN_STEPS))
    return lanes, -(-n // lanes)


class Model:
    """Predictions for one step of all lanes, and learning from what came."""

    def __init__(self, n_ids: int):
        self.n_ids = n_ids
        self.scale = 18 if n_ids <= 1 << 16 else 20
        self.counts = np.zeros(n_ids, np.int64)
        # Per context: the id seen last, and in the low four bits how sure that is.
        self.guess1 = np.zeros(n_ids + 1, np.int32)
        self.guess2 = np.zeros(_CONTEXTS, np.int32)
        self.gates = np.ones((2 * (_TOP + 1) ** 2, 3), np.int64)
        self.seen: list[np.ndarray] = []
        self.outcomes: list[np.ndarray] = []
        self.step, self.due = 0, 1
        self._frequencies()
        self._weights()

    def _frequencies(self) -> None:
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.n_ids)
            self.seen = []
        size, total = 1 << self.scale, max(1, int(self.counts.sum()))
        freq = 1 + self.counts * (size - self.n_ids) // total
        freq[int(np.argmax(self.counts))] += size - int(freq.sum())
        self.freq0, self.low0 = freq.astype(np.int32), (np.cumsum(freq) - freq).astype(np.int32)
        self.id_at = None

    def slots(self) -> np.ndarray:
        """The id of each order-0 slot, for decoding."""
        if self.id_at is None:
            self.id_at = np.repeat(np.arange(self.n_ids, dtype=np.int32), self.freq0)
        return self.id_at

    def predict(self, before1: np.ndarray, before2: np.ndarray) -> None:
        self.at1 = before1
        self.at2 = ((before1 * 0x9E3779B1 + before2 * 0x85EBCA6B) & 0xFFFFFFFF) >> 15
        known1, known2 = self.guess1.take(self.at1), self.guess2.take(self.at2)
        self.p1, self.p2 = known1 >> 4, known2 >> 4
        self.c1, self.c2 = known1 & _TOP, known2 & _TOP
        self.gate = ((self.c2 << 4) + self.c1 << 1) + (self.p1 == self.p2)
        self.f2, self.both = self.width2.take(self.gate), self.width12.take(self.gate)

    def _weights(self) -> None:
        total = self.gates.sum(axis=1)
        self.width2 = 1 + self.gates[:, 0] * (_TOTAL - 3) // total
        self.width12 = self.width2 + 1 + self.gates[:, 1] * (_TOTAL - 3) // total

    def interval(self, x: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, width) of ids within 2 ** (GATE_BITS + scale); hit: 0, 1 by order 2, 1."""
        low = self.f2 * (hit == 1) << self.scale
        width = np.where(hit == 0, self.f2, self.both - self.f2) << self.scale
        at = np.nonzero(hit == 2)[0]
        both, miss = self.both[at], x[at]
        low[at] = (both << self.scale) + (_TOTAL - both) * self.low0.take(miss)
        width[at] = (_TOTAL - both) * self.freq0.take(miss)
        return low.view(np.uint64), width.view(np.uint64)

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        x = x.astype(np.int32)
        for table, at, p, c in (
            (self.guess1, self.at1, self.p1, self.c1), (self.guess2, self.at2, self.p2, self.c2)
        ):
            right = p == x
            kept = np.where(right, np.minimum(c + 1, _TOP), c >> 1) + (p << 4)
            table[at] = np.where(right | (c > 2), kept, (x << 4) + 1)
        self.outcomes.append(self.gate * 3 + hit)
        self.seen.append(x)
        self.step += 1
        if self.step & 3 == 0 or self.step < 4:
            n = len(self.gates) * 3
            self.gates += np.bincount(np.concatenate(self.outcomes), minlength=n).reshape(-1, 3)
            self.outcomes = []
            self._weights()
        if self.step == self.due:
            self.due += min(self.due, 32)
            self._frequencies()


def _settle(low, size):
    """Lanes whose upper word is settled, or whose interval straddles one for too long."""
    fixed = (low ^ (low + size)) >> _WORD == 0
    short = size >> _WORD == 0
    short &= ~fixed
    if not short.any():
        return fixed, size
    size = np.where(short, (~low + np.uint64(1)) & np.uint64(0xFFFFFFFF), size)
    return fixed | short, size


def encode(ids: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of all lanes one after another as uint32, words per lane)."""
    lanes, steps = lanes_of(len(ids))
    grid = np.zeros(lanes * steps, np.int64)
    grid[:len(ids)] = ids
    grid = grid.reshape(lanes, steps).T.copy()
    model = Model(n_ids)
    bits = np.uint64(GATE_BITS + model.scale)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    before1 = np.full(lanes, n_ids, np.int64)
    before2 = before1.copy()
    out_lane, out_word = [], []
    for t in range(steps):
        k = -(-(len(ids) - t) // steps)
        x = grid[t, :k]
        model.predict(before1[:k], before2[:k])
        hit = np.where(model.p2 == x, 0, np.where(model.p1 == x, 1, 2))
        start, width = model.interval(x, hit)
        part = size[:k] >> bits
        lo = low[:k] + part * start
        sz = part * width
        out, sz = _settle(lo, sz)
        at = np.nonzero(out)[0]
        out_lane.append(at)
        out_word.append((lo[at] >> _WORD).astype(np.uint32))
        lo[at] <<= _WORD
        sz[at] <<= _WORD
        low[:k], size[:k] = lo, sz
        model.learn(x, hit)
        before2[:k], before1[:k] = before1[:k], x
    every = np.arange(lanes)
    lane = np.concatenate([*out_lane, every, every])
    word = np.concatenate([*out_word, (low >> _WORD).astype(np.uint32),
                           (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)])
    order = np.argsort(lane, kind="stable")
    return word[order], np.bincount(lane, minlength=lanes).astype(np.uint32)


def decode(word: np.ndarray, per_lane: np.ndarray, n: int, n_ids: int) -> np.ndarray:
    """The `n` ids again."""
    lanes, steps = lanes_of(n)
    if lanes != len(per_lane) or int(per_lane.sum()) != len(word):
        raise ValueError("lanes do not match the block")
    word = np.append(word, np.uint32(0)).astype(np.uint64)
    at = np.cumsum(per_lane.astype(np.int64)) - per_lane
    code = (word[at] << _WORD) | word[at + 1]
    at += 2
    model = Model(n_ids)
    bits = np.uint64(GATE_BITS + model.scale)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    before1 = np.full(lanes, n_ids, np.int64)
    before2 = before1.copy()
    grid = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        k = -(-(n - t) // steps)
        model.predict(before1[:k], before2[:k])
        part = size[:k] >> bits
        value = np.minimum((code[:k] - low[:k]) // part, np.uint64((1 << int(bits)) - 1)).view(np.int64)
        level = value >> model.scale
        hit = (level >= model.f2).astype(np.int64) + (level >= model.both)
        x = np.where(hit == 0, model.p2, model.p1).astype(np.int64)
        at0 = np.nonzero(hit == 2)[0]
        both = model.both[at0]
        slot = (value[at0] - (both << model.scale)).view(np.uint64) // (_TOTAL - both).view(np.uint64)
        x[at0] = model.slots().take(slot.view(np.int64))
        start, width = model.interval(x, hit)
        lo = low[:k] + part * start
        sz = part * width
        out, sz = _settle(lo, sz)
        moved = np.nonzero(out)[0]
        code[moved] = (code[moved] << _WORD) | word[np.minimum(at[moved], len(word) - 1)]
        at[moved] += 1
        lo[moved] <<= _WORD
        sz[moved] <<= _WORD
        low[:k], size[:k] = lo, sz
        grid[t, :k] = x
        model.learn(x, hit)
        before2[:k], before1[:k] = before1[:k], x
    return grid.T.reshape(-1)[:n].astype(np.uint32)
