"""The language model and the pipeline, against plain Python."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import language_model as lm
from corpusloom.llm import secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [lm.END]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    nouns, verbs = [f"noun{k}" for k in range(30)], [f"verb{k}" for k in range(30)]
    out = []
    for k in range(300):
        words = [(nouns if j % 2 else verbs)[int(r.integers(30))] for j in range(int(r.integers(0, 60)))]
        out.append((k, " ".join(words), "en", f"s{k % 4}", 5))
    return out + [(1001, None, None, None, None), (1002, " \n", "en", "s1", 1), (1003, "Rare WORDS\tonly here", "en", "s", 2),
                  (None, "noun1 verb1", "en", "s", 2), out[5]]


def test_scores(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lm.score(docs, vocabulary=40, frequent=50).collect()
    assert len(got) == len(rows)
    counts = collections.Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t, *_ in rows:
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t))
        want[i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(base, 6)] += 1
    assert want == collections.Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 for r in got)


def test_model_learns_order():
    """Nouns follow verbs: more training, a better score of held-out windows."""
    r = np.random.default_rng(1)
    cls, within, sizes = np.array([0] * 10 + [1] * 10), np.tile(np.arange(10), 2), np.array([10, 10])
    p = lm.initial(20, 10, 2, 12)

    def window():
        x = np.arange(17)[:, None] % 2 * 10 + r.integers(0, 10, (17, 32))
        return x[:-1], x[1:]

    xs, ys = window()

    def loss():
        h, out = np.zeros((32, 12), np.float32), 0.0
        for x, y in zip(xs, ys, strict=True):
            h = lm._step(p, h, x)[0]
            out -= lm.log_probabilities(p, h, y, cls, within, sizes).mean()
        return out / len(xs)

    first = loss()
    for _ in range(150):
        a, b = window()
        lm.train_window(p, np.zeros((32, 12), np.float32), a, b, np.ones(a.shape, bool), cls, within, sizes, 0.05)
    assert loss() < first - 0.3


def test_probabilities_sum_to_one():
    cls, within, sizes = np.array([0, 0, 1, 1, 1]), np.array([0, 1, 0, 1, 2]), np.array([2, 3])
    p = lm.initial(5, 3, 2, 4)
    h = np.random.default_rng(0).normal(size=(1, 4)).astype(np.float32)
    every = [lm.log_probabilities(p, h, np.array([y]), cls, within, sizes)[0] for y in range(5)]
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)


def test_state_is_carried():
    """A long row scores the same alone and beside others, in one go or many."""
    import pyarrow as pa

    lex = lm.Lexicon(pa.array(["a", "b"]), np.array([3, 2]), 2, np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([2, 1]), 5, 2)
    p = lm.initial(3, 2, 2, 4)
    r = np.random.default_rng(4)
    long = r.integers(0, 3, 40_000)
    short = r.integers(0, 3, 7)
    short[-1] = long[-1]
    alone = lm.score_texts(lex, p, long, np.array([0, len(long)]))
    both = lm.score_texts(lex, p, np.concatenate([long, short]), np.array([0, len(long), len(long) + 7]))
    assert both[0] == pytest.approx(alone[0], rel=1e-6)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.score(empty).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_pipeline(spark, rows, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    more = [(2000 + k, text + (" token = abcdefgh12" if k == 0 else ""), "en", "s1", 9) for k in range(3)]
    docs = spark.createDataFrame(rows + more, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path)).cache()
        assert after.columns == docs.columns, name
        if name == "quality_rules":
            assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in now.collect()}
            assert all(len(WORD.findall(r.text or "")) >= 10 for r in after.collect())
        elif name == "ngram_jaccard_join":
            ids = [r.doc_id for r in after.collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and {2000, 2001} <= set(ids) and 2002 not in ids
        elif name == "secret_scans":
            assert after.count() == now.count()
            kept = {r.doc_id: r for r in after.collect()}
            assert kept[2000].text == text + " [assign]" and kept[2000].n_chars == len(text) + 9
        now = after
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    lengths = collections.Counter()
    for r in pieces.collect():
        lengths[r.sequence_id] += r.length
    assert lengths and all(n == 4096 or n & (n - 1) == 0 for n in lengths.values())
    assert secrets.KINDS[:3] == ["assign", "access", "hex"]


def small_lexicon():
    import pyarrow as pa

    words = [lm.END, *"abcdefg"]
    cls = np.array([0] * 4 + [1] * 4 + [2])
    return lm.Lexicon(pa.array(words), np.full(8, 9), 8, cls, np.array([0, 1, 2, 3] * 2 + [0]), np.array([4, 4, 1]), 72, 8)


@pytest.mark.parametrize("lanes", [1, 3, 256])
def test_every_window_is_learnt_from(monkeypatch, lanes):
    """All ids once and in order; the state is the one left by the window before, and zero at a start."""
    lex, r, calls = small_lexicon(), np.random.default_rng(5), []
    texts = [r.integers(1, 9, n).tolist() + [0] for n in (70, 0, 15, 16, 200, 3, 31, 5, 1)]
    ids, ends = np.concatenate(texts).astype(int), np.cumsum([0, *map(len, texts)])

    def watched(p, h, xs, ys, live, *rest):
        after = r.normal(size=h.shape).astype(np.float32)
        calls.append([(h[k], after[k], xs[live[:, k], k].tolist(), ys[live[:, k], k].tolist()) for k in range(h.shape[0])])
        return after

    monkeypatch.setattr(lm, "train_window", watched)
    monkeypatch.setattr(lm, "LANES", lanes)
    assert lm.learn(lm.initial(9, 4, 3, 6), lex, lm.Rows.fresh(ids, ends, 6), 0.05)[0] == len(ids)
    read, last = [], []
    for call in calls:
        for k, (before, after, xs, ys) in enumerate(call):
            if k == len(last):
                last.append((None, [0]))
            state, tokens_before = last[k]
            if tokens_before[-1] == 0:
                assert not before.any() and xs == [0, *ys[:-1]]
                read.append(ys)
            else:
                assert (before == state).all() and xs == [tokens_before[-1], *ys[:-1]]
                read.remove(tokens_before)
                read.append(tokens_before + ys)
                ys = tokens_before + ys
            last[k] = (after, ys)
    assert sorted(read) == sorted(texts)


@pytest.mark.parametrize("lanes", [2, 4, 256])
def test_long_rows_go_on_beside_the_next_ones(monkeypatch, lanes):
    """Rows in three slices: every window once, in its row's order, from the state left."""
    lex, r, calls = small_lexicon(), np.random.default_rng(5), []
    texts = [r.integers(1, 9, n).tolist() + [0] for n in (700, 3, 150, 16, 20, 3, 310, 5, 1, 40, 90, 0, 33, 64, 8)]

    def watched(p, h, xs, ys, live, *rest):
        after = r.normal(size=h.shape).astype(np.float32)
        calls.extend((h[k], after[k], xs[0, k], ys[live[:, k], k].tolist()) for k in range(h.shape[0]))
        return after

    monkeypatch.setattr(lm, "train_window", watched)
    monkeypatch.setattr(lm, "LANES", lanes)
    seen, left = 0, lm.Rows.fresh(np.zeros(0, np.int64), np.zeros(1, np.int64), 6)
    for k in range(0, len(texts), 5):
        part = texts[k:k + 5]
        new = lm.Rows.fresh(np.concatenate(part).astype(int), np.cumsum([0, *map(len, part)]), 6)
        n, left = lm.learn(lm.initial(9, 4, 3, 6), lex, left.joined(new), 0.05, last=False)
        seen += n
        assert seen + len(left.ids) == sum(map(len, texts[:k + 5]))
    n, left = lm.learn(lm.initial(9, 4, 3, 6), lex, left, 0.05)
    assert seen + n == sum(map(len, texts)) and not len(left.ids)
    # A window goes on from the window that left its state.
    begun, whole = {}, []
    for before, after, x, ys in calls:
        if not before.any():
            assert x == 0
            row = ys
        else:
            row = begun.pop(before.tobytes())
            assert x == row[-1]
            row = row + ys
        if ys[-1] == 0:
            whole.append(row)
        else:
            begun[after.tobytes()] = row
    assert sorted(whole) == sorted(texts) and not begun


@pytest.mark.parametrize("changed", [(0, 40), (1, 2), (2, 130)])
def test_every_part_of_every_row_matters(spark, changed):
    row, word = changed
    texts = [["a", "b"] * 100 for _ in range(3)]
    one = spark.createDataFrame([(" ".join(t),) for t in texts], "text string").coalesce(1)
    texts[row][word] = "g"
    other = spark.createDataFrame([(" ".join(t),) for t in texts], "text string").coalesce(1)
    a, b = (lm.train(x, small_lexicon(), rounds=1) for x in (one, other))
    assert not (a.e[7] == b.e[7]).all()


def test_words_of_slices():
    import pyarrow as pa

    texts = ["One TWO", None, "", " \t", "\u00c9t\u00c9 x\x0by", "three"] * 50
    for column in (pa.array(texts), pa.array([x or "" for x in texts])):
        for a, b in ((0, 300), (1, 7), (150, 299), (4, 4)):
            words, offsets = lm._words(column.slice(a, b - a))
            rows = [words.slice(x, y - x).to_pylist() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            assert rows == [tokens(x)[:-1] for x in texts[a:b]]
            ids, ends = np.arange(offsets[-1] + b - a), offsets + np.arange(b - a + 1)
            lex = small_lexicon()
            got = lm._unpacked(lex, lm._packed(lex, ids, ends).slice(1))
            assert (got[0] == ids[ends[min(1, b - a)]:]).all() and (got[1] == ends[1:] - ends[min(1, b - a)]).all()


def test_texts_are_cut_into_words_once(spark, tmp_path):
    """The texts are read to count words and to number them, by no round and not to score."""
    docs = spark.createDataFrame([(k, "a b c " * k) for k in range(40)], SCHEMA.split(", lang")[0])
    docs.write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    cuts, cut = [], lm.cut
    try:
        lm.cut = lambda df: cuts.append(df) or cut(df)
        got = lm.score(read)
    finally:
        lm.cut = cut
    plans = [df._jdf.queryExecution().analyzed().toString() for df in cuts]
    assert [f"text#" in p for p in plans] == [True, True, False]
    assert "text#" not in got._jdf.queryExecution().analyzed().toString()
    assert got.count() == 40


@pytest.mark.parametrize("bounded", [True, False])
def test_window_is_plain_backpropagation(bounded):
    """One window's changes, against gradients of the loss by differences."""
    lex, r = small_lexicon(), np.random.default_rng(3)
    p = lm.initial(9, 4, 3, 5)
    if not bounded:
        # Biases alike beyond what exp takes change no probability.
        p.c[-1] += 100
        p.w[:, -1] += 100
    xs, ys = r.integers(0, 9, (2, 6, 3))
    live = np.arange(6)[:, None] < np.array([6, 4, 1])

    def loss(q):
        h, out = np.zeros((3, 5), np.float32), 0.0
        for x, y, on in zip(xs, ys, live, strict=True):
            h = lm._step(q, h, x)[0]
            out -= lm.log_probabilities(q, h, y, lex.of_class, lex.in_class, lex.sizes)[on].sum(dtype=float)
        return out

    after = lm.Params(*(a.copy() for a in p.arrays()))
    rate = 1e-3
    lm.train_window(after, np.zeros((3, 5), np.float32), xs, ys, live, lex.of_class, lex.in_class, lex.sizes, rate)
    # The unused unknown class of one has no words to learn.
    for a, b in zip(p.arrays(), after.arrays(), strict=True):
        told = (a.astype(float) - b) / (rate / np.sqrt(live.sum()))
        for at in map(tuple, r.integers(0, a.shape, (40, a.ndim))):
            old, moved = a[at], []
            for step in (0.02, -0.02):
                a[at] = old + step
                moved.append(loss(p))
            a[at] = old
            assert told[at] == pytest.approx((moved[0] - moved[1]) / 0.04, abs=0.03 if bounded else 0.1)
