"""Operators that compare documents or vectors, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import byte_dedup, jaccard_join, suffixes, vectors, word_dedup
from corpusloom.llm.components import components
from corpusloom.session import batch_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, places string"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(60)]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    passage = prose(40)
    out = [None, "", "  \n", "short", prose(3), prose(2000), "z" * 500, "z" * 80, passage, passage + " "]
    for _ in range(25):
        base = prose(r.randint(20, 90))
        out += [base, base, base.upper()]
        cut = base.split()
        cut[r.randrange(len(cut))] = "edited"
        out += [" ".join(cut), prose(10) + " " + passage + "\n" + prose(8)]
    order = list(range(len(out)))
    r.shuffle(order)
    return [(order[k] * 3, t) for k, t in enumerate(out)]


@pytest.fixture
def docs(spark, texts):
    rows = [(i, t, "clash") for i, t in texts]
    return spark.createDataFrame(rows + rows[:3] + [(None, rows[10][1], None)], SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def covered(sequences, width):
    first, out = {}, {}
    for i, s in sorted(sequences, key=lambda x: x[0]):
        mask = [False] * len(s)
        for k in range(len(s) - width + 1):
            if first.setdefault(tuple(s[k:k + width]), i) < i:
                mask[k:k + width] = [True] * width
        out[i] = mask
    return out


def test_word_dedup(docs, texts, nothing):
    sequences = [(i, WORD.findall(t or "")) for i, t in texts]
    masks = covered(sequences, 13)
    got = word_dedup.dedup(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    for i, s in sequences:
        kept = " ".join(w for w, gone in zip(s, masks[i], strict=True) if not gone)
        assert (by_id[i].n_words, by_id[i].n_removed, by_id[i].kept) == (len(s), sum(masks[i]), kept)
    assert by_id[None].n_removed == 0
    assert sum(sum(m) for m in masks.values()) > 500
    assert word_dedup.dedup(nothing).count() == 0


def test_byte_dedup(docs, texts, nothing):
    sequences = [(i, (t or "").encode()) for i, t in texts]
    masks = covered(sequences, 50)
    got = {r.doc_id: r for r in byte_dedup.dedup(docs).collect()}
    for i, s in sequences:
        mask = bytes(masks[i])
        kept = bytes(b for b, gone in zip(s, mask, strict=True) if not gone)
        spans = len(re.findall(b"\1+", mask))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(s), sum(mask), spans, kept)
    digests = {r.doc_id: r.kept_sha256 for r in byte_dedup.dedup(docs, with_bytes=False).collect()}
    assert all(digests[i] == hashlib.sha256(bytes(got[i].kept)).hexdigest() for i in digests)
    assert byte_dedup.dedup(nothing).count() == 0


def test_many_contexts_of_one_core():
    """The plain way for a core with very many contexts decides as the sort does."""
    r = np.random.default_rng(2)
    width = 60
    keys = np.tile(r.integers(97, 123, width).astype(np.uint8), (400, 1))
    keys[:, :10] = r.integers(97, 99, (400, 10))
    keys[:, 50:] = r.integers(97, 99, (400, 10))
    flags, docs = np.full(400, (1 << 11) - 1, np.uint16), r.integers(0, 50, 400)
    sorted_way = byte_dedup._decide(keys, flags, docs, 50)
    at_once, byte_dedup._AT_ONCE = byte_dedup._AT_ONCE, 64
    try:
        assert (byte_dedup._decide(keys, flags, docs, 50) == sorted_way).all()
    finally:
        byte_dedup._AT_ONCE = at_once
    assert sorted_way.any()


@pytest.mark.parametrize("letters", [1, 2, 5, 200])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 11, 60, 500])
def test_suffix_ranks(n, letters):
    s = np.random.default_rng(n).integers(1, letters + 1, n)
    suffix = [tuple(s[k:]) for k in range(n)]
    rank = suffixes.ranks(s, 10 ** 6)
    assert np.argsort(rank).tolist() == sorted(range(n), key=lambda k: suffix[k])
    order = np.argsort(suffixes.ranks(s, 7))
    heads = [suffix[k][:7] for k in order]
    assert heads == sorted(heads)


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(docs, texts, nothing, n, percent):
    def tokens(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = {i: tokens(t) for i, t in texts}
    want = brute_components(sets, lambda a, b: bool(sets[a] & sets[b]) and (
        100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])))
    got = jaccard_join.jaccard_components(docs, n=n, percent=percent).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert sum(i != c for i, c in want.items()) > 30
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_keep_one(docs, texts):
    kept = jaccard_join.keep_one(docs, n=5, percent=80)
    assert kept.columns == docs.columns
    found = jaccard_join.jaccard_components(docs, n=5, percent=80).collect()
    want = {r.component_id for r in found if r.doc_id is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == want | {None} and len(ids) == len(want) + 1


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(k, k + 1) for k in range(300, 340)]
    ids = {x for link in links for x in link}
    have = {frozenset(x) for x in links}
    want = brute_components(sorted(ids), lambda a, b: frozenset((a, b)) in have)
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: c for i, c in want.items() if i in got}
    assert {i for i in ids if want[i] != i} <= set(got)


def some_vectors(n=700, width=64):
    r = np.random.default_rng(6)
    x = r.normal(size=(n, width))
    x[100:180] = x[100] + 0.12 * r.normal(size=(80, width))
    x[200:220] = x[200]
    x[300:500:2] = x[301:500:2] + 0.2 * r.normal(size=(100, width))
    return x.astype(np.float32)


def test_vectors(spark):
    x = some_vectors()
    rows = [(k * 2, v.tolist(), "c") for k, v in enumerate(x)]
    odd = [(5001, None, None), (5003, [0.0] * 64, None), (5005, [float("nan")] + [1.0] * 63, None),
           (5007, [None] + [1.0] * 63, None), (5009, [1.0] * 3, None), (5011, [float("inf")] * 64, None), (None, x[0].tolist(), None)]
    got = vectors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, v string")).collect()
    assert len(got) == len(rows) + len(odd)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    by_id = {r.vec_id: r for r in got}
    links = sum(by_id[2 * k].n_links for k in range(len(x)))
    assert 0.9 * near.sum() <= links <= near.sum()
    assert all(by_id[2 * k].n_links <= near[k].sum() for k in range(len(x)))
    for k in range(200, 220):
        assert by_id[2 * k].n_links >= 19 and by_id[2 * k].component_id == 400
    for i in (5001, 5003, 5005, 5007, 5009, 5011):
        assert (by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert by_id[None].component_id is None
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vectors.near_duplicates(empty).count() == 0


def test_recall():
    x = some_vectors().astype(np.float64)
    assert vectors.candidates_recall(x / np.linalg.norm(x, axis=1, keepdims=True), 0.95) >= 0.9


@pytest.mark.parametrize("percent", [60, 80, 90, 95, 100])
def test_group_bound(spark, percent):
    """What a group must have in common is the least over all its lengths."""
    def need(b, x):
        return -(-(b + x) * percent // (100 + percent)) - max(-(-b * percent // 100), -(-x * percent // 100)) + 1

    rows = [(b, low, high) for b in range(1, 64) for low in range(-(-b * percent // 100), b * 100 // percent + 1)
            for high in range(low, b * 100 // percent + 1)]
    df = spark.createDataFrame(rows, "bn bigint, low bigint, high bigint")
    got = df.withColumn("got", jaccard_join._bound(df.bn, df.low, df.high, percent)).collect()
    assert all(r.got == min(need(r.bn, x) for x in range(r.low, r.high + 1)) for r in got)


def test_group_of_middle_lengths(spark):
    """A link of a set of 28 to the one of 29 in a group with lengths 28, 29 and 30."""
    import pyarrow as pa

    def tokens(words):
        return jaccard_join.token_sets(pa.array([" ".join(words)]), 1)[0]

    def minima(words):
        salts = [np.uint64(0xA24BAED4963EE407 * (k + 1) & (1 << 64) - 1) for k in range(2, jaccard_join.MINIMA + 2)]
        return [int(jaccard_join.arrays.mix(tokens(words) ^ x).min()) for x in salts]

    def alike(x, y):
        return sum(a == b for a, b in zip(minima(x), minima(y), strict=True))

    def order(word):  # of shared words, which have one level
        return int(tokens([word]).view(np.int64)[0])

    # Three minima bring a, c and d together and not b; prefixes of b and a meet in one word.
    single = [f"v{k}" for k in range(20_000)]
    salts = [np.uint64(0xA24BAED4963EE407 * (k + 1) & (1 << 64) - 1) for k in range(2, jaccard_join.MINIMA + 2)]
    own = np.stack([jaccard_join.arrays.mix(jaccard_join.token_sets(pa.array(single), 1)[0] ^ x) for x in salts])
    for seed in range(200):
        shared = sorted((f"s{seed}x{k}" for k in range(27)), key=order)
        a = [*shared, "u1", "u2"]
        c, d = [w for w in a if w != shared[5]], [*a, "w"]
        less = (own < np.array(minima(a), np.uint64)[:, None]).sum(axis=0)
        if alike(a, c) == alike(a, d) == 4 and less.max() >= 3:
            b = [*shared, single[int(less.argmax())]]
            break
    assert max(alike(b, x) for x in (a, c, d)) <= 1
    assert len(a) == 29 and len(b) == len(c) == 28 and len(d) == 30
    fill = [[*shared, *(f"f{i}y{k}" for k in range(90))] for i in range(20)]
    rows = [(i, " ".join(words)) for i, words in enumerate([a, c, d, b, *fill])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, n=1, percent=90).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0} | {k: k for k in range(4, 24)}


def test_vectors_of_every_length_link(spark):
    """Lengths that are few or short, ids that repeat, and lengths that are not learnt."""
    r = np.random.default_rng(9)
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0]), (4, [3.0, -1.0, 0.5]), (5, [7.0]), (6, [2.0]), (7, [-1.0])]
    for width in (2, 8, 16, 30, 64):
        for k in range(40):
            v = r.normal(size=width)
            rows.append((100 * width + k % 30, v.tolist()))
            rows.append((100 * width + 50 + k, (v + r.normal(size=width) * 0.05 * np.linalg.norm(v) / np.sqrt(width)).tolist()))
    want = collections.Counter()
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    linked = [[j for j in range(len(rows)) if j != i and len(rows[j][1]) == len(rows[i][1]) and unit[i] @ unit[j] >= 0.95] for i in range(len(rows))]
    for i, (vec, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        want[vec, len(linked[i]), min(rows[j][0] for j in seen)] += 1
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("width", F.lit(1))
    for learnt in (16, 2):
        old, vectors.LEARNT = vectors.LEARNT, learnt
        try:
            got = vectors.near_duplicates(docs).collect()
        finally:
            vectors.LEARNT = old
        assert collections.Counter((x.vec_id, x.n_links, x.component_id) for x in got) == want


def test_tables_grow_with_the_vectors():
    sizes = [vectors.plan(n, 0.95) for n in (1_000, 10**5, 10**7, 10**9)]
    assert sizes == sorted(sizes) and sizes[0][0] == vectors.CHUNK_BITS
    # A key and its neighbours hold a bounded number of vectors.
    assert all(n / 2 ** b * (b + 1) < 3000 for n, (b, _) in zip((10**5, 10**7), sizes[1:3]))
    x = np.random.default_rng(3).normal(size=(600, 64))
    x = np.concatenate([x, x + np.random.default_rng(4).normal(size=x.shape) * 0.3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = vectors.Codes(19, 10, {64: vectors.learn_codes(x, 190)})
    chunk = codes.chunks(x)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert len(a) > 100 and np.mean(vectors._near(chunk[a], chunk[b]).any(axis=1)) > 0.95


def test_common_shingles_are_told_from_rare(spark):
    """Shingles of a dozen documents are common, however many rare ones there are beside."""
    r = random.Random(8)
    shared = [f"s{k}" for k in range(40)]

    def text(k):
        own = [f"w{k}x{r.randrange(10 ** 9)}" for _ in range(400)]
        return " ".join(own + shared if k % 25 == 0 else own)

    rows = spark.createDataFrame([(k, text(k)) for k in range(300)], "doc bigint, text string").coalesce(1)
    table = jaccard_join.common_tokens(rows, "text", 3).value
    tokens, _ = jaccard_join.token_sets(pa.array([" ".join(shared)]), 3)
    assert (table[jaccard_join._cell(tokens)] > 0).all()
    assert np.count_nonzero(table) <= len(tokens) + 5


def test_only_contexts_with_a_partner_are_sorted():
    """Of contexts, those whose shared bytes no other has; all that have a partner stay."""
    r = np.random.default_rng(6)
    alone = r.integers(97, 123, (50, 60)).astype(np.uint8)
    pair = np.tile(r.integers(97, 123, 60).astype(np.uint8), (2, 1))
    pair[1, 0] ^= 1
    keys = np.concatenate([alone[:30], pair, alone[30:], pair[:1], alone[:1]])
    distinct = np.unique(keys, axis=0)
    parts = list(byte_dedup._parts(distinct))
    assert sorted(map(bytes, distinct[np.concatenate(parts)])) == sorted(map(bytes, pair))
    flags, docs = np.full(len(keys), (1 << 11) - 1, np.uint16), np.arange(len(keys))
    told = byte_dedup._decide(keys, flags, docs, 50)
    # A window that covers the changed byte is new; equal contexts repeat whole.
    every = (1 << 11) - 1
    assert told[31] == every - 1 and told[-2] == told[-1] == every
    assert not told[:31].any() and not told[32:-2].any()


def test_repeated():
    tokens, times = jaccard_join.repeated(np.array([5, 9, 5, 1 << 63, 7, 5, 1 << 63], np.uint64))
    assert tokens.tolist() == [5, 1 << 63] and times.tolist() == [3, 2]
    assert not len(jaccard_join.repeated(np.zeros(0, np.uint64))[0])


def test_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(400).select(F.lit("x" * 10_000).alias("text")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    with batch_bytes(spark, 1 << 20):
        most = max(r.n for r in rows.mapInArrow(sizes, "n bigint").collect())
    assert most <= 200
    assert spark.conf.get(key) == before


def test_families_about_the_threshold(spark):
    """Copies of a few texts with more and more edits: some link only through others."""
    r = random.Random(12)
    sets, rows = {}, []
    for family in range(3):
        base = [f"b{family}x{k}" for k in range(60)]
        for k in range(50):
            words = list(base)
            for _ in range(r.randint(1, 6)):
                words[r.randrange(60)] = f"e{family}x{r.randrange(30)}"
            rows.append((100 * family + k, " ".join(words)))
            sets[rows[-1][0]] = set(words)
    ids, parent = list(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs, n=1, percent=90).collect()}
    assert got == {i: root(i) for i in ids}
    assert 3 < len(set(got.values())) < len(ids)
