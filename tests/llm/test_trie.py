"""The prefix trie of conversations against plain Python."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from corpusloom.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = int(np.fix(c / 100)) * 100
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def run(spark, rows, **options):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).withColumn("key", prefix_trie.F.lit(7)), **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    texts = ["a", "bb", "ccc", "d" * 3000, None, "ä😀"]
    out = []
    for c in [*range(0, 30), *range(100, 140), *range(205, 230), -7, -100, -103]:
        n = int(r.integers(1, 9))
        out += [(c, int(k) if k else None, ["user", "bot", None][int(r.integers(3))], texts[int(r.integers(len(texts)))]) for k in range(n)]
    # Copies, equal turn numbers, repeated rows, a long one and no id.
    out += [(300 + k, t, "user", f"same {t}") for k in range(40) for t in range(4)]
    out += [(400, 1, "user", x) for x in ("x", "y", "x", "x")] + [(None, 1, "user", "lost")]
    out += [(501, t, "user", str(t % 3)) for t in range(300)] + [(500, t, "user", str(t % 3)) for t in range(250)]
    return out


def test_whole(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_components_split_by_jobs(spark, rows):
    """A small bound: rounds of jobs split the forest down to components of few members."""
    few = [x for x in rows if x[0] is None or x[0] < 320 or x[0] == 501]
    assert run(spark, few, limit=60) == brute(few)


def test_one_conversation_over_many_ranges(spark):
    rows = [(100, t, "user", f"turn {t}") for t in range(900)] + [(101, t, "user", f"turn {t}") for t in range(700)]
    assert run(spark, rows) == brute(rows)


def test_inherited_sums():
    got = prefix_trie.inherited([(0, 1, 5, 2, 11), (1, 5, 5, 3, 7), (3, 5, 6, 1, 9), (4, 7, 7, 1, 4)])
    b, p = prefix_trie.BASE, prefix_trie.PRIME
    assert got == {(1, 5): (2, 11), (3, 5): (5, (11 + b * b * 7) % p)}


def test_decompose_any_forest():
    r = np.random.default_rng(2)
    for shape in ("random", "chain", "star", "forest"):
        n = 400
        parent = {"random": [-1] + [int(r.integers(k)) for k in range(1, n)], "chain": list(range(-1, n - 1)),
                  "star": [-1] + [0] * (n - 1), "forest": [-1 if k % 50 == 0 else int(r.integers(k - k % 50, k)) for k in range(n)]}[shape]
        depth = [0] * n
        for v in range(n):
            depth[v] = depth[parent[v]] + 1 if parent[v] >= 0 else 0
        values = r.integers(0, 9, (n, 2))
        own = r.integers(1, 5, n)
        want, weight = values.copy(), own.copy()
        for v in reversed(range(n)):
            if parent[v] >= 0:
                want[parent[v]] += want[v]
                weight[parent[v]] += weight[v]
        mixed = r.permutation(n)
        back = np.argsort(mixed)
        moved = np.array([back[parent[v]] if parent[v] >= 0 else -1 for v in mixed])
        got = prefix_trie.decompose(moved, np.array(depth)[mixed], weight[mixed], values[mixed])
        assert np.array_equal(got, want[mixed]), shape


def test_no_rows(spark):
    assert run(spark, []) == []
