"""Cross-tokenizer alignment against plain Python over whole texts."""

import collections
import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import alignment
from corpusloom.llm.tokens import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["", None, " ", "  two  spaces ", "a\n b\t c\r\n", "<|endoftext|> <s> </s>", "▁under", "x　y z w", "日本語 テキスト です",
       "naïve café Über ß", "éa ́b", "a\x00b \x7f", "😀😀 ok 👩‍👩‍👧", "word " * 30, "'s don't I'LL", "q" * 5000, "   ", "tail ", "\nhead",
       "a   b", "½ ² ﬁ", "1234567 89.5,6", " lead", "a \n b", "c \u0085d", "e  f"]


@pytest.fixture(scope="module")
def pair():
    return alignment.ByteBpe(tokenizer_path(A)), alignment.PieceBpe(tokenizer_path(B))


def spans(tokenizer, ids):
    at, out = 0, []
    for i in ids:
        n = int(tokenizer.tokens.lengths[i])
        out.append((at, at + n))
        at += n
    return out


def plain(pair, text):
    """(A ids, B ids, groups, links) of one text, by its bytes."""
    if not text:
        return [], [], [], []
    a, b = pair
    ia, ib = a.encode([" " + text])[0], b.encode([" " + text])[0]
    want = (" " + text).encode()
    if any(t.tokens.spell(np.array(i, np.int64)).tobytes() != want for t, i in ((a, ia), (b, ib))):
        return [], [], [], []
    sa, sb = spans(a, ia), spans(b, ib)
    ends = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, start = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, sp) if s >= start and e <= end)
                               for ids, sp in ((ia, sa), (ib, sb))))
        start = end
    links = [(x, y) for x, (s, e) in zip(ia, sa) for y, (u, v) in zip(ib, sb) if s < v and u < e]
    return ia, ib, groups, links


def brute(pair, rows):
    every = [(i, *plain(pair, t)) for i, t in rows]
    held = collections.Counter(p for *_, links in every for p in set(links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted((repr(i), len(ia), len(ib), len(g), len(links), sum(held[p] == most[p[0]] for p in links),
                   sum(held[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if ia else "")
                  for i, ia, ib, g, links in every)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("pairs", alignment.F.lit(1))
    got = alignment.score(docs, tokenizer_path(A), tokenizer_path(B), **options).collect()
    return sorted((repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)


def test_odd_texts(spark, pair):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "two words"), (3, ODD[3]), (3, "other text")]
    assert run(spark, rows) == brute(pair, rows)


def test_rare_pairs_are_joined(spark, pair):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by length(text) limit 60").fetchall()
    assert run(spark, rows, frequent=5) == brute(pair, rows) == run(spark, rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\tab'.,é▁日  09<>|😀́")), max_size=40), min_size=1, max_size=8))
def test_units_give_the_tokens_of_whole_texts(pair, texts):
    import pyarrow as pa

    found = alignment.Aligner(*pair).align(pa.array(texts, pa.string()))
    want = [plain(pair, t) for t in texts]
    assert found["groups"] == [";".join(w[2]).encode() for w in want]
    assert found["n_links"].to_pylist() == [len(w[3]) for w in want]


def test_memory_is_emptied(pair):
    import pyarrow as pa

    small = alignment.Aligner(*pair, kept=3)
    texts = ["one two three", "four five six", "one two three"]
    every = [small.align(pa.array([t]))["groups"][0] for t in texts]
    assert every == [";".join(plain(pair, t)[2]).encode() for t in texts]


def test_long_chain_of_overlaps():
    """Tokens that end together only at the far end: one group, found by doubling."""
    a = np.arange(2, 100_001, 2)
    b = np.append(np.arange(1, 100_000, 2), 100_000)
    labels = alignment.group_labels(a, b)
    assert set(labels.tolist()) == {len(a) - 1}
    assert len(alignment.links(a, b)[0]) == len(a) + len(b) - 1


def test_empty_table(spark):
    assert run(spark, []) == []
