"""Stages of the pipeline on odd tables: clashing columns, equal ids, long texts."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import jaccard_join, mixing
from corpusloom.session import cut

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = ["spans", "_clean", "_blob", "blob", "row_key", "_copies", "copies", "_row_key", "_copy", "_text", "n_words", "r", "m", "doc", "row", "clean",
         "source_size", "place", "_kept", "h", "a.b", "text_", "rows", "digest", "failed", "col"]
PLAIN = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture(scope="module")
def rows():
    made = [(k, f"{PLAIN} number{k} " + " ".join(f"w{k}x{j}" for j in range(20)), "en", f"s{k % 3}", 9) for k in range(12)]
    return made + [(20, made[0][1], "en", "s1", 9), (21, PLAIN + " token = abcdefgh12 end of the whole text", "en", "s2", 9),
                   (22, None, None, None, None), (None, made[1][1] + " more words", "en", None, 4)]


def test_clashing_columns_are_carried(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    wide = docs
    for name in NAMES:
        wide = wide.withColumn(name, F.concat(F.lit(name + ":"), docs["doc_id"].cast("string")))
    wide = wide.cache()
    for stage, run in corpus_pipeline.STAGES[:-1]:
        got = run(spark, wide, "")
        assert got.columns == wide.columns, stage
        for r in got.collect():
            assert all(r[n] == (None if r.doc_id is None else f"{n}:{r.doc_id}") for n in NAMES), stage
        assert sorted(repr(r[:5]) for r in got.select("doc_id", "text", "lang", "source", "n_chars").collect()) == sorted(
            repr(r[:5]) for r in run(spark, docs, "").collect()), stage
    pieces = corpus_pipeline.packed(spark, wide, "")
    assert pieces.count() >= docs.count()


def test_rows_with_one_id_are_told_apart_by_their_text(spark):
    texts = [f"{PLAIN} " + " ".join(f"{c}{j}" for j in range(30)) for c in "abc"]
    data = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (1, texts[0]), (3, texts[1]), (None, texts[0])]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = collections.Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect())
    assert got[2, texts[2]] == 1 and got[None, texts[0]] == 1 and got[1, texts[0]] == 1
    assert sum(n for (_, t), n in got.items() if t == texts[1]) == 1 and sum(got.values()) == 4


def test_equal_rows_share_what_is_taken(spark):
    data = [(k % 7, "w " * (5 + k % 4 * 9), "s") for k in range(40)] + [(1, "w " * 300, "s")] * 3
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    want = {(r.doc_id, r.size): r.n for r in mixing.mix(docs).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect()}
    got = collections.Counter((r.doc_id, len(r.text.split())) for r in mixing.take(docs).collect())
    assert got == {k: n for k, n in want.items() if n}


def test_small_sources_come_near_their_targets(spark):
    import random

    rng = random.Random(4)
    data = [(k, "w " * rng.randint(1, 120), f"s{k % 9}") for k in range(500)]
    mixed = mixing.mix(spark.createDataFrame(data, "doc_id bigint, text string, source string"))
    for r in mixed.groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max(
            F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target and r.over <= 0


def test_a_very_long_text_through_every_stage(spark):
    import random

    rng = random.Random(1)
    long = " ".join(f"{rng.getrandbits(40):x}" for _ in range(2_000_000))
    assert len(long) > 20 << 20
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, "short " * 3, "en", "s", 1)], SCHEMA)
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, ""))
    assert {r.doc_id for r in now.select("doc_id").collect()} == {1}
    pieces = corpus_pipeline.packed(spark, now, "").drop("ids").collect()
    copies = now.count()
    assert sum(r.length for r in pieces) == copies * pieces[0].doc_tokens > 4_000_000
