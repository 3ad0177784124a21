"""Language identification: held-out accuracy, codes, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import language_id as li

SCHEMA = "doc_id bigint, text string, lang string"
STEMS = {
    "en": "the and with house river going making under light".split(), "de": "der und mit schaft keit über groß wasser zeit".split(),
    "fr": "le et avec être forêt mangeait rivière où temps".split(), "es": "el y con niño corazón hablando río años señor".split(),
    "it": "il e con perché città della gli mangiare anche".split(), "nl": "het en met ijs huis schoen water zijn geen".split(),
    "pt": "o e com não coração falando rio anos você".split(),
}


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 3 == 1


def rows_of(langs, n, seed=3):
    r = np.random.default_rng(seed)
    return [(k, " ".join(STEMS[(lang := langs[k % len(langs)])][int(r.integers(9))] for _ in range(int(r.integers(6, 30)))), lang)
            for k in range(n)]


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("good", li.F.lit(1)).withColumn("score", li.F.lit("x"))
    return li.identify(docs, **options).collect()


@pytest.mark.parametrize("langs", [["en", "de"], ["en", "de", "fr", "es"], list(STEMS)])
def test_held_out_accuracy(spark, langs):
    rows = rows_of(langs, 420)
    # Labels of held-out rows are never learnt from.
    hidden = [(i, t, "wrong" if held(i) else lang) for i, t, lang in rows]
    got = run(spark, hidden)
    truth = {i: lang for i, _, lang in rows}
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == held(r.doc_id) for r in got)
    mine = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(mine) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = rows_of(["en", "de"], 120) + [
        (1000, None, "en"), (1001, "", "en"), (1002, "123 !? ٣", "de"), (1003, "the and river", None), (None, "the and with", "de"),
        (1004, "und mit keit " * 40_000, None), (7, "the and with", "en"), (7, "the and with", "en"), (1005, "日本語", "en")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000].score == 0
    assert by_id[1003].lang_pred == "en" and by_id[1004].lang_pred == "de" and by_id[None].held_out
    assert by_id[1005].lang_pred in ("en", "de")


def test_one_language_and_none(spark):
    one = [(k, "some words", "en") for k in range(12)]
    assert {(r.lang_pred, r.score) for r in run(spark, one)} == {("en", 1.0)}
    assert {r.lang_pred for r in run(spark, [(k, "some words", None) for k in range(9)])} == {"und"}
    assert run(spark, []) == []


def test_ambiguous_texts_are_flagged(spark):
    rows = rows_of(["en", "de"], 300) + [(5000 + k, "zz qq 1 w", None) for k in range(4)] + [(6000, "the and with house river going", None)]
    by_id = {r.doc_id: r for r in run(spark, rows)}
    assert not by_id[6000].ambiguous and by_id[6000].score > by_id[5000].score


def test_codes_are_far_apart():
    for n in (2, 3, 4, 5, 6, 20, 60):
        code = li.codewords(n)
        distance = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(distance, 99)
        assert distance.min() >= (1 if n == 2 else 2 if n < 5 else 4)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_one_wrong_bit_is_corrected():
    code = li.codewords(4)
    for lang in range(4):
        for bit in range(code.shape[1]):
            heard = code[lang].copy()
            heard[bit] *= -0.5
            model = li.Model(list("abcd"), code, np.zeros((1, 7), np.float32), heard * 3, np.full(code.shape, 1 / 7))
            assert model.predict(np.zeros((1, 1), np.float32))[0][0] == lang


def test_pieces_do_not_matter(monkeypatch):
    texts = pa.array(["Über den Fluss", None, "a", "x" * 300 + " yz", "naïve"])
    want = li.vectors(texts)
    monkeypatch.setattr(li, "PIECE", 7)
    assert np.allclose(li.vectors(texts), want)
    grams = sum(max(0, len("  a  ".strip()) + 2 - n + 1) for n in li.GRAMS)
    assert np.count_nonzero(want[2]) <= grams


@pytest.mark.parametrize("piece", range(1, 12))
def test_a_last_piece_of_any_length(monkeypatch, piece):
    for length in range(1, 24):
        texts = pa.array(["é" + "ab c"[k:] * 6 + "x" * length for k in range(3)] + [""])
        want = li.vectors(texts)
        with monkeypatch.context() as m:
            m.setattr(li, "PIECE", piece)
            assert np.array_equal(li.vectors(texts), want)


def test_a_text_two_bytes_longer_than_a_piece(spark):
    # The spaces around a text are counted with it.
    rows = rows_of(["en", "de"], 60) + [(100 + k, ("und mit " * (li.PIECE // 8 + 1))[:li.PIECE + k - 2], "de") for k in range(5)]
    got = {r.doc_id: r.lang_pred for r in run(spark, rows)}
    assert len(got) == len(rows) and {got[100 + k] for k in range(5)} == {"de"}
