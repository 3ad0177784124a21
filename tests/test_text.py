import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as t


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def out(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_token_estimate(spark):
    texts = ["", "a", "abc", "abcd", "abcdé", "x" * 4000]
    got = out(column(spark, texts), t.token_count(F.col("v")))
    assert got == [0, 1, 1, 2, 2, 1001]
    assert got == sorted(got)


def test_line_count(spark):
    texts = ["", "a", "a\n", "a\nb\n\n", "\r\n"]
    assert out(column(spark, texts), t.line_count(F.col("v"))) == [s.count("\n") + 1 for s in texts]


ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "


@given(st.lists(st.text(alphabet="ab é" + ENDS, max_size=40), min_size=20, max_size=40))
@settings(max_examples=5, deadline=None)
def test_lines_keep_their_ends(spark, texts):
    got = out(column(spark, texts), t.lines_with_ends(F.col("v")))
    assert got == [s.splitlines(keepends=True) for s in texts]


def test_fixed_width_pieces_do_not_split_characters(spark):
    long = ("é𝒳a" * 4000)[:10001]
    got = out(column(spark, [long]), t.fixed_width_pieces(F.col("v"), 100))[0]
    assert "".join(got) == long and {len(p) for p in got[:-1]} == {100}


@given(st.lists(st.floats(0, 1e6), min_size=50, max_size=50))
@settings(max_examples=5, deadline=None)
def test_half_even_is_rounding_of_the_exact_value(spark, values):
    values += [2.675, 1.005, 0.125, 0.375, 2.5, 1234567.125, 16 / 7]
    got = out(column(spark, values, "double"), t.half_even(F.col("v"), 2))
    assert all(math.isclose(a, round(b, 2), abs_tol=1e-12) for a, b in zip(got, values))


def test_decode(spark):
    raw = [b"a\r\nb\rc", b"\xff\xfeok", "é".encode(), b"\xe2\x82", b"x\x80\x80y", b""]
    got = out(column(spark, raw, "binary"), t.decode_text(F.col("v")))
    assert got == [
        b.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n") for b in raw
    ]


def test_fill(spark):
    df = spark.createDataFrame([("p", 3)], "a string, n int")
    assert out(df, t.fill("[{a}] has {n}!", a=F.col("a"), n=F.col("n"))) == ["[p] has 3!"]
