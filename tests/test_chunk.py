from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import chunk


def estimate(s):
    return len(s) // 4 + 1 if s else 0


def split(spark, texts, budget):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, content string")
    rows = chunk.chunk_table(df, budget).collect()
    got = {i: [None] * 0 for i in range(len(texts))}
    for r in sorted(rows, key=lambda r: (r.id, r.part)):
        got[r.id].append(r.text)
        assert r.part == len(got[r.id])
    for r in rows:
        assert r.total == len(got[r.id]) and r.chunked == (r.total > 1)
    return [got[i] for i in range(len(texts))]


line = st.text(alphabet="ab é\r\x0b ", max_size=60)


@given(st.lists(st.lists(line, max_size=12).map("\n".join), min_size=30, max_size=30), st.integers(1, 12))
@settings(max_examples=6, deadline=None)
def test_chunks_are_whole_and_within_the_budget(spark, texts, budget):
    for text, parts in zip(texts, split(spark, texts, budget), strict=True):
        assert "".join(parts) == text
        assert len(parts) == 1 or all(0 < len(p) <= 4 * budget for p in parts)
        assert parts == [text] or estimate(text) > budget


def test_lines_stay_together_while_they_fit(spark):
    # Lines of 8 characters are 3 tokens each, so two go into 7 tokens.
    assert split(spark, ["abcdefg\n" * 5], 7) == [["abcdefg\n" * 2, "abcdefg\n" * 2, "abcdefg\n"]]
    # A line over the budget is cut at its size, and nothing joins its pieces.
    assert split(spark, ["ab\n" + "x" * 20 + "\ncd\n"], 3) == [["ab\n", "x" * 12, "x" * 8 + "\n", "cd\n"]]


def test_many_lines_and_one_giant_line(spark):
    lines = "".join(f"void method{i}() {{ return; }}\n" for i in range(500))
    giant = "x" * 100_000
    a, = split(spark, [lines], 50)
    b, = split(spark, [giant], 100)
    assert len(a) > 1 and "".join(a) == lines and all(estimate(c) <= 50 for c in a)
    assert "".join(b) == giant and {len(c) for c in b} == {400}
    assert split(spark, ["", "short"], 50) == [[""], ["short"]]


def test_reassemble(spark):
    texts = ["a\nb\n" * 50, "x" * 999, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, content string")
    whole = chunk.reassemble(chunk.chunk_table(df, 5), "id")
    assert {r.id: r.content for r in whole.collect()} == dict(enumerate(texts))


def test_budget_report(spark):
    df = spark.createDataFrame([("en", "x" * 40), ("en", "x"), ("de", "")], "lang string, text string")
    got = {r.lang: tuple(r)[1:] for r in chunk.budget_report(df, 5, "lang", "text").collect()}
    assert got == {"en": (2, 12, 1, 11), "de": (1, 0, 0, 0)}
