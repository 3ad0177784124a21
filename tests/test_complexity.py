import pytest
from pyspark.sql import functions as F

from corpusloom.functions import code
from corpusloom.operators import complexity

LOCK = """
final class Lock {
  protected long fill(long level, boolean open) {
    while (open && level < 40) {
      switch ((int) level) { case 3: level += 2; break; case 9: level += 5; break; }
      if (level == 39) { open = false; }
    }
    return open || level > 12 ? level : 0;
  }
}
"""
PYTHON = '''
# if for while
def one(a, b=(1, 2)):
    """if in a doc string"""
    if a and b:
        return "for if"
    elif b or a:
        return 1

async def two(x):
    return x
'''
JAVA = """
/* public int no(int a) { if } */
public class A<T> {
  // public int neither() { }
  public A(int x) { }
  private static final Map<String, List<Integer>> all(@Named("if") String a, int b)
      throws Foo, Bar {
    Runnable r = new Runnable() { public void run() { } };
    return x(a) ? 1 : 2;
  }
  protected int[] last() { while (true) { } }
}
"""
GO = "package m\nfunc (r *T) Name(a int) (int, error) {\n\tif a > 0 && a < 3 {\n\t}\n}\nfunc Plain() {\n}\n"


def methods(spark, text, language="Java"):
    df = spark.createDataFrame([("p", language, text)], "path string, language string, content string")
    return [(r.name, r.ccn) for r in complexity.method_table(df, ["path"]).orderBy("pos").collect()]


def metrics(spark, text, language="Java"):
    df = spark.createDataFrame([("p", language, text)], "path string, language string, content string")
    return complexity.file_complexity(df, ["path"]).first()


def test_one_simple_method(spark):
    m = metrics(spark, "final class Gate {\n  protected void shut() {\n    bolt();\n  }\n}\n")
    assert (m.function_count, m.max_cyclomatic_complexity, m.band, m.nloc) == (1, 1, "low", 5)


def test_branchy_method(spark):
    m = metrics(spark, LOCK)
    # while, &&, two cases, if, ||, ?
    assert (m.function_count, m.most_complex_function, m.max_cyclomatic_complexity) == (1, "fill", 8)
    assert m.band == "high"  # the mean of its one method is 8


def test_odd_text_never_fails(spark):
    for text in ["%% ]]] ~~ (", "", "/* open", "'", '"' * 7, "((((((", "\x01\x02\x03"]:
        m = metrics(spark, text)
        assert (m.function_count, m.average_cyclomatic_complexity, m.band) == (0, 0.0, "low")
        assert m.most_complex_function is None


def test_languages(spark):
    assert methods(spark, PYTHON, "Python") == [("one", 5), ("two", 1)]
    assert methods(spark, JAVA) == [("A", 1), ("all", 1), ("run", 2), ("last", 2)]
    assert methods(spark, GO, "Go") == [("Name", 3), ("Plain", 1)]
    kotlin = "class A {\n  suspend fun f(x: Int): Int = if (x > 0) 1 else 2\n  fun <T> g(a: T) { }\n}\n"
    assert methods(spark, kotlin, "Kotlin") == [("f", 2), ("g", 1)]
    cpp = "int main(int argc, char **argv)\n{\n  for (;;) {}\n}\nstd::string A::f() const {\n}\n"
    assert methods(spark, cpp, "C++")[0] == ("main", 2)
    script = "function go(a) {\n  return a ? 1 : 2;\n}\nexport async function late() {\n}\n"
    assert methods(spark, script, "JavaScript") == [("go", 2), ("late", 1)]
    typed = (
        "class A {\n  constructor(private x: number) {\n    if (x) { }\n  }\n"
        "  async load<T>(id: string): Promise<T> {\n    for (;;) { try { } catch (e) { } }\n  }\n"
        "  get value() { return this.x; }\n}\nfoo(function (a) {\n});\n"
    )
    assert methods(spark, typed, "TypeScript") == [("constructor", 2), ("load", 3), ("value", 1)]


def test_nloc_leaves_out_blank_and_comment_lines(spark):
    assert metrics(spark, 'a;\n\n  // c\n/* b\n b */\nurl = "http://x"; // d\n').nloc == 2
    assert metrics(spark, PYTHON, "Python").nloc == 7


def test_long_inputs_are_safe(spark):
    text = "void f(" + "(a) " * 50_000 + "\n" + '"' + "\\n" * 50_000 + '"\n' + "/*" * 2_000
    assert metrics(spark, text).function_count == 0


@pytest.mark.parametrize("average, maximum, band", [
    (1.38, 4, "low"), (1.36, 2, "low"), (1.0, 1, "low"), (6.0, 16, "high"), (0.0, 0, "low"),
    (2.99, 6, "moderate"), (3.0, 3, "moderate"), (5.9, 11, "high"), (9.99, 19, "high"),
    (10.0, 10, "very_high"), (1.0, 20, "very_high"),
])
def test_bands(spark, average, maximum, band):
    assert spark.range(1).select(code.band(F.lit(average), F.lit(maximum))).first()[0] == band


def test_hotspots(spark):
    rows = [("hot", f"f{i:03d}", 1, f"m{i}", i % 5) for i in range(100)] + [("b", "x", 1, "m", 1)]
    df = spark.createDataFrame(rows, "package string, path string, pos bigint, name string, ccn bigint")
    assert [r.path for r in complexity.hotspots(df, 3).collect()] == ["f004", "f009", "f014"]
    per = complexity.hotspots_per(df, "package", 2)
    assert {(r.package, r.path, r["rank"]) for r in per.collect()} == {
        ("hot", "f004", 1), ("hot", "f009", 2), ("b", "x", 1)
    }
    plan = per._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 2, Partial" in plan  # ranked before the shuffle too
