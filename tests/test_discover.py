import pytest
from pyspark.sql import functions as F

from corpusloom import Settings
from corpusloom.functions import paths
from corpusloom.operators import discover as d


def kept(corpus, names, **options):
    files = corpus({n: "x" for n in names})
    return sorted(r.path for r in d.discover(files, Settings(**options)).collect())


def test_extension_is_lower_cased_and_needs_a_stem(corpus):
    assert kept(corpus, ["a/B.JAVA", ".java", "c.md", "d", "e.tar.py"]) == ["a/B.JAVA", "e.tar.py"]


def test_excluded_dirs_match_whole_directories_only(corpus):
    names = ["build/A.java", "x/build/A.java", "builds/A.java", "Build/A.java", "x/build.java"]
    assert kept(corpus, names) == ["Build/A.java", "builds/A.java", "x/build.java"]


def test_tests_are_left_out_unless_asked_for(corpus):
    names = [
        "src/Test/Foo.java", "a/FooTest.java", "a/BarTests.java", "a/x_test.py", "a/contest.py",
        "a/y.spec.ts", "a/z.test.js", "a/Plain.java", "test/Root.java",
    ]
    assert kept(corpus, names) == ["a/Plain.java"]
    assert kept(corpus, names, include_tests=True) == sorted(names)


def test_size_limits(spark):
    rows = [("a.py", 0, ""), ("b.py", 10, "x"), ("c.py", 11, "x")]
    files = spark.createDataFrame(rows, "path string, size_bytes bigint, content string")
    assert [r.path for r in d.discover(files, Settings(max_file_bytes=10)).collect()] == ["b.py"]


@pytest.mark.parametrize("path, package", [
    ("src/main/java/com/acme/web/Foo.java", "com.acme.web"),
    ("app/src/main/kotlin/a/b/C.kt", "a.b"),
    ("src/x/y/z.py", "x.y"),
    ("src/z.py", None),
    ("root.py", None),
    ("lib/en/a.py", "lib/en"),
    ("mysrc/a/b.py", "a"),
    ("src/a/src/main/java/b/C.java", "b"),
    ("src/main/java/a/src/main/java/b/C.java", "a.src.main.java.b"),
])
def test_package(spark, path, package):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(paths.package(F.col("p"))).first()[0] == package


def test_language_and_role(spark):
    rows = [("a.py",), ("a.H",), ("a.zig",), ("x/FooServiceImpl.java",), ("x/FooService.java",)]
    df = spark.createDataFrame(rows, "p string")
    got = df.select(paths.language(F.col("p")), paths.role(F.col("p"))).collect()
    assert [r[0] for r in got] == ["Python", "C/C++ header", "zig", "Java", "Java"]
    assert [r[1] for r in got[2:]] == ["source file", "service implementation", "service interface"]


def test_first_files(corpus):
    files = corpus({f"d{i % 7}/f{i:03d}.py": "x" for i in range(200)})
    expected = sorted(r.path for r in files.collect())[:50]
    assert sorted(r.path for r in d.first_files(files, 50).collect()) == expected
    assert d.first_files(files, 0).count() == 0


def test_nothing_found_is_an_error(corpus):
    with pytest.raises(ValueError):
        d.require_files(d.discover(corpus({"a.md": "x"})))


def test_language_breakdown(corpus):
    files = d.discover(corpus({"a.py": "1\n2\n", "b.py": "1", "C.java": "x\n"}))
    got = {r.language: (r.file_count, r.line_count) for r in d.language_breakdown(files).collect()}
    assert got == {"Python": (2, 4), "Java": (1, 2)}
