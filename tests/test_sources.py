import json
import os

import pytest

from corpusloom import Settings
from corpusloom.operators.discover import discover
from corpusloom.operators.records import rule_based_records
from corpusloom.session import local_path, scratch_path
from corpusloom.sources.replies import good_replies, parse_replies, quarantine
from corpusloom.sources.sinks import read_records, write_records
from corpusloom.sources.tables import corpus_from_table
from corpusloom.sources import tree as tree_source
from corpusloom.sources.tree import FILE_BYTES, list_tree, paged, scan_tree

TREE = {
    "src/main/java/com/acme/web/Foo.java": b"class Foo {}\r\n",
    "src/test/java/com/acme/FooTest.java": b"x",
    "build/Generated.java": b"x",
    "README.md": b"x",
    "pkg/__init__.py": b"a\rb",
    "pkg/_in/.deep/b.py": b"ok \xff\xfe",
    "pkg/empty.py": b"",
    ".hidden.py": b"h",
    ".git/x.py": b"x",
}


@pytest.fixture
def tree(tmp_path):
    for name, raw in TREE.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(raw)
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling.py")
    os.symlink(tmp_path / "pkg", tmp_path / "again")
    return str(tmp_path)


def test_scan(spark, tree):
    got = {r.path: (r.size_bytes, r.content) for r in scan_tree(spark, tree).collect()}
    assert got == {
        "src/main/java/com/acme/web/Foo.java": (14, "class Foo {}\n"),
        "pkg/__init__.py": (3, "a\nb"),
        "pkg/_in/.deep/b.py": (5, "ok ��"),
        ".hidden.py": (1, "h"),
    }
    with_tests = scan_tree(spark, tree, Settings(include_tests=True))
    assert "src/test/java/com/acme/FooTest.java" in {r.path for r in with_tests.collect()}


def test_paths_of_mounted_folders(spark, tree):
    assert local_path("/a/b") == local_path("file:/a/b") == local_path("file:///a/b") == "/a/b"
    with pytest.raises(ValueError):
        local_path("hdfs://name/a")
    assert scan_tree(spark, "file://" + tree).count() == 4


def test_listing_prunes_folders_and_reads_no_content(spark, tree):
    names = {r.path for r in list_tree(spark, tree).collect()}
    assert "README.md" in names and "pkg/empty.py" in names
    assert not any(n.startswith(("build/", ".git/", "again/")) for n in names)


def test_a_folder_of_many_files_is_read_in_several_tasks(spark, tmp_path):
    want = {}
    for i in range(60):
        (tmp_path / f"f{i:02d}.py").write_text("x" * (i * 40))
        if i:
            want[f"f{i:02d}.py"] = i * 40
    listing = list_tree(spark, str(tmp_path)).where("size_bytes > 0")
    pages = {}
    for r in paged(listing, FILE_BYTES * 5).collect():
        pages.setdefault(r.page, []).append(r.path)
    assert sorted(pages) == list(range(len(pages))) and len(pages) >= 12
    assert sorted(sum(pages.values(), [])) == sorted(want) and max(map(len, pages.values())) <= 6
    got = scan_tree(spark, str(tmp_path), page_bytes=FILE_BYTES * 5)
    assert got.rdd.getNumPartitions() == len(pages)
    assert {r.path: len(r.content) for r in got.collect()} == want
    assert all(len(p) <= 6 for p in got.select("path").rdd.glom().collect())


def test_many_folders(spark, tmp_path):
    want = set()
    for i in range(20):
        folder = tmp_path / f"d{i % 4}" / f"e{i % 5}" / f"f{i}"
        folder.mkdir(parents=True)
        (folder / "a.py").write_text("x")
        want.add(f"d{i % 4}/e{i % 5}/f{i}/a.py")
    assert {r.path for r in list_tree(spark, str(tmp_path)).collect()} == want


def test_a_folder_that_cannot_be_listed(spark, tree, monkeypatch):
    with pytest.raises(OSError, match="nowhere"):
        list_tree(spark, tree + "/nowhere")
    kept = list_tree(spark, tree + "/nowhere", on_error="keep").collect()
    assert len(kept) == 1 and "FileNotFoundError" in kept[0].error and kept[0].path == ""
    assert scan_tree(spark, tree + "/nowhere", on_error="keep").count() == 0


def test_other_file_systems_are_opened_by_address(tmp_path):
    """The listing of a file system that is not mounted, in the task's own code."""
    import pyarrow as pa
    from pyarrow import fs

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("x")
    (tmp_path / "a" / "build").mkdir()
    system = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    found = sorted(tree_source._entries(system, "a", mounted=False))
    assert [(n, s, d) for n, _, s, d in found] == [("build", None, True), ("x.py", 1, False)]
    assert tree_source._file_system("file://" + str(tmp_path))[1] == str(tmp_path)
    batch = pa.RecordBatch.from_pydict({"path": [""], "file": [str(tmp_path / "a")]})
    rows = pa.Table.from_batches(tree_source._list_folders(str(tmp_path), frozenset(["build"]))(iter([batch]))).to_pylist()
    assert [r["path"] for r in rows] == ["x.py"]


def test_table_source(spark):
    df = spark.createDataFrame([("a\\b.py", "é")], "file string, body string")
    assert tuple(corpus_from_table(df, "file", "body").first()) == ("a/b.py", 2, "é")


def test_replies(spark):
    method = {"name": "f", "signature": "f()", "description": "d"}
    full = {"summary": "s", "role": "r", "key_methods": [method], "noteworthy": ["n"], "more": 1}
    texts = [
        json.dumps(full), json.dumps(full)[:-3], json.dumps({"summary": "s"}), "no json", "", None,
        json.dumps({"summary": "s", "role": "r", "key_methods": [{"name": "f"}]}),
        json.dumps({"summary": "s", "role": "r"}),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, reply string")
    parsed = parse_replies(df)
    good = {r.id: r.insight for r in good_replies(parsed).collect()}
    assert set(good) == {0, 7}
    assert good[0].key_methods[0].parameters == [] and good[0].external_dependencies == []
    assert good[7].key_methods == [] and good[0].noteworthy == ["n"]
    assert {r.id for r in quarantine(parsed).collect()} == {1, 2, 3, 4, 5, 6}


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_records_round_trip(spark, corpus, small_tree, fmt):
    made = rule_based_records(discover(corpus(small_tree | {"lib/x.h": "int f() { }"})))
    path = scratch_path(spark, "records")
    write_records(made, path, fmt)
    back = read_records(spark, path, fmt)
    assert sorted(back.collect()) == sorted(made.collect())
    with pytest.raises(ValueError):
        write_records(made.drop("package"), path + "x", fmt)
