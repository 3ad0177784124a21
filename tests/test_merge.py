from corpusloom.operators import merge
from corpusloom.schemas import INSIGHT


def part(summary, role, signatures, deps, notes):
    methods = [(s, s, "d", [], None, None) for s in signatures]
    return (summary, role, methods, deps, notes)


def parts(spark, rows):
    df = spark.createDataFrame(rows, f"path string, part bigint, insight {INSIGHT.simpleString()}")
    return df.repartition(3)


ROWS = [
    ("f", 2, part("b", "other", ["s1", "s2"], ["A", "B"], ["n2"])),
    ("f", 1, part("a", "controller", ["s1"], ["A"], ["n1"])),
    ("f", 3, part("", "x", ["s0", "s2"], ["C", "A"], ["n1"])),
    ("one", 1, part("long " * 1000, "r", ["t", "t"], ["Z", "Z"], [])),
]


def test_merge_rules_together(spark):
    got = {r.path: r for r in merge.merge_parts(parts(spark, ROWS)).collect()}
    f = got["f"].insight
    assert (f.summary, f.role) == ("a b", "controller")
    assert [m.signature for m in f.key_methods] == ["s1", "s2", "s0"]
    assert (f.external_dependencies, f.noteworthy) == (["A", "B", "C"], ["n1", "n2"])
    one = got["one"].insight
    assert one.summary == "long " * 1000 and one.external_dependencies == ["Z", "Z"]
    assert (got["f"].parts, got["one"].parts) == (3, 1)


def test_merge_rules_as_tables(spark):
    df = parts(spark, ROWS)
    methods = merge.merge_methods(df).where("path = 'f'").orderBy("part", "pos").collect()
    assert [(r.signature, r.part, r.pos) for r in methods] == [("s1", 1, 1), ("s2", 2, 2), ("s0", 3, 1)]
    deps = merge.merge_list(df, "external_dependencies").where("path = 'f'").orderBy("part", "pos")
    assert [(r.item, r.part) for r in deps.collect()] == [("A", 1), ("B", 2), ("C", 3)]
    scalars = {r.path: r for r in merge.merge_scalars(df).collect()}
    assert (scalars["f"].summary, scalars["f"].role) == ("a b", "controller")
    assert scalars["one"].summary == "long " * 1000


def test_joined_summary_is_whole_unless_a_limit_is_named(spark):
    rows = [("f", i, part("x" * 900, "r", [], [], [])) for i in (1, 2, 3)]
    df = parts(spark, rows)
    want = " ".join(["x" * 900] * 3)
    assert merge.merge_scalars(df).first().summary == want
    assert merge.merge_scalars(df, limit=2000).first().summary == want[:2000]
    assert merge.merge_parts(df).first().insight.summary == want
