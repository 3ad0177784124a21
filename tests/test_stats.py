import datetime

from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.operators import quality, stats


def test_cost(spark):
    calls = spark.createDataFrame([(1_000_000, 0), (0, 1_000_000), (0, 0)], "prompt_tokens long, completion_tokens long")
    used = stats.with_cost(stats.usage_totals(calls), F.lit(fv.DEFAULT_MODEL)).first()
    assert (used.calls, used.estimated_cost_usd) == (2, 18.0)
    assert stats.usage_totals(calls, count_empty=True).first().calls == 3
    row = spark.createDataFrame([(337_512, 94_233)], "i long, o long")
    def cost(model):
        return row.select(stats.cost(F.col("i"), F.col("o"), F.lit(model))).first()[0]
    assert cost(fv.DEFAULT_MODEL) == cost("unknown") == round(337_512 / 1e6 * 3 + 94_233 / 1e6 * 15, 4) == 2.426
    assert cost("claude-3-5-haiku-20241022") == round(337_512 / 1e6 * 0.8 + 94_233 / 1e6 * 4, 4)


def test_statistics_and_rates(spark):
    found = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "path string, lines long")
    made = spark.createDataFrame([(True,), (False,)], "from_cache boolean")
    usage = spark.createDataFrame([(10, 20)], "prompt_tokens long, completion_tokens long")
    s = stats.run_statistics(found, made, usage, fv.DEFAULT_MODEL)
    assert s.first().asDict() == {
        "files_discovered": 3, "files_analyzed": 2, "files_skipped": 1, "files_from_cache": 1,
        "total_source_lines": 12, "llm_calls": 1, "prompt_tokens": 10, "completion_tokens": 20,
        "estimated_cost_usd": 0.0003,
    }
    rates = stats.run_rates(s).first()
    assert (rates.skip_rate, rates.cache_hit_rate) == (1 / 3, 0.5)
    nothing = stats.run_statistics(found.limit(0), made.limit(0), usage.limit(0), "m")
    assert nothing.first().total_source_lines == 0
    assert stats.run_rates(nothing).first().skip_rate == 0.0


def test_rollup_levels(spark):
    rows = [("com.a.x", 1), ("com.a.y", 2), ("com.b", 4), ("lib/c", 8), (None, 16)]
    df = spark.createDataFrame(rows, "package string, size_bytes long")
    got = {(r.level1, r.level2, r.package): (r.rolled, r.files, r.bytes) for r in stats.rollup_levels(df).collect()}
    assert got[(None, None, None)] == (7, 5, 31)
    assert got[("com", None, None)] == (3, 3, 7)
    assert got[("com", "a", None)] == (1, 2, 3)
    assert got[("lib", "c", "lib/c")] == (0, 1, 8)
    assert got[("", "", "(root)")] == (0, 1, 16)


def test_windows(spark):
    at = datetime.datetime(2024, 1, 1, 10)
    rows = [(at + datetime.timedelta(minutes=m), m) for m in (0, 59, 60, 61)]
    got = stats.usage_windows(spark.createDataFrame(rows, "ts timestamp, tokens long")).orderBy("window_start")
    assert [(r.window_start.hour, r.calls, r.tokens) for r in got.collect()] == [(10, 2, 59), (11, 2, 121)]


def test_unfounded_methods(spark):
    reported = spark.createDataFrame([("a", ["ping", "pong"]), ("b", [])], "path string, names array<string>")
    texts = spark.createDataFrame([("a", "int ping()"), ("b", "")], "path string, content string")
    index = quality.occurrence_index(texts)
    assert index.columns == ["path", "ids"]
    assert [tuple(r) for r in quality.unfounded_methods(reported, index).collect()] == [("a", "pong")]
    # A part of an identifier is no occurrence.
    named = spark.createDataFrame([("c", ["f", "größe", "$x", "i"])], "path string, names array<string>")
    text = spark.createDataFrame([("c", "if (größe) $x.if2()")], "path string, content string")
    got = quality.unfounded_methods(named, quality.occurrence_index(text)).collect()
    assert sorted(r.name for r in got) == ["f", "i"]


def test_agreement(spark):
    rows = [("a", "x", 1), ("a", "x", 2), ("b", None, 1), ("b", None, 1)]
    df = spark.createDataFrame(rows, "path string, role string, n long")
    got = {r.field: (r.files, r.agreeing, r.share) for r in quality.run_agreement(df, ["role", "n"]).collect()}
    assert got == {"role": (2, 2, 1.0), "n": (2, 1, 0.5)}


def test_golden_set(spark):
    shape = "path string, role string, summary string, names array<string>, signatures array<string>"
    golden = spark.createDataFrame([
        ("a", "r", "s", ["f", "g"], ["f()", "g()"]), ("b", "r", "s", ["f", "g"], ["f()", "g()"]), ("c", "r", "s", [], []),
    ], shape)
    actual = spark.createDataFrame([
        ("a", "r", "s", ["f", "g"], ["f()", "g()"]), ("b", "q", "s", ["f", "h", "i"], ["f(x)", "g"]), ("c", "r", "t", [], []),
    ], shape)
    scores = quality.golden_scores(actual, golden)
    got = {r.path: tuple(r)[1:] for r in scores.collect()}
    assert got == {"a": (2, 2, 2, 2), "b": (0, 1, 0, 1), "c": (2, 2, 2, 1)}
    gate = quality.golden_gate(scores, 1.4).first()
    assert (gate.files, gate.mean_score, gate.passed) == (3, 17 / 12, True)
    invented = spark.createDataFrame([("b", "zz"), ("not golden", "q")], "path string, name string")
    failed = quality.golden_gate(scores, 1.4, invented).first()
    assert (failed.invented_methods, failed.passed) == (1, False)
    assert quality.golden_gate(scores, 1.4, invented.where("path <> 'b'")).first().passed
    assert not quality.golden_gate(scores, 1.5).first().passed
    assert quality.golden_gate(scores.limit(0), 1.0).first().passed is False


def test_snapshot_diff(spark):
    now = spark.createDataFrame([("same", "1"), ("new", "2"), ("changed", "3")], "path string, key string")
    then = spark.createDataFrame([("same", "1"), ("gone", "2"), ("changed", "4")], "path string, key string")
    got = {r.path: r.status for r in quality.snapshot_diff(now, then).collect()}
    assert got == {"same": "unchanged", "new": "new", "changed": "changed", "gone": "deleted"}


def test_snapshots_are_compared_below_folders_that_differ(spark):
    rows = [(f"a/b{i % 5}/c{i % 3}/f{i}.py", str(i)) for i in range(90)] + [("top.py", "t"), ("n/x.py", None)]
    changed = {"a/b1/c0/f6.py": "new key", "a/b2/c1/f7.py": None}
    then = [(p, changed.get(p, k)) for p, k in rows if p != "a/b3/c2/f8.py"] + [("gone/g.py", "g")]
    now, before = (spark.createDataFrame(r, "path string, key string") for r in (rows, then))
    want = {p: "unchanged" for p, _ in rows}
    old = dict(then)
    for p, k in rows:
        want[p] = "new" if p not in old else "unchanged" if old[p] == k else "changed"
    want["gone/g.py"] = "deleted"
    assert {r.path: r.status for r in quality.snapshot_diff(now, before).collect()} == want
    folders = {r.folder: (r.files, r.earlier_files, r.same) for r in quality.snapshot_folders(now, before).collect()}
    assert folders[""] == (92, 92, False) and folders["n"] == (1, 1, True) and folders["gone"] == (0, 1, False)
    touched = {p for p, s in want.items() if s != "unchanged"}
    for folder, (_, _, same) in folders.items():
        assert same == (not any(p.startswith(folder + "/") or not folder for p in touched)), folder
    same = quality.snapshot_diff(now, now)
    assert {r.status for r in same.collect()} == {"unchanged"} and same.count() == len(rows)
