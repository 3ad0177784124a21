import random

import pytest

from corpusloom import Settings
from corpusloom import fixed_values as fv
from corpusloom.operators import fold, reduce
from corpusloom.operators.discover import discover
from corpusloom.operators.ranking import global_rank, running_sum
from corpusloom.operators.records import rule_based_records


def estimate(n_chars):
    return n_chars // 4 + 1 if n_chars else 0


def test_running_sum_and_rank_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(9)}", f"p{i:04d}", rng.randrange(50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, p string, n bigint").repartition(5)
    want, sums = {}, {}
    for g, p, n in sorted(rows):
        want[p] = sums.get(g, 0)
        sums[g] = want[p] + n
    got = running_sum(df, ["g"], ["p"], "n", "before").collect()
    assert {r.p: r.before for r in got} == want and len(got) == len(rows)
    ranks = {r.p: r["rank"] for r in global_rank(df.select("g", "p"), ["g", "p"]).collect()}
    assert ranks == {p: i + 1 for i, (_, p, _) in enumerate(sorted(rows))}


@pytest.mark.parametrize("budget, kept", [(1_000, 9), (60, 4), (40, 2), (1, 1)])
def test_truncated_lines(spark, budget, kept):
    """Nine lines of 40 characters; the note of a shortened text counts."""
    rows = [(f"p{i}", f"{i}" * 40) for i in range(9)]
    df = spark.createDataFrame(rows, "package string, line string").repartition(3)
    got = reduce.truncate_to_budget(df, budget).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, len(got) + 1))
    assert [(r.package, r.line) for r in got][:kept] == rows[:kept]
    assert [r.line for r in got][kept:] == ([fv.TRUNCATION_NOTE.lstrip("\n")] if kept < 9 else [])


@pytest.fixture
def records(corpus):
    files = {f"src/main/java/hot/F{i:03d}Controller.java": "public int f(int x) { return 1; }" for i in range(60)}
    files |= {"src/main/java/b/AUtil.java": "import lombok.X;", "Root.java": "x"}
    return rule_based_records(discover(corpus(files)))


def test_digest_and_tree(records):
    lines = {r.path: (r.package, r.line) for r in reduce.digest_lines(records).collect()}
    assert lines["Root.java"] == ("(root)", "[source file] Root.java — [dry-run] A source file (Root.java).")
    tree = reduce.package_tree(records).orderBy("package").collect()
    assert [r.line for r in tree] == ["  (root) (1 files)", "  b (1 files)", "  hot (60 files)"]
    size = reduce.digest_budget(reduce.digest_lines(records), 100).first()
    assert (size.lines, size.over_budget) == (62, True)
    assert size.tokens == estimate(len("\n".join(x for _, x in lines.values())))


def test_package_digests_keep_every_line_in_bounded_parts(records):
    lines = reduce.digest_lines(records)
    longest = max(len(r.line) for r in lines.collect())
    rows = reduce.package_digests(lines, 100).orderBy("package", "part").collect()
    bodies = {}
    for r in rows:
        head, tail = f"Package: {r.package}\n\nFiles:\n", "\n\nSummarize"
        body = r.prompt[len(head):r.prompt.index(tail)]
        assert r.prompt.startswith(head) and len(body) <= 400 + longest
        assert body.count("\n") + 1 == r.files
        bodies.setdefault(r.package, []).append(body)
    assert len(bodies["hot"]) > 5 and len(bodies["b"]) == 1
    want = "\n".join(r.line for r in lines.where("package = 'hot'").orderBy("path").collect())
    assert "\n".join(bodies["hot"]) == want
    whole = reduce.package_digests(lines, 100_000).collect()
    assert {r.part for r in whole} == {1} and len(whole) == 3


def test_package_lines(records):
    packages = reduce.rule_based_packages(records, components=8)
    got = {r.package: r.line for r in reduce.package_summaries(packages).collect()}
    assert got["b"] == "[package b] 1 files, mostly source file. Components: AUtil.java"
    shown = ", ".join(f"F{i:03d}Controller.java" for i in range(6))
    assert got["hot"] == f"[package hot] 60 files, mostly REST controller. Components: {shown}"


def test_overview_prompt_within_the_limit(records):
    whole = reduce.overview_prompt("t", records, fold.first_level(records, 100_000).lines, 100_000).first()
    assert whole.prompt.startswith("Target: t\n\nPackage / directory layout:\n  (root) (1 files)\n  b (1")
    assert whole.prompt.count(" — [dry-run]") == 62
    assert whole.prompt_tokens == estimate(len(whole.prompt))
    _, last = fold.fold_by_rules(records, 150)
    short = reduce.overview_prompt("t", records, last.lines, 150 + 100).first()
    assert "[package " in short.prompt and short.prompt_tokens <= 250
    # The tree gives way first: all files in one line.
    assert "  (all) (62 files)" in reduce.overview_prompt("t", records, last.lines, 90).first().prompt


def test_overview(records):
    got = reduce.overview(records, "name", top=2).first()
    assert got.purpose == "A Java project of 62 files in 3 packages." and got.architecture_summary.startswith("Mostly REST controller")
    assert len(reduce.overview(records, "name").first().entry_points) == 60
    assert (got.name, got.primary_language, got.frameworks) == ("name", "Java", ["Lombok"])
    assert got.key_components == ["hot", "(root)"]
    assert [p[-18:] for p in got.entry_points] == ["F000Controller.java"[-18:], "F001Controller.java"[-18:]]
    assert got.potential_risks == []
    assert Settings().reduce_budget == 146_000
