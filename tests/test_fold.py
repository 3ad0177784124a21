"""The fold of a digest: bounded parts, nothing lost, replies between levels."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom import Settings
from corpusloom.operators import fold, reduce
from corpusloom.operators.discover import discover
from corpusloom.operators.records import rule_based_records
from corpusloom.plans import analyze
from corpusloom.sources.replies import one_overview_per_part, parse_overviews


@pytest.fixture
def files():
    made = {f"src/main/java/com/acme/p{i % 40:02d}/F{i:03d}Controller.java": "int f(int x) { return 1; }" for i in range(120)}
    return made | {f"src/main/java/hot/H{i:03d}Service.java": "x" for i in range(80)} | {"Root.java": "x"}


def test_every_line_is_in_a_leaf_and_no_part_is_over(corpus, files):
    records = rule_based_records(discover(corpus(files)))
    budget = 200
    asked, last = fold.fold_by_rules(records, budget)
    rows = asked.collect()
    levels = {r.level for r in rows}
    assert levels == set(range(1, max(levels) + 1)) and len(levels) >= 3
    leaves = "\n".join(r.prompt for r in rows if r.level == 1)
    for line in reduce.digest_lines(records).collect():
        assert line.line in leaves
    packages = {r.package for r in reduce.package_tree(records).collect()}
    assert {r.first for r in rows if r.level == 1} == packages
    for k in levels:
        mine = [r for r in rows if r.level == k]
        assert sum(r.files for r in mine) == len(files)
        assert sorted(r.part for r in mine) == list(range(1, len(mine) + 1))
        # The wording around a digest is not part of its budget.
        assert all(r.prompt_tokens <= budget + 40 for r in mine)
    assert reduce.digest_budget(last.lines, budget).first().over_budget is False
    assert sum(r.files for r in last.lines.collect()) == len(files)


def test_lines_longer_than_a_part_come_in_pieces(spark):
    lines = spark.createDataFrame([("a", 1, "x" * 1000), ("b", 1, "y"), ("c", 1, "")], "at string, files int, line string")
    got = fold.dealt(lines, [], ["at"], 50).orderBy("at", "piece").collect()
    assert "".join(r.line for r in got if r.at == "a") == "x" * 1000
    assert [r.files for r in got] == [1] + [0] * 9 + [1, 1]
    cells = {}
    for r in got:
        cells.setdefault(r.cell, []).append(r.line)
    assert sorted(cells) == list(range(len(cells))) and all(len("\n".join(c)) <= 200 for c in cells.values())


def test_a_budget_that_holds_one_line_is_refused(corpus, files):
    with pytest.raises(ValueError):
        fold.fold_by_rules(rule_based_records(discover(corpus(files))), 20)


def test_small_digest_needs_no_request(corpus):
    records = rule_based_records(discover(corpus({"a.py": "x"})))
    asked, last = fold.fold_by_rules(records, 1000)
    assert asked is None and last.done and last.lines.count() == 1


def test_overview_replies(spark):
    full = {"name": "n", "purpose": "p", "architecture_summary": "a", "primary_language": "Go"}
    rows = [(1, 1, json.dumps(full)), (1, 2, "{"), (1, 3, json.dumps({k: v for k, v in full.items() if k != "purpose"})),
            (1, 1, json.dumps(full | {"purpose": "a longer one"})), (1, 4, json.dumps(full | {"frameworks": ["x"], "more": 1}))]
    parsed = parse_overviews(spark.createDataFrame(rows, "level bigint, part bigint, reply string"))
    got = {r.part: r for r in one_overview_per_part(parsed).collect()}
    assert set(got) == {1, 4} and got[1].purpose == "p" and got[1].key_components == [] and got[4].frameworks == ["x"]


def test_reduce_half_with_a_model(corpus, files):
    settings = Settings(max_input_tokens=4_000 + 250)
    run = analyze.analyze_by_rules(corpus(files), settings, "t", "now")
    by_rule = run.statistics.first()
    assert by_rule.llm_calls > len(files) + 1 and by_rule.prompt_tokens == 0 and by_rule.wall_time_seconds > 0

    def reply(requests, broken=0):
        text = F.concat(F.lit('{"name":"N","purpose":"part '), F.col("part").cast("string"), F.lit(
            '","architecture_summary":"A","primary_language":"Java","key_components":["k"]}'))
        return requests.select("level", "part", F.when(F.col("part") == broken, "{").otherwise(text).alias("reply"))

    reduction, asked = analyze.start_reduction(run, settings, "t"), 0
    while reduction.overview is None:
        asked += reduction.requests.count()
        lines = {r.at: r.line for r in fold.answered(reduction.level.requests, one_overview_per_part(
            parse_overviews(reply(reduction.requests, 2)))).collect()}
        assert "part 1 Components: k" in lines[f"{1:019d}"] and "files, mostly" in lines[f"{2:019d}"]
        reduction = analyze.continue_reduction(run, reduction, reply(reduction.requests, 2), settings)
    assert reduction.requests.count() == 1 and reduction.requests.first().prompt_tokens <= settings.max_input_tokens
    done = analyze.finish_reduction(run, reduction, reply(reduction.requests), settings)
    doc = json.loads(done.document.first().document)
    assert doc["overview"]["purpose"] == "part 1" and doc["overview"]["key_components"] == ["k"] and doc["files"] == "files"
    used = done.statistics.first()
    assert used.llm_calls == asked + 1 and used.completion_tokens > 0 and used.wall_time_seconds >= by_rule.wall_time_seconds
    lost = analyze.finish_reduction(run, reduction, reply(reduction.requests, 1), settings)
    assert lost.overview.first().purpose.startswith("A Java project of 201 files")
