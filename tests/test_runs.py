import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom import Settings
from corpusloom.plans.analyze import analyze_by_rules, complete, prepare
from corpusloom.schemas import CORPUS
from corpusloom.session import scratch_path, scratch_scope
from corpusloom.sources.runs import RunFolder
from corpusloom.sources.store import read_store
from corpusloom.streaming.usage import start_usage_windows
from corpusloom.streaming.worklist import read_worklist, start_worklist

AT = "2026-01-01T00:00:00+00:00"


def test_rule_based_run(corpus, small_tree):
    run = analyze_by_rules(corpus(small_tree), Settings(), "port/demo", AT)
    stats = run.statistics.first()
    assert (stats.files_discovered, stats.files_analyzed, stats.files_skipped, stats.llm_calls) == (2, 2, 0, 3)
    port = run.records.where("language = 'Python'").first()
    assert port.complexity.function_count == 2 and port.complexity.max_cyclomatic_complexity == 2
    assert [m.name for m in port.insight.key_methods] == ["berth_for", "tide"]
    doc = json.loads(run.document.first().document)
    assert doc["metadata"] == {
        "schema_version": "1.0", "generated_at": AT, "target": "port/demo",
        "model": Settings().model, "tool_version": "1.0.0",
    }
    assert doc["overview"]["primary_language"] == "Kotlin"
    assert doc["statistics"]["languages"] == [
        {"language": "Kotlin", "file_count": 1, "line_count": 5}, {"language": "Python", "file_count": 1, "line_count": 11},
    ]
    with pytest.raises(ValueError):
        analyze_by_rules(corpus({"a.md": "x"}), Settings(), "t", AT)


def test_an_unreadable_file_is_skipped(spark, corpus, small_tree):
    lost = spark.createDataFrame([("lost.py", 3, None)], corpus({"a": ""}).schema)
    files = corpus(small_tree).union(lost)
    run = analyze_by_rules(files, Settings(), "t", AT)
    assert run.records.count() == 2 and run.statistics.first().files_skipped == 1
    todo = prepare(files, Settings())
    assert "lost.py" not in {r.path for r in todo.prompts.collect()}
    run = complete(todo, reply_to(todo.prompts), Settings(), "t", AT)
    assert run.records.count() == 2 and run.statistics.first().files_skipped == 1


def test_capped_run(corpus):
    run = analyze_by_rules(corpus({f"f{i}.py": "x" for i in range(9)}), Settings(max_files=4), "t", AT)
    assert sorted(r.path for r in run.records.collect()) == ["f0.py", "f1.py", "f2.py", "f3.py"]


def reply_to(prompts, bad=()):
    ok = json.dumps({"summary": "about", "role": "r", "external_dependencies": ["A"]})
    return prompts.select("path", "part", F.when(
        F.col("path").isin(list(bad)), "{broken").otherwise(ok
    ).alias("reply"))


def test_two_runs_with_replies_and_a_store(spark, corpus):
    store = scratch_path(spark, "store")
    long = "".join(f"line {i}\n" for i in range(200))
    files = {"a.py": "same", "b.py": "same", "c.py": long, "d.py": "bad one", "e.py": 'password = "abcdef"'}
    settings = Settings(chunk_token_budget=100)
    first = prepare(corpus(files), settings, store)
    asked = {(r.path, r.part): r.prompt for r in first.prompts.collect()}
    assert ("b.py", 1) not in asked and len([p for p, _ in asked if p == "c.py"]) > 2
    assert "abcdef" not in asked[("e.py", 1)]
    run = complete(first, reply_to(first.prompts, ["d.py"]), settings, "t", AT, store)
    got = {r.path: r for r in run.records.collect()}
    assert set(got) == {"a.py", "b.py", "c.py", "e.py"}
    assert got["c.py"].analyzed_with_chunking and not got["a.py"].analyzed_with_chunking
    assert got["c.py"].insight.external_dependencies == ["A"]
    stats = run.statistics.first()
    assert (stats.files_discovered, stats.files_analyzed, stats.files_skipped) == (5, 4, 1)
    assert stats.llm_calls == len(asked) and stats.estimated_cost_usd > 0
    assert read_store(spark, store, settings.model).count() == 3

    files["f.py"] = "new"
    second = prepare(corpus(files), settings, store)
    assert {r.path for r in second.prompts.collect()} == {"d.py", "f.py"}
    run = complete(second, reply_to(second.prompts), settings, "t", AT, store)
    got = {r.path: (r.from_cache, r.analyzed_with_chunking) for r in run.records.collect()}
    assert got == {
        "a.py": (True, False), "b.py": (True, False), "c.py": (True, False), "e.py": (True, False),
        "d.py": (False, False), "f.py": (False, False),
    }
    off = prepare(corpus(files), Settings(cache_enabled=False), store)
    assert off.looked_up.where("from_cache").count() == 0


def test_replies_that_come_twice_or_never_or_unasked(spark, corpus):
    long = "".join(f"line {i}\n" for i in range(40))
    settings = Settings(chunk_token_budget=25)
    todo = prepare(corpus({"a.py": "one", "c.py": long, "d.py": long + "end"}), settings)
    total = {r.path: r.total for r in todo.prompts.collect()}
    assert total["a.py"] == 1 and total["c.py"] > 2
    ok = json.dumps({"summary": "about", "role": "r"})
    sent = [("a.py", 1), ("a.py", 1), ("z.py", 1), ("a.py", 7)]
    sent += [("c.py", p) for p in range(1, total["c.py"])] + [("c.py", 1)]
    sent += [("d.py", p) for p in range(1, total["d.py"] + 1)] * 2
    rows = [(p, n, ok) for p, n in sent] + [("d.py", 1, "{broken"), ("d.py", 1, ok.replace("about", "about it"))]
    replies = spark.createDataFrame(rows, "path string, part bigint, reply string")
    run = complete(todo, replies, settings, "t", AT)
    got = {r.path: r.insight.summary for r in run.records.collect()}
    assert got == {"a.py": "about", "d.py": " ".join(["about"] * total["d.py"])}
    stats = run.statistics.first()
    # Every reply to a request is paid for, the repeats and the broken one as well.
    assert (stats.files_skipped, stats.llm_calls) == (1, len(rows) - 2)


def test_a_run_goes_on_in_another_session(spark, corpus):
    """Requests of one session, killed half-way through its last stage; replies of another."""
    base = scratch_path(spark, "run")
    settings = Settings(chunk_token_budget=100)
    files = {"a.py": "same", "b.py": "same", "c.py": "other"}
    first = RunFolder(spark, base, "settings 1")
    prepare(corpus(files), settings, None, first)
    assert set(first.log()) == {"keyed", "looked_up", "prompts"}
    with pytest.raises(ValueError):
        RunFolder(spark, base, "settings 2")
    # A stage without its log entry is made again.
    spark.range(3).write.parquet(f"{base}/stages/answered")

    other = spark.newSession()
    run = RunFolder(other, base, "settings 1")
    made = []

    def watched(name, build, stage=run.stage):
        return stage(name, lambda: made.append(name) or build())

    run.stage = watched
    again = other.createDataFrame(corpus(files).collect(), CORPUS.simpleString().removeprefix("struct<").removesuffix(">"))
    todo = prepare(again, settings, None, run)
    assert made == [] and sorted(r.path for r in todo.prompts.collect()) == ["a.py", "c.py"]
    result = complete(todo, reply_to(todo.prompts), settings, "t", AT, run=run)
    assert made == ["answered", "records"]
    assert sorted(r.path for r in result.records.collect()) == ["a.py", "b.py", "c.py"]
    assert result.statistics.first().llm_calls == 2


def test_scratch_tables_are_removed(spark, corpus, small_tree, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    with scratch_scope(spark):
        run = analyze_by_rules(corpus(small_tree), Settings(), "t", AT)
        run.records.write.json(f"{tmp_path}/out")
        assert set(os.listdir(shared)) > before
    assert set(os.listdir(shared)) == before and spark.read.json(f"{tmp_path}/out").count() == 2


def test_stream_takes_in_what_is_new(spark, corpus):
    base = scratch_path(spark, "stream")
    settings = Settings(chunk_token_budget=20)

    def run():
        q = start_worklist(spark, f"{base}/in", f"{base}/out", f"{base}/cp", settings, files_per_batch=1)
        q.awaitTermination()
        return {(r.path, r.part, r.batch) for r in read_worklist(spark, f"{base}/out").collect()}

    def add(files):
        corpus(files).select(*CORPUS.fieldNames()).coalesce(1).write.mode("append").parquet(f"{base}/in")

    add({"a.py": "one", "b.py": "one", "x.md": "no"})
    assert run() == {("a.py", 1, 0)}
    add({"c.py": "one"})
    add({"d.py": "two\n" * 30})
    got = run()
    assert {p for p, _, _ in got} == {"a.py", "d.py"} and len([p for p, _, _ in got if p == "d.py"]) > 1
    assert run() == got
    keys = read_worklist(spark, f"{base}/out").groupBy("key").agg(F.count_distinct("path").alias("n"))
    assert {r.n for r in keys.collect()} == {1}


def test_a_batch_of_the_stream_reads_no_earlier_one(spark, corpus):
    """Twenty batches: each reads its own rows, and the history only as state."""
    base = scratch_path(spark, "stream")
    for i in range(20):
        files = {f"f{i}_{j}.py": f"text {i * 5 + j}" for j in range(10)}
        corpus(files).select(*CORPUS.fieldNames()).coalesce(1).write.mode("append").parquet(f"{base}/in")
    q = start_worklist(spark, f"{base}/in", f"{base}/out", f"{base}/cp", Settings(), files_per_batch=1)
    q.awaitTermination()
    progress = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(progress) == 20 and {p["numInputRows"] for p in progress} == {10}
    state = [p["stateOperators"][0] for p in progress]
    assert [s["numRowsTotal"] for s in state] == [10 + 5 * i for i in range(20)]
    assert sum(s["numRowsUpdated"] for s in state) == 105 == read_worklist(spark, f"{base}/out").count()
    took = sorted(p["durationMs"]["addBatch"] for p in progress[1:8]), sorted(p["durationMs"]["addBatch"] for p in progress[-7:])
    assert took[1][3] < 4 * took[0][3]


def test_usage_stream_closes_windows_and_drops_late_rows(spark):
    base = scratch_path(spark, "usage")
    at = datetime.datetime(2024, 1, 1)

    def add(hours):
        rows = [(at + datetime.timedelta(hours=h), 10) for h in hours]
        spark.createDataFrame(rows, "ts timestamp, tokens long").coalesce(1).write.mode("append").parquet(f"{base}/in")
        calls = spark.readStream.schema("ts timestamp, tokens long").parquet(f"{base}/in")
        start_usage_windows(calls, f"{base}/out", f"{base}/cp").awaitTermination()
        done = spark.read.parquet(f"{base}/out").orderBy("window_start")
        return [(r.window_start.hour, r.calls, r.tokens) for r in done.collect()]

    assert add([0.1, 0.2, 1.5, 3.5]) == [(0, 2, 20), (1, 1, 10)]
    assert add([0.3, 3.6, 9.5]) == [(0, 2, 20), (1, 1, 10), (3, 2, 20)]
