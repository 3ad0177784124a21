import hashlib
import re

from pyspark.sql import functions as F

from corpusloom.functions.insight import insight
from corpusloom.operators import cache
from corpusloom.session import scratch_path
from corpusloom.sources import store
from corpusloom.sources.store import append_store, read_store


def keyed(spark, pairs, model="m"):
    df = spark.createDataFrame(pairs, "path string, content string")
    return cache.with_key(df, model)


def with_rules(df):
    return df.withColumn("insight", insight(F.col("content"), F.col("path"), F.lit("r")))


def test_key_is_of_version_model_and_content(spark):
    got = keyed(spark, [("a", "text é"), ("b", "text é"), ("c", "other")]).collect()
    want = hashlib.sha256("v1\x00m\x00text é".encode()).hexdigest()
    assert got[0].key == got[1].key == want != got[2].key


def test_store_hits_and_misses(spark):
    path = scratch_path(spark, "store")
    first = with_rules(keyed(spark, [("a", "one"), ("b", "two"), ("c", "two")]))
    append_store(first.select("path", "key", "insight"), path, "m")
    append_store(first.select("path", "key", "insight"), path, "m")
    assert read_store(spark, path, "m").count() == 2
    assert read_store(spark, path, "other").count() == 0
    now = keyed(spark, [("a", "one"), ("b", "two changed"), ("d", "two")])
    found = cache.cache_lookup(now.select("path", "key"), read_store(spark, path, "m"))
    got = {r.path: (r.from_cache, r.insight and r.insight.summary) for r in found.collect()}
    assert got == {
        "a": (True, "[dry-run] A r (a)."), "b": (False, None), "d": (True, "[dry-run] A r (b).")
    }
    left = cache.worklist(now.select("path", "key"), read_store(spark, path, "m"))
    assert [r.path for r in left.collect()] == ["b"]
    off = cache.cache_lookup(now.select("path", "key"), None)
    assert {r.from_cache for r in off.collect()} == {False}
    other = keyed(spark, [("a", "one")], "other")
    assert cache.worklist(other, read_store(spark, path, "other")).count() == 1


def test_commits_side_by_side_and_half_done(spark):
    """Two writers that did not see one another, one that died before its manifest, and a
    compaction: one row per key throughout, the later writer's."""
    path = scratch_path(spark, "store")
    base = with_rules(keyed(spark, [("a", "one")])).select("path", "key", "insight")
    first = store.append_store(base, path, "m")
    a = with_rules(keyed(spark, [("x", "two"), ("y", "three")])).select("path", "key", "insight")
    b = with_rules(keyed(spark, [("z", "two"), ("w", "four")])).select("path", "key", "insight")
    seen = store.commits(spark, path)
    ids = []
    for rows in (a, b):
        ids.append(store._commit_id())
        store._write(rows, path, ids[-1], "m", "v1")
    store._write(with_rules(keyed(spark, [("l", "lost")])), path, store._commit_id(), "m", "v1")
    for i in ids:
        store._publish(spark, path, i, seen)
    assert store._side_by_side(store.commits(spark, path)) == set(ids)
    got = read_store(spark, path, "m")
    assert got.count() == 4 == got.select("key").distinct().count()
    two = keyed(spark, [("q", "two")]).first().key
    assert got.where(F.col("key") == two).first().insight.summary == "[dry-run] A r (z)."
    assert store.append_store(b, path, "m") is None
    assert store.compact_store(spark, path) and list(store.commits(spark, path)) != [first]
    assert len(store.commits(spark, path)) == 1
    again = read_store(spark, path, "m")
    assert sorted(r.insight.summary for r in again.collect()) == sorted(r.insight.summary for r in got.collect())
    # A writer that had seen what was replaced meanwhile has seen its replacement.
    late = store._commit_id()
    store._write(with_rules(keyed(spark, [("n", "new")])), path, late, "m", "v1")
    store._publish(spark, path, late, {first, *ids})
    assert not store._side_by_side(store.commits(spark, path)) and read_store(spark, path, "m").count() == 5


def test_a_lookup_reads_its_prefixes_only(spark):
    path = scratch_path(spark, "store")
    df = with_rules(keyed(spark, [(f"p{i}", f"text {i}") for i in range(200)])).select("path", "key", "insight")
    append_store(df, path, "m")
    keys = df.where(F.substring("key", 1, 1).isin("3", "b")).select("key")
    got = read_store(spark, path, "m", keys=keys)
    assert got.count() == keys.count() > 5
    # The prefix is a folder, so the filter on it decides which folders are listed.
    assert got.inputFiles() and all("/prefix=" in f for f in got.inputFiles())
    kept = {line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "prefix#" in line and "Filter" in line}
    assert any("IN (3,b)" in line or "IN (b,3)" in line for line in kept)


def test_texts_of_stored_files_cross_no_exchange(spark):
    """The filter on the paths to be sent stands between the scan and the exchange."""
    path = scratch_path(spark, "texts")
    spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(300)], "path string, content string").write.parquet(path)
    files = spark.read.parquet(path)
    some = cache.with_key(files, "m").select("path", "key")
    stored = some.where("path <> 'p7'").select("key")
    with_threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        work = cache.work_files(files, some, stored)
        assert [r.path for r in work.collect()] == ["p7"]
        plan = work._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"Exchange hashpartitioning\(path#[^\n]*\n[^\n]*Filter [^\n]*getbit", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_threshold)
    from corpusloom.operators.prefilter import prefiltered

    kept = prefiltered(files, files.where("path like 'p1%'"), "path").count()
    assert files.where("path like 'p1%'").count() <= kept < 130


def test_a_broken_entry_is_a_miss(spark):
    path = scratch_path(spark, "store")
    df = with_rules(keyed(spark, [("a", "one"), ("b", "two")]))
    broken = df.withColumn("insight", F.when(
        F.col("path") == "a", F.col("insight").withField("role", F.lit(None).cast("string"))
    ).otherwise(F.col("insight")))
    append_store(broken.select("path", "key", "insight"), path, "m")
    assert [r.insight.role for r in read_store(spark, path, "m").collect()] == ["r"]


def test_copies_are_sent_once(spark):
    df = keyed(spark, [(f"p{i}", "same") for i in range(50)] + [("q", "own")])
    got = cache.work_files(df.drop("key"), df.select("path", "key"), None).collect()
    assert sorted(r.path for r in got) == ["p0", "q"]


def test_paths_of_one_key_are_split(spark):
    """A third of all paths with one key: the join reads its partition in several parts."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        path = scratch_path(spark, "keyed")
        spark.range(60_000).selectExpr("concat('path/', id, '/', sha2(string(id), 256)) path", "if(id % 3 = 0, 'hot', sha2(string(id), 256)) key").repartition(8).write.parquet(path)
        stored = spark.range(40_000).selectExpr("if(id = 0, 'hot', sha2(string(id), 256)) key").withColumn("insight", F.lit(None).cast("string"))
        found = cache.cache_lookup(spark.read.parquet(path), stored.repartition(8))
        assert found.where("from_cache").count() >= 20_000
        found.collect()
        assert "skew" in found._jdf.queryExecution().executedPlan().toString().lower()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
