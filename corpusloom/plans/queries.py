"""Registered queries: every operator over the whole of a given table.

A query takes (spark, sf_dir). Its columns are scalars, so that results can be
compared value by value; the operators themselves keep arrays and structs.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import paths
from corpusloom.functions.text import explode_structs, half_even, line_count, token_count
from corpusloom.operators import (
    cache,
    chunk,
    complexity,
    fold,
    insight,
    merge,
    prompts,
    quality,
    records,
    redact,
    reduce,
    stats,
)
from corpusloom.operators.discover import (
    discover,
    first_files,
    language_breakdown,
    with_lines,
)
from corpusloom.plans.src_view import src, table
from corpusloom.session import cut, local_path, scratch_path, spread
from corpusloom.settings import Settings
from corpusloom.sources.replies import good_replies, one_overview_per_part, parse_overviews, parse_replies
from corpusloom.sources.sinks import analysis_document, metadata, read_records, write_records
from corpusloom.sources.store import append_store, read_store
from corpusloom.sources.tables import corpus_from_table
from corpusloom.sources.tree import scan_tree
from corpusloom.streaming.worklist import read_worklist, start_worklist

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RULES = Settings().secret_rules
CHUNK_BUDGET = 200
PROMPT_BUDGET = 300
HARD_SPLIT_BUDGET = 100
REPORT_BUDGET = 800
SMALL_FILE = 2_000
DIGEST_PART = 100
DIGEST_BUDGET = 600
FOLD_BUDGET = 400
SCAN_PAGE = 8 << 20
TREE_BUDGET = 60
OUTPUT_SHARE = 0.25
GOLDEN_THRESHOLD = 1.5
TARGET = "acme/demo"
GENERATED_AT = "2026-01-01T00:00:00+00:00"
TOKEN_RULE = ("hex-token", r'token = "[0-9a-f]{40}"', 'token = «REDACTED:token»')

# Lines put in front of SRC contents, so that the insight rules have something to find.
HEAD_LINES = """
  case when doc_id % 3 = 0 then 'import lombok.Data;' || chr(10) else '' end
  || case when doc_id % 5 = 0 then 'import org.springframework.web.bind.annotation.GetMapping;' || chr(10) else '' end
  || case when doc_id % 7 = 2 then '@Secured' || chr(10) else '' end
"""
MODEL_OF_CALL = (
    "case conv_id % 5 "
    + " ".join(f"when {i} then '{m}'" for i, m in enumerate(fv.PRICES))
    + " else 'another-model' end"
)


def query(fn: Query) -> Query:
    """Register under the function's name, less the underscore that keeps it apart
    from an operator of the same name."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def files(spark: SparkSession, sf: str, heavy: bool = True, settings: Settings | None = None):
    """Discovered SRC files, with doc_id."""
    return discover(src(spark, sf, heavy), settings, keep=("doc_id",))


def headed_files(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).withColumn("content", F.concat(F.expr(HEAD_LINES), "content"))


def joined(array: Column | str) -> Column:
    return F.array_join(array, "|")


# --- files ----------------------------------------------------------------------


@query
def scan_tree_(spark, sf):
    root = scratch_path(spark, "tree")
    _write_tree(src(spark, sf, heavy=True), root)
    found = discover(scan_tree(spark, root, page_bytes=SCAN_PAGE))
    return found.select(
        "path", "language", "package", "size_bytes", line_count(F.col("content")).alias("lines"),
        F.sha2("content", 256).alias("content_hash"),
    )


def _write_tree(corpus: DataFrame, root: str) -> None:
    """One file per row, written by the tasks below the shared folder."""
    base = local_path(root)

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = os.path.join(base, row["path"])
                os.makedirs(os.path.dirname(file), exist_ok=True)
                with open(file, "w", encoding="utf-8", newline="") as f:
                    f.write(row["content"])
            yield batch.select(["path"])

    corpus.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode(
        "overwrite"
    ).save()


@query
def filter_extension(spark, sf):
    allowed = paths.has_allowed_extension(F.col("path"), fv.SOURCE_EXTENSIONS)
    return src(spark, sf).where(allowed).select(
        "path", paths.extension(F.col("path")).alias("extension")
    )


@query
def filter_excluded_dirs(spark, sf):
    p = F.col("path")
    with_tests = Settings(include_tests=True).active_exclude_dirs
    return src(spark, sf).where(~paths.in_excluded_dir(p, with_tests)).select(
        "path", (~paths.in_excluded_dir(p, fv.EXCLUDED_DIRS)).alias("kept_without_tests")
    )


@query
def filter_size(spark, sf):
    return src(spark, sf).where(paths.size_in_range(F.col("size_bytes"), SMALL_FILE)).select(
        "path", "size_bytes"
    )


@query
def filter_tests(spark, sf):
    return src(spark, sf).select("path", paths.looks_like_test(F.col("path")).alias("is_test"))


@query
def language_of_path(spark, sf):
    return src(spark, sf).select("path", paths.language(F.col("path")).alias("language"))


@query
def package_of_path(spark, sf):
    return src(spark, sf).select("path", paths.package(F.col("path")).alias("package"))


@query
def line_count_(spark, sf):
    return table(spark, sf, "documents").select("doc_id", line_count(F.col("text")).alias("lines"))


@query
def first_n_files(spark, sf):
    return first_files(files(spark, sf, heavy=False).select("path", "size_bytes"), 25)


@query
def discover_(spark, sf):
    return files(spark, sf, heavy=False).select("path", "language", "package", "size_bytes")


@query
def discover_with_tests(spark, sf):
    found = files(spark, sf, heavy=False, settings=Settings(include_tests=True))
    return found.select("path", "language", "package", "size_bytes")


@query
def language_breakdown_(spark, sf):
    return language_breakdown(files(spark, sf, heavy=False))


# --- tokens and chunks --------------------------------------------------------------


@query
def token_count_(spark, sf):
    return table(spark, sf, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


@query
def budget_report(spark, sf):
    return chunk.budget_report(table(spark, sf, "documents"), REPORT_BUDGET, "lang", "text")


@query
def chunk_lines(spark, sf):
    return chunk.chunk_table(files(spark, sf).select("path", "content"), CHUNK_BUDGET)


@query
def chunk_reassemble(spark, sf):
    found = files(spark, sf).select("path", "content")
    whole = chunk.reassemble(chunk.chunk_table(found, CHUNK_BUDGET), "path")
    return found.select("path", F.col("content").alias("original")).join(whole, "path").select(
        "path", "parts", (F.col("content") == F.col("original")).alias("lossless")
    )


@query
def chunk_hard_split(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return chunk.chunk_table(pages, HARD_SPLIT_BUDGET, "html").select(
        "page_id", "part", "total", F.length("text").cast("bigint").alias("n_chars"),
        F.md5("text").alias("text_md5"),
    )


# --- redaction ------------------------------------------------------------------------


@query
def redact_text(spark, sf):
    return redact.redacted(files(spark, sf).select("path", "content"), RULES)


@query
def redaction_findings(spark, sf):
    return redact.findings(files(spark, sf), RULES, ["path"])


@query
def redaction_rollup(spark, sf):
    found = redact.findings(files(spark, sf), RULES, ["language", "package"])
    return redact.findings_rollup(found, ["language", "package"])


@query
def redact_custom(spark, sf):
    documents = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    rules = Settings(extra_rules=(TOKEN_RULE,)).secret_rules
    return redact.redacted(documents, rules, "text").select(
        "doc_id", "secrets", F.md5("text").alias("text_md5")
    )


# --- complexity -----------------------------------------------------------------------


@query
def nloc(spark, sf):
    return complexity.with_methods(files(spark, sf)).select("path", "nloc")


@query
def method_segments(spark, sf):
    return complexity.method_table(files(spark, sf), ["path"])


@query
def file_complexity(spark, sf):
    return complexity.file_complexity(files(spark, sf), ["path"])


@query
def complexity_band(spark, sf):
    return complexity.band_counts(
        complexity.file_complexity(files(spark, sf), ["language"]), ["language"]
    )


@query
def hotspots_topk(spark, sf):
    return complexity.hotspots(complexity.method_table(files(spark, sf), ["path"]), 20)


@query
def hotspots_per_package(spark, sf):
    methods = complexity.method_table(files(spark, sf), ["package", "path"])
    return complexity.hotspots_per(methods, "package", 3).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


# --- rule-based insight ------------------------------------------------------------------


@query
def role_of_path(spark, sf):
    return src(spark, sf).select("path", paths.role(F.col("path")).alias("role"))


@query
def extract_methods(spark, sf):
    found = insight.reported_methods(insight.with_insight(files(spark, sf)), ["path"])
    return found.withColumn("parameters", joined("parameters"))


@query
def methods_capped(spark, sf):
    analyzed = insight.with_insight(files(spark, sf), max_methods=2)
    return insight.reported_methods(analyzed, ["path"]).select("path", "pos", "name")


@query
def framework_hints(spark, sf):
    return insight.framework_table(headed_files(spark, sf), ["path"])


@query
def file_insight(spark, sf):
    return insight.with_insight(headed_files(spark, sf)).select(
        "path", "insight.summary", "insight.role",
        F.size("insight.key_methods").cast("bigint").alias("methods"),
        joined("insight.external_dependencies").alias("external_dependencies"),
        joined("insight.noteworthy").alias("noteworthy"),
    )


# --- keys, cache, prompts -------------------------------------------------------------------


@query
def content_key(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", cache.content_key(F.col("text"), fv.DEFAULT_MODEL).alias("key")
    )


def _keyed(found: DataFrame) -> DataFrame:
    return cache.with_key(found, fv.DEFAULT_MODEL)


def _key_table(found: DataFrame) -> DataFrame:
    """(path, key), written down: hashing reads the texts, and the keys are read again."""
    return cut(_keyed(found).select("path", "key"))


def _stored_even(spark, sf) -> DataFrame:
    """What an earlier run over the even doc_ids would have stored."""
    even = _keyed(files(spark, sf).where("doc_id % 2 = 0"))
    return cut(insight.with_insight(even).select("key", "insight"))


@query
def cache_lookup(spark, sf):
    keyed = _key_table(files(spark, sf))
    found = cache.cache_lookup(keyed, _stored_even(spark, sf))
    return found.select("path", "key", "from_cache", F.col("insight.role").alias("role"))


@query
def cache_off(spark, sf):
    keyed = _keyed(files(spark, sf)).select("path", "key")
    return cache.cache_lookup(keyed, None).select("path", "from_cache")


@query
def prompt_worklist(spark, sf):
    keyed = _keyed(files(spark, sf)).select("path", "key")
    return cache.worklist(keyed, _stored_even(spark, sf))


@query
def prompt_worklist_copies(spark, sf):
    documents = table(spark, sf, "documents").select(
        F.format_string("docs/%s/%08d.py", "source", "doc_id").alias("path"), "text"
    )
    found = discover(corpus_from_table(documents, "path", "text"))
    return cache.worklist(_keyed(found).select("path", "key"), None)


@query
def file_prompts(spark, sf):
    return prompts.prompt_table(files(spark, sf), Settings())


@query
def chunk_prompts(spark, sf):
    return prompts.prompt_table(files(spark, sf), Settings(chunk_token_budget=PROMPT_BUDGET))


@query
def cache_append(spark, sf):
    path = scratch_path(spark, "store")
    made = cut(insight.with_insight(_keyed(files(spark, sf))).select("doc_id", "path", "key", "insight"))
    append_store(made.where("doc_id % 2 = 0").select("path", "key", "insight"), path, fv.DEFAULT_MODEL)
    append_store(made.select("path", "key", "insight"), path, fv.DEFAULT_MODEL)
    return read_store(spark, path, fv.DEFAULT_MODEL).select("key", "insight.summary", "insight.role")


# --- merge --------------------------------------------------------------------------------


def _part_insights(spark, sf) -> DataFrame:
    """Documents in parts of four lines that overlap by two, each line a method and a
    dependency of its part."""
    documents = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    lines = documents.select(
        F.col("doc_id").cast("string").alias("path"), F.split("text", "\n").alias("lines")
    )
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(2))
    parts = F.transform(starts, lambda at, i: F.struct(
        (i + 1).cast("bigint").alias("part"), F.slice("lines", at + 1, F.lit(4)).alias("own")
    ))
    split = explode_structs(lines.withColumn("parts", parts), ["path"], "parts")
    return split.select("path", "part", F.struct(
        F.get("own", F.lit(0)).alias("summary"),
        F.concat(F.lit("role "), (F.col("part") % 3).cast("string")).alias("role"),
        F.transform("own", lambda line: F.struct(
            F.concat(F.lit("p"), F.col("part").cast("string")).alias("name"),
            line.alias("signature"), F.lit("d").alias("description"),
            F.array().cast("array<string>").alias("parameters"),
            F.lit(None).cast("string").alias("returns"),
            F.lit(None).cast("string").alias("visibility"),
        )).alias("key_methods"),
        F.col("own").alias("external_dependencies"),
        F.array().cast("array<string>").alias("noteworthy"),
    ).alias("insight"))


@query
def merge_methods(spark, sf):
    return merge.merge_methods(_part_insights(spark, sf)).select(
        "path", "signature", "name", "part", "pos"
    )


@query
def merge_lists(spark, sf):
    return merge.merge_list(_part_insights(spark, sf), "external_dependencies")


@query
def merge_summary(spark, sf):
    return merge.merge_scalars(_part_insights(spark, sf))


@query
def merge_parts(spark, sf):
    return merge.merge_parts(_part_insights(spark, sf)).select(
        "path", "parts", "insight.role", F.md5("insight.summary").alias("summary_md5"),
        F.size("insight.key_methods").cast("bigint").alias("methods"),
        F.md5(F.array_join("insight.external_dependencies", "\n")).alias("dependencies_md5"),
    )


# --- records ---------------------------------------------------------------------------------


def _records(spark, sf) -> DataFrame:
    return records.rule_based_records(headed_files(spark, sf))


def _flat(found: DataFrame) -> DataFrame:
    return found.select(
        "path", "language", "package", "size_bytes", "complexity.*",
        "insight.summary", "insight.role",
        joined(F.transform("insight.key_methods", lambda m: m["signature"])).alias("signatures"),
        joined("insight.external_dependencies").alias("external_dependencies"),
        joined("insight.noteworthy").alias("noteworthy"),
        "analyzed_with_chunking", "from_cache",
    )


@query
def file_records(spark, sf):
    """Hits from the store, the rest analyzed in chunks, assembled with the metrics."""
    found = files(spark, sf)
    looked_up = cache.cache_lookup(_key_table(found), _stored_even(spark, sf))
    missed = looked_up.where("not from_cache").select("path")
    made = insight.with_insight(
        found.join(missed, "path", "left_semi"), Settings(chunk_token_budget=PROMPT_BUDGET)
    )
    return _flat(records.assemble(found, records.hits_and_results(looked_up, made)))


@query
def file_records_by_rules(spark, sf):
    return _flat(_records(spark, sf))


@query
def file_records_roundtrip(spark, sf):
    path = scratch_path(spark, "records")
    write_records(_records(spark, sf), path, "json")
    return _flat(read_records(spark, path, "json"))


def _replies(spark, sf) -> DataFrame:
    """Replies as a model would give them: every 13th cut short, every 17th (from 5 on)
    without a role."""
    made = insight.with_insight(files(spark, sf))
    reply = F.to_json("insight")
    without_role = F.to_json(F.col("insight").dropFields("role"))
    return cut(made.select(
        "path", F.lit(1).cast("bigint").alias("part"), "doc_id",
        F.when(F.col("doc_id") % 13 == 0, F.substring(reply, F.lit(1), F.length(reply) - 8))
        .when(F.col("doc_id") % 17 == 5, without_role).otherwise(reply).alias("reply"),
    ))


@query
def parse_replies_(spark, sf):
    parsed = parse_replies(_replies(spark, sf))
    return parsed.select(
        "path", F.col("insight").isNotNull().alias("accepted"), F.col("insight.role").alias("role"),
        F.size("insight.key_methods").cast("bigint").alias("methods"),
    ).withColumn("methods", F.when(F.col("accepted"), F.col("methods")))


@query
def skipped_files(spark, sf):
    good = good_replies(parse_replies(_replies(spark, sf)))
    return records.skipped(files(spark, sf), good).select("path", "language")


# --- reduce -----------------------------------------------------------------------------------


@query
def digest_lines(spark, sf):
    return reduce.digest_lines(_records(spark, sf))


@query
def package_tree(spark, sf):
    return reduce.package_tree(files(spark, sf, heavy=False))


@query
def digest_budget(spark, sf):
    return reduce.digest_budget(reduce.digest_lines(_records(spark, sf)), Settings().reduce_budget)


@query
def package_digests(spark, sf):
    return reduce.package_digests(reduce.digest_lines(_records(spark, sf)), DIGEST_PART)


def _package_lines(spark, sf) -> DataFrame:
    return reduce.package_summaries(reduce.rule_based_packages(_records(spark, sf), components=8))


@query
def package_summaries(spark, sf):
    return _package_lines(spark, sf)


@query
def truncate_to_budget(spark, sf):
    return reduce.truncate_to_budget(_package_lines(spark, sf), DIGEST_BUDGET)


@query
def overview_prompt(spark, sf):
    found = cut(_records(spark, sf))
    settings = Settings()
    _, last = fold.fold_by_rules(found, settings.reduce_budget)
    return reduce.overview_prompt(TARGET, found, last.lines, settings.max_input_tokens)


@query
def reduce_requests(spark, sf):
    """All requests that fold the digest to a small budget, every answer made by rule."""
    asked, _ = fold.fold_by_rules(cut(_records(spark, sf)), FOLD_BUDGET)
    return asked.select(
        "level", "part", "label", "first", "last", "files", "role", joined("names").alias("names"),
        "prompt_tokens", F.md5("prompt").alias("prompt_md5"))


@query
def overview_replies(spark, sf):
    """Replies to the first level as a model would give them, every 7th cut short and every
    11th without a purpose, and the lines of the next level."""
    level = fold.first_level(cut(_records(spark, sf)), FOLD_BUDGET)
    purpose = F.concat(F.lit("Covers "), F.col("files").cast("string"), F.lit(" files."))
    fields = {f: F.lit("x") for f in ("name", "architecture_summary", "primary_language")}
    texts = [v.alias(f) for f, v in fields.items()]
    whole = F.to_json(F.struct(*texts, purpose.alias("purpose"), F.reverse("names").alias("key_components")))
    lacking = F.to_json(F.struct(*texts, F.reverse("names").alias("key_components")))
    replies = level.requests.select("level", "part", F.when(F.col("part") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 5))
                                    .when(F.col("part") % 11 == 0, lacking).otherwise(whole).alias("reply"))
    parsed = parse_overviews(replies)
    lines = fold.answered(level.requests, one_overview_per_part(parsed)).select(F.col("at").cast("bigint").alias("part"), "line")
    return parsed.select("level", "part", F.col("overview").isNotNull().alias("accepted")).join(lines, "part")


@query
def fitting_tree(spark, sf):
    """The package tree cut to the depth that a small budget allows."""
    return reduce.fitting_tree(files(spark, sf, heavy=False), TREE_BUDGET)


@query
def overview_facts(spark, sf):
    return reduce.overview_facts(cut(_records(spark, sf)))


@query
def overview(spark, sf):
    facts = reduce.overview(cut(_records(spark, sf)), TARGET, top=fv.SHOWN_FACTS)
    lists = [f.name for f in facts.schema.fields if f.dataType.typeName() == "array"]
    return facts.select(*[joined(f).alias(f) if f in lists else f for f in facts.columns])


# --- statistics --------------------------------------------------------------------------------


def _statistics(spark, sf) -> DataFrame:
    """A run in which the even files were stored and some replies were bad."""
    discovered = with_lines(files(spark, sf)).select("path", "lines")
    parsed = parse_replies(_replies(spark, sf))
    even = F.col("doc_id") % 2 == 0
    made = parsed.where(even | F.col("insight").isNotNull()).select(even.alias("from_cache"))
    usage = parsed.where(~even).select(
        token_count(F.col("path")).alias("prompt_tokens"),
        token_count(F.col("reply")).alias("completion_tokens"),
    )
    return stats.run_statistics(discovered, made, usage, fv.DEFAULT_MODEL)


@query
def run_statistics(spark, sf):
    return _statistics(spark, sf)


@query
def run_rates(spark, sf):
    return stats.run_rates(_statistics(spark, sf))


def _calls(spark, sf) -> DataFrame:
    """A conversation is a call: system and user text in, assistant text out."""
    turns = table(spark, sf, "conversations").select(
        "conv_id", "role", token_count(F.col("text")).alias("tokens")
    )
    def of(*roles: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("role").isin(*roles), F.col("tokens"))), F.lit(0))

    return turns.groupBy("conv_id").agg(
        of("system", "user").alias("prompt_tokens"), of("assistant").alias("completion_tokens")
    )


@query
def usage_totals(spark, sf):
    return stats.usage_totals(_calls(spark, sf))


@query
def usage_cost(spark, sf):
    calls = _calls(spark, sf).withColumn("model", F.expr(MODEL_OF_CALL))
    return stats.with_cost(stats.usage_totals(calls, ["model"]), F.col("model"))


@query
def analysis_document_(spark, sf):
    measured = cut(records.rule_based_records(with_lines(headed_files(spark, sf)), keep=("lines", "parts")))
    made = measured.drop("lines", "parts")
    calls = measured.selectExpr("0 as prompt_tokens", "0 as completion_tokens", "parts as calls")
    return analysis_document(
        metadata(spark, TARGET, fv.DEFAULT_MODEL, GENERATED_AT),
        reduce.overview(made, TARGET, top=fv.SHOWN_FACTS),
        stats.run_statistics(measured, made, calls, fv.DEFAULT_MODEL),
        language_breakdown(measured),
        fv.RECORDS_FOLDER,
    )


# --- quality, increments, forecasts ---------------------------------------------------------------


def _method_names(analyzed: DataFrame) -> DataFrame:
    """Reported names per file, with every 9th (by file and position) altered."""
    names = F.transform("insight.key_methods", lambda m, i: F.when(
        (F.col("doc_id") + i) % 9 == 0, F.concat(F.lit("zz"), m["name"])
    ).otherwise(m["name"]))
    return analyzed.select("path", names.alias("names"))


@query
def hallucinated_methods(spark, sf):
    found = files(spark, sf)
    return quality.unfounded_methods(_method_names(insight.with_insight(found)), quality.occurrence_index(found))


@query
def run_agreement(spark, sf):
    """Three runs; the second changes some roles, the third some summaries."""
    base = insight.with_insight(files(spark, sf)).select(
        "doc_id", "path", "insight.role", "insight.summary",
        F.size("insight.key_methods").cast("bigint").alias("methods"),
    )
    runs = base.select("*", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("run"))
    runs = runs.withColumns({
        "role": F.when((F.col("run") == 2) & (F.col("doc_id") % 10 == 0), "other")
        .otherwise(F.col("role")),
        "summary": F.when((F.col("run") == 3) & (F.col("doc_id") % 7 == 4), "other")
        .otherwise(F.col("summary")),
    })
    return quality.run_agreement(runs, ["role", "summary", "methods"])


@query
def golden_score(spark, sf):
    """Labelled files are the golden set. A low quality label drops the first method of
    the record, a toxic one alters the last; every 8th file has another role."""
    analyzed = insight.with_insight(files(spark, sf)).select(
        "doc_id", "path", "insight.role", "insight.summary",
        F.transform("insight.key_methods", lambda m: m["name"]).alias("names"),
        F.transform("insight.key_methods", lambda m: m["signature"]).alias("signatures"),
    )
    golden = cut(analyzed.join(table(spark, sf, "labels"), "doc_id"))

    def changed(field: str) -> Column:
        kept = F.when(F.col("quality") == 0, F.slice(field, F.lit(2), F.greatest(F.size(field), F.lit(1)))).otherwise(F.col(field))
        return F.transform(kept, lambda v, i: F.when(
            (F.col("toxic") == 1) & (i == F.size(kept) - 1), F.concat(F.lit("zz"), v)
        ).otherwise(v))

    actual = golden.select(
        "path", F.when(F.col("doc_id") % 8 == 0, "other").otherwise(F.col("role")).alias("role"),
        "summary", changed("names").alias("names"), changed("signatures").alias("signatures"),
    )
    scores = quality.golden_scores(actual, golden)
    invented = quality.unfounded_methods(actual, quality.occurrence_index(files(spark, sf)))
    return quality.golden_gate(scores, GOLDEN_THRESHOLD, invented)


@query
def snapshot_diff(spark, sf):
    """The earlier snapshot lacks some files, has other contents, and some more."""
    return quality.snapshot_diff(*_snapshots(spark, sf))


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    keyed = _keyed(files(spark, sf)).select("doc_id", "path", "key")
    rest = F.col("doc_id") % 10
    earlier = keyed.where(rest != 3).withColumn(
        "key", F.when(rest == 5, F.reverse("key")).otherwise(F.col("key"))
    )
    return keyed.where(rest != 4), earlier


@query
def snapshot_folders(spark, sf):
    return quality.snapshot_folders(*_snapshots(spark, sf))


@query
def stream_worklist(spark, sf):
    """SRC written as files, taken in by a stream in several batches."""
    base = scratch_path(spark, "stream")
    src(spark, sf, heavy=True).select("path", "size_bytes", "content").write.parquet(f"{base}/in")
    run = start_worklist(
        spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint",
        Settings(chunk_token_budget=PROMPT_BUDGET), files_per_batch=4,
    )
    run.awaitTermination()
    return read_worklist(spark, f"{base}/out").select("key", "path", "part", "total", "prompt_tokens")


@query
def rollup_levels(spark, sf):
    return stats.rollup_levels(files(spark, sf, heavy=False))


@query
def cost_forecast(spark, sf):
    sized = table(spark, sf, "documents").select("lang", token_count(F.col("text")).alias("tokens"))
    return stats.cost_forecast(sized, "lang", fv.DEFAULT_MODEL, OUTPUT_SHARE)


@query
def usage_windows(spark, sf):
    calls = table(spark, sf, "events").select(
        "ts", F.get_json_object("props", "$.k").cast("bigint").alias("tokens")
    )
    return stats.usage_windows(calls)


# --- flagship ------------------------------------------------------------------------------------


@query
def package_overview(spark, sf):
    """Per package: size, complexity, bands and secrets, in one pass and one shuffle."""
    found = files(spark, sf).drop("doc_id")
    known = complexity.with_metrics(with_lines(found))
    known = redact.redacted(known, RULES)
    bands = [F.count_if(F.col("band") == b).alias(f"{b}_files") for b in ("low", "moderate", "high", "very_high")]
    average = F.col("average_cyclomatic_complexity")
    return known.groupBy(paths.package_or_root(F.col("package")).alias("package")).agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("nloc").alias("nloc"),
        F.sum("function_count").alias("methods"),
        # Sums of hundredths are exact, whatever order the rows come in.
        half_even(F.sum(F.round(average * 100).cast("bigint")) / F.count("*") / 100, 2).alias("mean_complexity"),
        F.max("max_cyclomatic_complexity").alias("max_complexity"),
        *bands, F.sum("secrets").alias("secrets"),
    )
