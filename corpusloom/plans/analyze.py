"""Whole runs, put together from the operators.

A run with an external model has two halves with storage between them: `prepare`
writes requests, `complete` takes the replies in. A rule-based run needs one. The overview
is a fold: `start_reduction` asks, `continue_reduction` takes a level's replies in, until
`finish_reduction` takes in the overview itself.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import token_count
from corpusloom.operators import cache, fold, records, reduce, stats
from corpusloom.operators.discover import (
    discover,
    language_breakdown,
    require_files,
    with_lines,
)
from corpusloom.operators.merge import merge_parts
from corpusloom.operators.prompts import prompt_table
from corpusloom.schemas import INSIGHT, OVERVIEW
from corpusloom.session import cut
from corpusloom.settings import Settings
from corpusloom.sources.replies import good_replies, one_overview_per_part, one_per_part, parse_overviews, parse_replies
from corpusloom.sources.runs import RunFolder, kept
from corpusloom.sources.sinks import analysis_document, metadata
from corpusloom.sources.store import append_store, read_store


@dataclass(frozen=True)
class Prepared:
    files: DataFrame      # file table
    keyed: DataFrame      # path, key, language, lines
    looked_up: DataFrame  # path, key, insight, from_cache
    prompts: DataFrame    # requests for what is not stored


@dataclass(frozen=True)
class Analysis:
    records: DataFrame
    statistics: DataFrame
    languages: DataFrame
    overview: DataFrame
    document: DataFrame
    metadata: DataFrame
    measured: DataFrame   # path, language, lines of every discovered file
    usage: DataFrame
    files_at: str
    seconds: float


def prepare(
    corpus: DataFrame, settings: Settings, store: str | None = None, run: RunFolder | None = None
) -> Prepared:
    """Discover, look up, and list the requests for contents not in the store.

    With a run folder the same call in a later session finds what this one has made.
    """
    files = discover(corpus, settings)
    # Hashing and counting read every text once; all later readers use this table.
    keyed = kept(run, "keyed", lambda: with_lines(cache.with_key(require_files(files), settings.model)).select(
        "path", "key", "language", "lines"
    ))
    stored = None
    if store and settings.cache_enabled:
        stored = read_store(corpus.sparkSession, store, settings.model, keys=keyed)
    # Written down: `complete` adds to the store before it reads this.
    looked_up = kept(run, "looked_up", lambda: _typed(cache.cache_lookup(keyed.select("path", "key"), stored)))
    # The requests lie in storage until they are answered. What was found is not asked for,
    # whatever the store holds by the time that this stage is made.
    missed = looked_up.where(~F.col("from_cache")).select("path", "key")
    prompts = kept(run, "prompts", lambda: prompt_table(cache.work_files(files, missed, None), settings))
    return Prepared(files, keyed, looked_up, prompts)


def _typed(looked_up: DataFrame) -> DataFrame:
    """Without a store the insight is a null of no type, which no file holds."""
    return looked_up.withColumn("insight", F.col("insight").cast(INSIGHT))


def complete(
    prepared: Prepared,
    replies: DataFrame,
    settings: Settings,
    target: str,
    generated_at: str,
    store: str | None = None,
    files_at: str = fv.RECORDS_FOLDER,
    run: RunFolder | None = None,
) -> Analysis:
    """Take in replies (path, part, reply): merge, store, assemble, reduce.

    A file with a missing or rejected part has no record. Copies of an answered text
    share its insight. Replies may come more than once, and for parts that were not
    asked for: one good reply per part counts, but the use of each is paid for.
    """
    began = time.monotonic()
    parsed = parse_replies(replies)
    requested = prepared.prompts.select("path", "part", "total")
    merged = merge_parts(one_per_part(good_replies(parsed)).join(requested, ["path", "part"], "left_semi"))
    asked = requested.groupBy("path").agg(F.max("total").alias("total"))
    whole = merged.join(asked, "path").where("parts = total").select(
        "path", "insight", (F.col("total") > 1).alias("chunked")
    )
    answered = kept(run, "answered", lambda: whole.join(prepared.keyed.select("path", "key"), "path"))
    by_key = answered.select("key", "insight", "chunked")
    if store and settings.cache_enabled:
        append_store(answered.select("path", "key", "insight"), store, settings.model)
    missed = prepared.looked_up.where(~F.col("from_cache")).select("path", "key")
    results = missed.join(by_key, "key")
    made = records.hits_and_results(prepared.looked_up, results)
    recorded = kept(run, "records", lambda: records.assemble(prepared.files, made))
    tokens = prepared.prompts.join(parsed.select("path", "part", "reply"), ["path", "part"])
    usage = tokens.select("prompt_tokens", token_count(F.col("reply")).alias("completion_tokens"))
    return _finish(prepared.keyed, recorded, usage, settings, target, generated_at, files_at, time.monotonic() - began)


def analyze_by_rules(
    corpus: DataFrame, settings: Settings, target: str, generated_at: str, files_at: str = fv.RECORDS_FOLDER,
) -> Analysis:
    """A run without a model. It never touches the store. `files_at` is where the document
    says that the records are; the wall time is that of the passes over the texts."""
    began = time.monotonic()
    files = require_files(discover(corpus, settings))
    made = cut(records.rule_based_records(with_lines(files), settings, keep=("lines", "parts")))
    # A file whose content could not be read is discovered, but has no record.
    recorded = made.where("lines is not null").drop("lines", "parts")
    asked, _ = fold.fold_by_rules(recorded, settings.reduce_budget)
    # What a model would have been asked, without tokens: the parts of the files, the
    # requests of the fold, and the overview.
    calls = made.where("lines is not null").agg(F.coalesce(F.sum("parts"), F.lit(0)).alias("calls"))
    if asked is not None:
        calls = calls.unionByName(asked.agg(F.count("*").alias("calls")))
    calls = calls.unionByName(corpus.sparkSession.range(1).select(F.lit(1).cast("bigint").alias("calls")))
    usage = calls.selectExpr("0 as prompt_tokens", "0 as completion_tokens", "calls")
    return _finish(made, recorded, usage, settings, target, generated_at, files_at, time.monotonic() - began)


def _finish(
    measured: DataFrame, recorded: DataFrame, usage: DataFrame, settings: Settings,
    target: str, generated_at: str, files_at: str, seconds: float,
) -> Analysis:
    """`measured` has path, language and lines of every discovered file."""
    statistics = stats.run_statistics(measured, recorded, usage, settings.model, seconds)
    languages = language_breakdown(measured)
    overview = reduce.overview(recorded, target, top=fv.SHOWN_FACTS)
    meta = metadata(recorded.sparkSession, target, settings.model, generated_at)
    document = analysis_document(meta, overview, statistics, languages, files_at)
    return Analysis(recorded, statistics, languages, overview, document, meta, measured, usage, files_at, seconds)


@dataclass(frozen=True)
class Reduction:
    """The reduce half of a run with a model, between its requests and their replies."""

    target: str
    level: fold.Level
    asked: DataFrame | None   # requests of earlier levels, with their replies
    overview: DataFrame | None  # target, prompt, prompt_tokens: the last request

    @property
    def requests(self) -> DataFrame:
        """What is to be answered now: (level, part, prompt, prompt_tokens)."""
        if self.overview is None:
            return self.level.requests.select("level", "part", "prompt", "prompt_tokens")
        number = F.lit(self.level.number + 1).cast("bigint")
        return self.overview.select(number.alias("level"), F.lit(1).cast("bigint").alias("part"), "prompt", "prompt_tokens")


def start_reduction(analysis: Analysis, settings: Settings, target: str) -> Reduction:
    """The first requests that fold the records of a run to its overview."""
    return _reduction(analysis, fold.first_level(analysis.records, settings.reduce_budget), None, settings, target)


def continue_reduction(
    analysis: Analysis, reduction: Reduction, replies: DataFrame, settings: Settings
) -> Reduction:
    """Take in the replies (level, part, reply) to a level, and ask for the next."""
    answers = one_overview_per_part(parse_overviews(replies))
    level = fold.next_level(reduction.level, answers, settings.reduce_budget)
    return _reduction(analysis, level, _with_replies(reduction, replies), settings, reduction.target)


def _reduction(analysis, level, asked, settings, target) -> Reduction:
    last = None
    if level.done:
        last = cut(reduce.overview_prompt(target, analysis.records, level.lines, settings.max_input_tokens))
    return Reduction(target, level, asked, last)


def _with_replies(reduction: Reduction, replies: DataFrame) -> DataFrame:
    """(prompt_tokens, completion_tokens) of all replies so far; each one is paid for."""
    used = reduction.requests.join(replies.select("level", "part", "reply"), ["level", "part"]).select(
        "prompt_tokens", token_count(F.col("reply")).alias("completion_tokens"))
    return used if reduction.asked is None else reduction.asked.unionByName(used)


def finish_reduction(
    analysis: Analysis, reduction: Reduction, replies: DataFrame, settings: Settings
) -> Analysis:
    """The run with the overview that the model gave. Without a good reply the overview
    made by rule stays; the use of the replies counts in either case."""
    if reduction.overview is None:
        raise ValueError("the fold has levels left to answer")
    began = time.monotonic()
    usage = analysis.usage.select("prompt_tokens", "completion_tokens").unionByName(_with_replies(reduction, replies))
    given = one_overview_per_part(parse_overviews(replies)).where(F.col("level") == reduction.level.number + 1)
    fields = OVERVIEW.fieldNames()
    ranked = given.select(F.lit(0).alias("by_rule"), *fields).unionByName(
        analysis.overview.select(F.lit(1).alias("by_rule"), *fields))
    overview = cut(ranked.orderBy("by_rule").limit(1).select(*fields))
    seconds = analysis.seconds + time.monotonic() - began
    statistics = stats.run_statistics(analysis.measured, analysis.records, usage, settings.model, seconds)
    document = analysis_document(analysis.metadata, overview, statistics, analysis.languages, analysis.files_at)
    return replace(analysis, statistics=statistics, overview=overview, document=document, usage=usage, seconds=seconds)
