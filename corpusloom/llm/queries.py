"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import alignment, byte_dedup, jaccard_join, language_id, language_model, mixing, packing, prefix_trie, rules, secrets, token_files, vectors, word_dedup
from corpusloom.llm.tokens import tokenizer_path
from corpusloom.session import cut, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_token_files(spark, sf):
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf, "documents"), path, tokenizer_path())
    tokens = token_files.read_tokens(spark, path, with_ids=False)
    return token_files.with_start(tokens, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op2_jaccard_join(spark, sf):
    return jaccard_join.jaccard_components(table(spark, sf, "documents"), n=3, percent=90)


@query
def op3_suffix_dedup(spark, sf):
    return byte_dedup.dedup(table(spark, sf, "documents"), with_bytes=False)


@query
def op4_substring_dedup(spark, sf):
    return word_dedup.dedup(table(spark, sf, "documents"), with_text=False)


@query
def op5_secret_scans(spark, sf):
    docs = table(spark, sf, "documents")
    ledger = cut(secrets.scan_new(docs, None))
    history = secrets.versions_of(docs, ["doc_id"])
    found = secrets.findings_of(history, ledger, ["doc_id"])

    def of_kind(kind):
        return F.filter("spans", lambda x: x["kind"] == kind)

    base = [r.kind for r in secrets.BASE_RULES]
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in base]
    base_spans = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id", *counts, F.sha2(secrets.listed(base_spans), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query
def op6_quality_rules(spark, sf):
    entries = rules.ledger(table(spark, sf, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.kept_by(rules.POLICIES[0])).alias("base_failed"), rules.kept_by(rules.STANDARD).alias("kept"),
        "failed",
    )


@query
def op7_embedding_dedup(spark, sf):
    return vectors.near_duplicates(table(spark, sf, "embeddings"))


@query
def op8_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path(), with_ids=False)


@query
def op9_language_model(spark, sf):
    return language_model.score(table(spark, sf, "documents"))


@query
def op10_mixing(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op11_prefix_trie(spark, sf):
    return prefix_trie.trie(table(spark, sf, "conversations"))


@query
def op12_language_id(spark, sf):
    return language_id.identify(table(spark, sf, "documents"))


@query
def op13_token_alignment(spark, sf):
    return alignment.score(
        table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
