"""Which files take part, and what their paths say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.functions.text import line_count
from corpusloom.settings import Settings


def file_filter(settings: Settings):
    """The predicate of a run over (path, size_bytes); content is never touched."""
    path, size = F.col("path"), F.col("size_bytes")
    keep = (
        paths.size_in_range(size, settings.max_file_bytes)
        & paths.has_allowed_extension(path, settings.source_extensions)
        & ~paths.in_excluded_dir(path, settings.active_exclude_dirs)
    )
    if not settings.include_tests:
        keep = keep & ~paths.looks_like_test(path)
    return keep


def discover(
    corpus: DataFrame, settings: Settings | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Corpus (path, size_bytes, content) to file table with language and package.

    `keep` names further columns of the corpus to carry along.
    """
    settings = settings or Settings()
    files = corpus.where(file_filter(settings)).select(
        *keep,
        "path",
        paths.language(F.col("path")).alias("language"),
        paths.package(F.col("path")).alias("package"),
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
        "content",
    )
    return files if settings.max_files is None else first_files(files, settings.max_files)


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first `n` files in path order. Only paths are ordered, each task keeping its
    first `n`; texts stay in place."""
    first = files.select("path").orderBy("path").limit(n)
    return files.join(first, "path", "left_semi")


def require_files(files: DataFrame) -> DataFrame:
    """Fail a run that has nothing to do."""
    if files.isEmpty():
        raise ValueError("no source files matched: check the path, extensions and exclude rules")
    return files


def with_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("lines", line_count(F.col("content")))


def language_breakdown(files: DataFrame) -> DataFrame:
    """Files and lines per language, from a file table or one that has `lines` already."""
    counted = files if "lines" in files.columns else with_lines(files)
    return counted.groupBy("language").agg(
        F.count("*").alias("file_count"), F.sum("lines").alias("line_count")
    )
