"""Results out: file records as nested JSON or Parquet, the run as one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.operators.records import conforms
from corpusloom.schemas import FILE_RECORD


def write_records(records: DataFrame, path: str, fmt: str = "json") -> None:
    """Validated records, one folder per language. Tasks write what they hold: the
    rows of a big language are not gathered first."""
    if not conforms(records):
        raise ValueError(f"not a file record table: {records.schema.simpleString()}")
    records.write.partitionBy("language").format(fmt).save(path)


def read_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(FILE_RECORD).format(fmt).load(path).select(*FILE_RECORD.fieldNames())


def metadata(spark: SparkSession, target: str, model: str, generated_at: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(fv.SCHEMA_VERSION).alias("schema_version"),
        F.lit(generated_at).alias("generated_at"),
        F.lit(target).alias("target"),
        F.lit(model).alias("model"),
        F.lit(fv.TOOL_VERSION).alias("tool_version"),
    )


def analysis_document(
    meta: DataFrame, overview: DataFrame, statistics: DataFrame, languages: DataFrame, files: str
) -> DataFrame:
    """One row, one JSON value `document`: metadata, overview, statistics, files.

    The file records stay a dataset of their own, as they grow with the corpus: `files`
    says where they are. The languages are bounded by the extension list.
    """
    listed = languages.agg(F.array_sort(
        F.collect_list(F.struct("language", "file_count", "line_count"))
    )).scalar()

    def one(df: DataFrame, *more):
        return df.select(F.struct("*", *more)).scalar()

    return meta.sparkSession.range(1).select(F.to_json(F.struct(
        one(meta).alias("metadata"),
        one(overview).alias("overview"),
        one(statistics, listed.alias("languages")).alias("statistics"),
        F.lit(files).alias("files"),
    )).alias("document"))
