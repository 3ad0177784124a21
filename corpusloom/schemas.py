"""Declared schemas of the tables that cross a job boundary."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

METHOD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("parameters", STRINGS),
    T.StructField("returns", T.StringType()),
    T.StructField("visibility", T.StringType()),
])

INSIGHT = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("key_methods", T.ArrayType(METHOD)),
    T.StructField("external_dependencies", STRINGS),
    T.StructField("noteworthy", STRINGS),
])

OVERVIEW = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("architecture_summary", T.StringType()),
    T.StructField("primary_language", T.StringType()),
    T.StructField("frameworks", STRINGS),
    T.StructField("key_components", STRINGS),
    T.StructField("entry_points", STRINGS),
    T.StructField("notable_patterns", STRINGS),
    T.StructField("potential_risks", STRINGS),
])

COMPLEXITY = T.StructType([
    T.StructField("nloc", T.LongType()),
    T.StructField("function_count", T.LongType()),
    T.StructField("average_cyclomatic_complexity", T.DoubleType()),
    T.StructField("max_cyclomatic_complexity", T.LongType()),
    T.StructField("most_complex_function", T.StringType()),
    T.StructField("band", T.StringType()),
])

FILE_RECORD = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("package", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("complexity", COMPLEXITY),
    T.StructField("insight", INSIGHT),
    T.StructField("analyzed_with_chunking", T.BooleanType()),
    T.StructField("from_cache", T.BooleanType()),
])

CORPUS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("content", T.StringType()),
])

REPLY = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("reply", T.StringType()),
])

COMPLEXITY_BANDS = ("low", "moderate", "high", "very_high")
