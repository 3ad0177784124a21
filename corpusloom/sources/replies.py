"""Replies of the external model: JSON text to insights, or to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.insight import is_valid
from corpusloom.functions.text import let
from corpusloom.schemas import INSIGHT, OVERVIEW

_BROKEN = "_broken"
_READ = T.StructType([*INSIGHT.fields, T.StructField(_BROKEN, T.StringType())])


def parse_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Add `insight`; null when the reply is no JSON or lacks a required field.

    Lists that are left out are empty.
    """
    parsed = F.from_json(
        F.col(column), _READ, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    )
    return replies.withColumn("insight", let(parsed, _accepted))


def _accepted(p: Column) -> Column:
    no_strings = F.array().cast("array<string>")
    methods = F.transform(
        F.coalesce(p["key_methods"], F.array().cast(INSIGHT["key_methods"].dataType)),
        lambda m: m.withField("parameters", F.coalesce(m["parameters"], no_strings)),
    )
    complete = F.struct(
        p["summary"].alias("summary"),
        p["role"].alias("role"),
        methods.alias("key_methods"),
        F.coalesce(p["external_dependencies"], no_strings).alias("external_dependencies"),
        F.coalesce(p["noteworthy"], no_strings).alias("noteworthy"),
    )
    return F.when(p[_BROKEN].isNull() & is_valid(p), complete)


def parse_overviews(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Add `overview`, from replies to the requests of a fold or of the project; null when
    the reply is no JSON or a text is missing. Lists that are left out are empty."""
    read = T.StructType([*OVERVIEW.fields, T.StructField(_BROKEN, T.StringType())])
    parsed = F.from_json(F.col(column), read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})

    def accepted(p: Column) -> Column:
        texts = [f.name for f in OVERVIEW.fields if f.dataType == T.StringType()]
        good = p[_BROKEN].isNull()
        for name in texts:
            good = good & p[name].isNotNull()
        none = F.array().cast("array<string>")
        return F.when(good, F.struct(*[
            (p[f.name] if f.name in texts else F.coalesce(p[f.name], none)).alias(f.name) for f in OVERVIEW.fields]))

    return replies.withColumn("overview", let(parsed, accepted))


def one_overview_per_part(parsed: DataFrame) -> DataFrame:
    """(level, part, purpose, key_components, ...) of the good reply that sorts first."""
    first = F.min_by("overview", F.struct(F.length("reply"), "reply"))
    good = parsed.where(F.col("overview").isNotNull()).groupBy("level", "part").agg(first.alias("overview"))
    return good.select("level", "part", "overview.*")


def good_replies(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("insight").isNotNull())


def one_per_part(parsed: DataFrame) -> DataFrame:
    """(path, part, insight), the reply that sorts first of each part's good ones.

    The minimum is taken before the shuffle as well, so a part's repeats never gather.
    """
    first = F.min_by("insight", F.struct(F.length("reply"), "reply"))
    return parsed.groupBy("path", "part").agg(first.alias("insight"))


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rejected replies, as they came."""
    return parsed.where(F.col("insight").isNull()).drop("insight")
