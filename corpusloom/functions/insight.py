"""Rule-based insight of a source text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import code, paths
from corpusloom.functions.text import fill, let

_VISIBILITY = r"\b(public|private|protected)\b"
_ONLY_VISIBILITY = ["public", "private", "protected"]


def frameworks(text: Column) -> Column:
    """Names of the frameworks hinted at, distinct and sorted."""
    hits = [
        F.when(F.contains(text, F.lit(hint)), F.lit(name))
        for hint, name in fv.FRAMEWORK_HINTS.items()
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def methods(text: Column, role: Column, limit: int | None = None) -> Column:
    """array<METHOD> of all methods, or of the first `limit`.

    A header whose type is itself a visibility keyword is a constructor: the keyword
    is its visibility and it returns nothing.
    """

    def describe(seg: Column) -> Column:
        constructor = seg["type"].isin(_ONLY_VISIBILITY)
        modifiers = F.when(constructor, seg["type"]).otherwise(seg["modifiers"])
        returns = F.when(constructor, F.lit(None)).otherwise(F.nullif(seg["type"], F.lit("")))
        visibility = F.nullif(F.regexp_extract(modifiers, _VISIBILITY, 1), F.lit(""))
        call = F.concat(seg["name"], F.lit("("), F.trim(seg["params"]), F.lit(")"))
        declared = F.transform(F.split(seg["params"], ","), lambda p: F.regexp_replace(
            p, r"^\s+|\s+$", ""
        ))
        return F.struct(
            seg["name"].alias("name"),
            F.concat_ws(" ", F.nullif(modifiers, F.lit("")), returns, call).alias("signature"),
            fill(fv.METHOD_DESCRIPTION, name=seg["name"], role=role).alias("description"),
            F.filter(declared, lambda p: p != "").alias("parameters"),
            returns.alias("returns"),
            F.coalesce(visibility, F.lit("package")).alias("visibility"),
        )

    found = code.segments(text)
    return F.transform(found if limit is None else F.slice(found, 1, limit), describe)


def insight(text: Column, path: Column, role: Column, limit: int | None = None) -> Column:
    """INSIGHT struct of one text (a file, or one chunk of it)."""
    secured = F.when(
        F.contains(text, F.lit(fv.SECURED_MARK)), F.array(F.lit(fv.SECURED_NOTE))
    ).otherwise(F.array().cast("array<string>"))
    return F.struct(
        fill(fv.FILE_SUMMARY, role=role, name=paths.base_name(path)).alias("summary"),
        role.alias("role"),
        methods(text, role, limit).alias("key_methods"),
        frameworks(text).alias("external_dependencies"),
        secured.alias("noteworthy"),
    )


def merged(parts: Column) -> Column:
    """One INSIGHT from array<INSIGHT> in part order.

    Role of the first part; methods once per signature and list items once, in order
    of first occurrence; summaries joined. One part stays as it is.
    """

    def combine(ordered: Column) -> Column:
        every = F.flatten(F.transform(ordered, lambda p: p["key_methods"]))
        told = F.filter(F.transform(ordered, lambda p: p["summary"]), lambda s: s != "")

        def union(field: str) -> Column:
            return F.array_distinct(F.flatten(F.transform(ordered, lambda p: p[field])))

        return F.when(F.size(ordered) == 1, ordered[0]).otherwise(F.struct(
            F.array_join(told, " ").alias("summary"),
            ordered[0]["role"].alias("role"),
            let(every, _first_per_signature).alias("key_methods"),
            union("external_dependencies").alias("external_dependencies"),
            union("noteworthy").alias("noteworthy"),
        ))

    return let(parts, combine)


def _first_per_signature(every: Column) -> Column:
    signatures = F.transform(every, lambda m: m["signature"])
    return let(signatures, lambda seen: F.filter(
        every, lambda m, i: F.array_position(seen, m["signature"]) == i + 1
    ))


def is_valid(value: Column) -> Column:
    """Required fields of an INSIGHT are there; a null or half-read one is not valid."""
    complete = F.forall(F.coalesce(value["key_methods"], F.array()), lambda m: (
        m["name"].isNotNull() & m["signature"].isNotNull() & m["description"].isNotNull()
    ))
    return F.coalesce(
        value["summary"].isNotNull() & value["role"].isNotNull() & complete, F.lit(False)
    )
