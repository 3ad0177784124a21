"""Secret redaction of a text column, with a findings table.

Rules run in order, each on the output of the one before. Every step binds the text
before it once, so the expression grows with the number of rules and no more, also
where the optimizer copies it into a filter. A rule that needs a literal text to
match is skipped by a byte search where that is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import contains_any, explode_structs, let

Rule = tuple[str, str, str]


def _java(pattern: str) -> str:
    # Word and space classes follow Unicode, whatever the Java version's default.
    return "(?U)" + pattern if "\\b" in pattern or "\\s" in pattern else pattern


def _only_if_possible(name: str, text: Column, then: Column, otherwise: Column) -> Column:
    anchors = fv.SECRET_RULE_ANCHORS.get(name)
    return F.when(contains_any(text, anchors), then).otherwise(otherwise) if anchors else then


def redacted_text(text: Column, rules: list[Rule]) -> Column:
    def step(rule: Rule):
        name, pattern, replacement = rule
        return lambda t: _only_if_possible(
            name, t, F.regexp_replace(t, _java(pattern), replacement), t
        )

    for rule in rules:
        text = let(text, step(rule))
    return text


def redacted_and_counted(text: Column, rules: list[Rule]) -> Column:
    """struct<text, counts>: counts is an array<bigint> in rule order, taken on the
    text that each rule met."""

    def step(rule: Rule):
        name, pattern, replacement = rule

        def replace(state: Column) -> Column:
            t = state["text"]
            changed = F.regexp_replace(t, _java(pattern), replacement)
            return F.struct(
                t.alias("before"), _only_if_possible(name, t, changed, t).alias("text"),
                state["counts"].alias("counts"),
            )

        def count(state: Column) -> Column:
            t = state["before"]
            found = F.regexp_count(t, F.lit(_java(pattern))).cast("bigint")
            none = F.lit(0).cast("bigint")
            if name in fv.RULES_THAT_CHANGE_THE_TEXT:
                n = F.when(t == state["text"], none).otherwise(found)
            else:
                n = _only_if_possible(name, t, found, none)
            return F.struct(
                state["text"].alias("text"), F.concat(state["counts"], F.array(n)).alias("counts")
            )

        return lambda state: let(replace(state), count)

    state = F.struct(text.alias("text"), F.array().cast("array<bigint>").alias("counts"))
    for rule in rules:
        state = let(state, step(rule))
    return state


def redact(df: DataFrame, rules: list[Rule], text: str = "content") -> DataFrame:
    """Replace secrets in `text`."""
    return df.withColumn(text, redacted_text(F.col(text), rules))


def redacted(df: DataFrame, rules: list[Rule], text: str = "content") -> DataFrame:
    """Replace secrets in `text` and add their number, `secrets`."""
    total = F.aggregate("_redacted.counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    return (
        df.withColumn("_redacted", redacted_and_counted(F.col(text), rules))
        .withColumns({text: F.col("_redacted.text"), "secrets": total})
        .drop("_redacted")
    )


def findings(df: DataFrame, rules: list[Rule], keys: list[str], text: str = "content") -> DataFrame:
    """One row per text and rule that matched: keys, rule, n."""
    names = F.array(*[F.lit(name) for name, _, _ in rules])
    counted = df.select(*keys, redacted_and_counted(F.col(text), rules)["counts"].alias("_counts"))
    found = F.transform("_counts", lambda n, i: F.struct(F.get(names, i).alias("rule"), n.alias("n")))
    return explode_structs(
        counted.withColumn("_found", F.filter(found, lambda f: f["n"] > 0)), keys, "_found"
    )


def findings_rollup(found: DataFrame, by: list[str]) -> DataFrame:
    """Matches and texts per rule and `by`. A text has one row per rule, so a count
    of rows is a count of texts."""
    return found.groupBy("rule", *by).agg(
        F.sum("n").alias("matches"), F.count("*").alias("texts")
    )
