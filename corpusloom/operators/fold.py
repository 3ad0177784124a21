"""A digest of any size folded to one request, level by level, without losing a line.

Lines of a level, in order, are dealt to parts of at most one budget. A part is a request;
its answer is a line of the next level, and the fold ends with the level whose lines fit
one budget. On the first level a part holds lines of one package, on later ones the lines
of neighbouring packages. Parts are worked out from lengths by a running sum over ranges;
texts are put together only within a part. A line longer than half a budget is cut into
pieces, so that no part is over its budget.

A part without a good answer gets a line made by rule from its counts, so that nothing is
lost where a reply is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.paths import base_name
from corpusloom.functions.text import fill, token_count
from corpusloom.operators.ranking import global_rank, running_sum
from corpusloom.operators.reduce import digest_budget, digest_lines
from corpusloom.session import cut

REQUEST = ["level", "part", "label", "first", "last", "files", "role", "names", "prompt", "prompt_tokens"]


@dataclass(frozen=True)
class Level:
    """The lines of a level, and the requests that fold them; none where they fit."""

    number: int
    lines: DataFrame             # at, first, last, files, role, name, line
    requests: DataFrame | None   # REQUEST

    @property
    def done(self) -> bool:
        return self.requests is None


def pieces(lines: DataFrame, width: int) -> DataFrame:
    """Lines of at most `width` characters: longer ones in numbered pieces. A line's files
    count with its first piece."""
    last = F.greatest(F.ceil(F.length("line") / width).cast("int") - 1, F.lit(0))
    cuts = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.col("line"), k * width + 1, F.lit(width)))
    others = [c for c in lines.columns if c not in ("line", "files")]
    return lines.select(*others, "files", F.posexplode(cuts).alias("piece", "line")).withColumn(
        "files", F.when(F.col("piece") == 0, F.col("files")).otherwise(0))


def dealt(lines: DataFrame, group: list[str], order: list[str], budget: int) -> DataFrame:
    """Add `cell`, the part of each piece within its group: where its start falls in steps
    of half a budget. A part is less than a step and one piece, so within the budget."""
    width = max(1, budget * fv.CHARS_PER_TOKEN // 2)
    sized = pieces(lines, width).withColumn("_chars", F.length("line").cast("bigint") + 1)
    placed = running_sum(sized, group, [*order, "piece"], "_chars", "_before")
    return placed.withColumn("cell", F.floor(F.col("_before") / width).cast("bigint")).drop("_chars", "_before")


def _in_order(order: list[str], value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])


def _parts(placed: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """One row per part: what it covers, and its lines as one text."""
    order = [*order, "piece"]
    names = F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("piece") == 0, F.struct(*order, "name")))), lambda x: x["name"]))
    return placed.groupBy(*group, "cell").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("files").cast("bigint").alias("files"),
        F.mode("role", True).alias("role"), F.slice(names, 1, fv.COMPONENT_LIMIT).alias("names"),
        F.array_join(_in_order(order, "line"), "\n").alias("digest"),
    )


def _requests(parts: DataFrame, number: int, label: Column, prompt: Column) -> DataFrame:
    asked = parts.withColumn("label", label).select(
        F.lit(number).cast("bigint").alias("level"), "part", "label", "first", "last", "files", "role", "names",
        prompt.alias("prompt"))
    return cut(asked.withColumn("prompt_tokens", token_count(F.col("prompt"))).select(*REQUEST))


def first_level(records: DataFrame, budget: int) -> Level:
    """The digest lines of the files, and the requests per package where they do not fit."""
    told = records.select("path", F.col("insight.role").alias("role"), base_name(F.col("path")).alias("name"))
    lines = cut(digest_lines(records).join(told, "path").select(
        F.col("path").alias("at"), F.col("package").alias("first"), F.col("package").alias("last"),
        F.lit(1).cast("bigint").alias("files"), "role", "name", "line"))
    if not digest_budget(lines, budget).first()["over_budget"]:
        return Level(0, lines, None)
    grouped = lines.withColumn("package", F.col("first"))
    parts = _parts(dealt(grouped, ["package"], ["at"], budget), ["package"], ["at"])
    numbered = global_rank(parts, ["package", "cell"], "part")
    label = F.when(F.col("cell") > 0, F.concat("package", F.lit(" (part "), (F.col("cell") + 1).cast("string"), F.lit(")"))
                   ).otherwise(F.col("package"))
    prompt = fill(fv.PACKAGE_PROMPT, package=F.col("label"), digest=F.col("digest"))
    return Level(0, lines, _requests(numbered, 1, label, prompt))


def answered(requests: DataFrame, answers: DataFrame | None) -> DataFrame:
    """The lines that answer the requests: from (level, part, purpose, key_components), one
    per part, and by rule where there is none."""
    purpose = F.concat(F.col("files").cast("string"), F.lit(" files, mostly "), "role", F.lit("."))
    if answers is None:
        known = requests.withColumns({"purpose": purpose, "components": F.col("names")})
    else:
        given = answers.select("level", "part", F.col("purpose").alias("_purpose"), F.col("key_components").alias("_components"))
        known = requests.join(given, ["level", "part"], "left").withColumns({
            "purpose": F.coalesce("_purpose", purpose),
            "components": F.when(F.col("_purpose").isNotNull(), F.coalesce("_components", F.array().cast("array<string>")))
            .otherwise(F.col("names")),
        })
    line = fill(fv.PACKAGE_LINE, package=F.col("label"), purpose=F.col("purpose"),
                components=F.array_join(F.slice("components", 1, fv.COMPONENT_LIMIT), ", "))
    return known.select(
        F.lpad(F.col("part").cast("string"), 19, "0").alias("at"), "first", "last", "files", "role",
        F.col("label").alias("name"), line.alias("line"))


def next_level(level: Level, answers: DataFrame | None, budget: int) -> Level:
    """The level that the answers to the requests of `level` make."""
    lines = cut(answered(level.requests, answers))
    number = level.number + 1
    size = digest_budget(lines, budget).first()
    if not size["over_budget"]:
        return Level(number, lines, None)
    parts = _parts(dealt(lines, [], ["at"], budget), [], ["at"]).withColumn("part", F.col("cell") + 1)
    label = F.when(F.col("first") == F.col("last"), F.col("first")).otherwise(F.concat("first", F.lit(" .. "), "last"))
    prompt = fill(fv.PACKAGES_PROMPT, packages=F.col("label"), digest=F.col("digest"))
    requests = _requests(parts, number + 1, label, prompt)
    if requests.count() >= size["lines"]:
        raise ValueError(f"level {number} does not get smaller: a budget of {budget} tokens holds one line")
    return Level(number, lines, requests)


def fold_by_rules(records: DataFrame, budget: int) -> tuple[DataFrame | None, Level]:
    """(all requests of all levels, the last level), every answer made by rule."""
    level, asked = first_level(records, budget), None
    while not level.done:
        asked = level.requests if asked is None else asked.unionByName(level.requests)
        level = next_level(level, None, budget)
    return asked, level
