"""From file records to the project: digests, package summaries, overview.

Sizes are worked out from lengths; text is put together only where its size is
bounded by a token budget. A package may hold most of the files, so its digest is a
table of bounded parts, numbered with a running sum that splits hot packages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.paths import base_name, package_or_root
from corpusloom.functions.text import fill, token_count, tokens_of_length
from corpusloom.operators.ranking import global_rank, running_sum

_PACKAGE = "package"


def digest_lines(records: DataFrame) -> DataFrame:
    """(path, package, line) of records; package is '(root)' where there is none."""
    line = fill(fv.DIGEST_LINE, role=F.col("insight.role"), path=F.col("path"),
                summary=F.col("insight.summary"))
    return records.select(
        "path", package_or_root(F.col(_PACKAGE)).alias(_PACKAGE), line.alias("line")
    )


def package_tree(files: DataFrame) -> DataFrame:
    """(package, n, line) per package; the tree is the lines in package order."""
    return (
        files.groupBy(package_or_root(F.col(_PACKAGE)).alias(_PACKAGE))
        .agg(F.count("*").alias("n"))
        .withColumn("line", fill(fv.TREE_LINE, package=F.col(_PACKAGE), n=F.col("n")))
    )


def joined_tokens(line: Column) -> Column:
    """Tokens of all lines joined by newlines, as an aggregate over their lengths."""
    n_chars = F.coalesce(F.sum(F.length(line)) + F.count("*") - 1, F.lit(0))
    return tokens_of_length(n_chars)


def digest_budget(lines: DataFrame, budget: int) -> DataFrame:
    """One row: lines, tokens of the whole digest, whether it is over budget."""
    return lines.agg(
        F.count("*").alias("lines"), joined_tokens(F.col("line")).alias("tokens")
    ).withColumn("over_budget", F.col("tokens") > budget)


def package_digests(lines: DataFrame, part_tokens: int) -> DataFrame:
    """(package, part, files, prompt): the digest of a package, in path order.

    A package that fits `part_tokens` is one part. A bigger one is cut where the
    running length passes a multiple of that size, so a part is at most one line
    longer, and no group holds more than a part.
    """
    width = part_tokens * fv.CHARS_PER_TOKEN
    sized = lines.withColumn("_chars", F.length("line").cast("bigint") + 1)
    placed = running_sum(sized, [_PACKAGE], ["path"], "_chars", "_before")
    part = (F.floor(F.col("_before") / width) + 1).cast("bigint")
    digest = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]
    ), "\n")
    return (
        placed.groupBy(_PACKAGE, part.alias("part"))
        .agg(F.count("*").alias("files"), digest.alias("_digest"))
        .select(
            _PACKAGE, "part", "files",
            fill(fv.PACKAGE_PROMPT, package=F.col(_PACKAGE), digest=F.col("_digest")).alias("prompt"),
        )
    )


def rule_based_packages(records: DataFrame, components: int = fv.COMPONENT_LIMIT) -> DataFrame:
    """(package, purpose, key_components) from the records alone.

    Purpose names the size and the most frequent role; components are the first
    file names in path order, ranked before the shuffle.
    """
    named = records.select(
        package_or_root(F.col(_PACKAGE)).alias(_PACKAGE), "path", F.col("insight.role").alias("role")
    )
    roles = named.groupBy(_PACKAGE, "role").agg(F.count("*").alias("n"))
    purposes = roles.groupBy(_PACKAGE).agg(
        F.sum("n").alias("files"),
        F.min(F.struct((-F.col("n")).alias("n"), "role"))["role"].alias("role"),
    )
    rank = F.row_number().over(Window.partitionBy(_PACKAGE).orderBy("path"))
    first = named.withColumn("_rank", rank).where(F.col("_rank") <= components)
    names = first.groupBy(_PACKAGE).agg(
        F.array_sort(F.collect_list(F.struct("_rank", base_name(F.col("path")).alias("name"))))
        .alias("_names")
    )
    return purposes.join(names, _PACKAGE).select(
        _PACKAGE,
        F.concat(F.col("files").cast("string"), F.lit(" files, mostly "), "role", F.lit("."))
        .alias("purpose"),
        F.transform("_names", lambda x: x["name"]).alias("key_components"),
    )


def package_summaries(packages: DataFrame) -> DataFrame:
    """(package, line) from (package, purpose, key_components)."""
    shown = F.array_join(F.slice("key_components", 1, fv.COMPONENT_LIMIT), ", ")
    return packages.select(_PACKAGE, fill(
        fv.PACKAGE_LINE, package=F.col(_PACKAGE), purpose=F.col("purpose"), components=shown
    ).alias("line"))


def truncate_to_budget(lines: DataFrame, budget: int) -> DataFrame:
    """(position, package, line) of the package lines that fit, in package order.

    While the text is over budget and has more than one line, the first half of the
    lines is kept and a note is appended; the note counts from then on. A line of
    rank r is still there after k halvings when r <= n >> k, so each line is put on
    the last level it survives, and the levels (at most 64) are summed up.
    """
    ranked = global_rank(lines, [_PACKAGE])
    total = ranked.agg(F.count("*").alias("n")).first()["n"]
    if total == 0:
        return ranked.select(F.col("rank").alias("position"), _PACKAGE, "line")
    halvings = [k for k in range(64) if k == 0 or (total >> (k - 1)) > 1]
    level = F.size(F.filter(
        F.array(*[F.lit(total >> k).cast("bigint") for k in halvings]), lambda kept: kept >= F.col("rank")
    )) - 1
    sizes = {
        r["level"]: (r["chars"], r["n"])
        for r in ranked.groupBy(level.alias("level")).agg(
            F.sum(F.length("line")).alias("chars"), F.count("*").alias("n")
        ).collect()
    }
    note = len(fv.TRUNCATION_NOTE)
    keep, cut_short = total, False
    for k in halvings:
        chars = sum(c for lv, (c, _) in sizes.items() if lv >= k)
        count = sum(n for lv, (_, n) in sizes.items() if lv >= k)
        keep, cut_short = count, k > 0
        n_chars = chars + count - 1 + (note if cut_short else 0)
        if n_chars // fv.CHARS_PER_TOKEN + 1 <= budget:
            break
    kept = ranked.where(F.col("rank") <= keep).select(
        F.col("rank").alias("position"), _PACKAGE, "line"
    )
    if not cut_short:
        return kept
    spark = lines.sparkSession
    end = spark.range(1).select(
        F.lit(keep + 1).cast("bigint").alias("position"),
        F.lit(None).cast("string").alias(_PACKAGE),
        F.lit(fv.TRUNCATION_NOTE.lstrip("\n")).alias("line"),
    )
    return kept.unionByName(end)


def joined_lines(lines: DataFrame, order: str, text: str) -> DataFrame:
    """One row: all lines joined in order. The caller has tested their size."""
    every = F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"])
    return lines.agg(F.array_join(every, "\n").alias(text))


def fitting_tree(files: DataFrame, budget: int) -> DataFrame:
    """(package, n, line): the package tree, as deep as `budget` tokens allow.

    Packages deeper than that are counted with their prefix, so that every file counts
    once at any depth; the last resort is one line for all. Prefixes are made of packages,
    not of files, and the sizes of all depths come from one aggregation.
    """
    packages = files.groupBy(package_or_root(F.col(_PACKAGE)).alias(_PACKAGE)).agg(F.count("*").alias("n"))
    names = F.split(F.col(_PACKAGE), "[.]")
    deepest = packages.agg(F.max(F.size(names))).first()[0] or 0
    prefix = F.when(F.col("depth") == 0, F.lit(fv.WHOLE_TREE)).when(
        F.size(names) > F.col("depth"), F.array_join(F.slice(names, F.lit(1), F.col("depth")), ".")
    ).otherwise(F.col(_PACKAGE))
    trees = (
        packages.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
        .groupBy("depth", prefix.alias(_PACKAGE)).agg(F.sum("n").alias("n"))
        .withColumn("line", fill(fv.TREE_LINE, package=F.col(_PACKAGE), n=F.col("n")))
    )
    sizes = trees.groupBy("depth").agg(joined_tokens(F.col("line")).alias("tokens")).collect()
    best = max((r["depth"] for r in sizes if r["tokens"] <= budget), default=0)
    return trees.where(F.col("depth") == best).drop("depth")


def tokens_of(chars: int) -> int:
    return chars // fv.CHARS_PER_TOKEN + 1 if chars > 0 else 0


def overview_prompt(
    target: str, files: DataFrame, digest: DataFrame, max_input_tokens: int
) -> DataFrame:
    """One row: target, prompt, prompt_tokens. `digest` (at, line) is the last level of a
    fold, so its size is bounded; the tree gets what it and the wording leave."""
    shell = len(fv.OVERVIEW_PROMPT) + len(target)
    used = digest_budget(digest, 0).first()["tokens"] + tokens_of(shell) + 2
    tree = fitting_tree(files, max(1, max_input_tokens - used))
    row = digest.sparkSession.range(1).select(
        F.lit(target).alias("target"),
        joined_lines(tree, _PACKAGE, "tree").scalar().alias("tree"),
        joined_lines(digest, "at", "digest").scalar().alias("digest"),
    )
    prompt = fill(fv.OVERVIEW_PROMPT, target=F.col("target"), tree=F.col("tree"), digest=F.col("digest"))
    return row.select("target", prompt.alias("prompt")).withColumn(
        "prompt_tokens", token_count(F.col("prompt"))
    )


def overview_facts(records: DataFrame) -> DataFrame:
    """(kind, rank, value): every fact of the overview's lists, ranked within its kind.

    Each list is as long as the corpus has items of its kind; ranks are worked out over
    ranges, so that a kind with very many items is no one task's.
    """
    languages = records.groupBy("language").agg(F.count("*").alias("n"))
    frameworks = records.select(
        F.explode("insight.external_dependencies").alias("framework")
    ).groupBy("framework").agg(F.count("*").alias("n"))
    packages = records.groupBy(package_or_root(F.col(_PACKAGE)).alias(_PACKAGE)).agg(F.count("*").alias("n"))
    roles = records.groupBy(F.col("insight.role").alias("role")).agg(F.count("*").alias("n"))
    entries = records.where(F.col("insight.role") == fv.ROLE_HINTS[0][1])
    risky = records.where(F.col("complexity.band").isin("high", "very_high"))
    none = F.lit(0).cast("bigint")

    def of(kind: str, df: DataFrame, value: Column, weight: Column, order: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), (-weight).cast("bigint").alias("_weight"), order.alias("_order"), value.alias("value"))

    facts = [
        of("primary_language", languages, F.col("language"), F.col("n"), F.col("language")),
        of("frameworks", frameworks, F.col("framework"), F.col("n"), F.col("framework")),
        of("key_components", packages, F.col(_PACKAGE), F.col("n"), F.col(_PACKAGE)),
        of("entry_points", entries, F.col("path"), none, F.col("path")),
        of("notable_patterns", roles, F.col("role"), F.col("n"), F.col("role")),
        of("potential_risks", risky, F.concat("path", F.lit(": "), "complexity.most_complex_function"),
           F.col("complexity.max_cyclomatic_complexity"), F.col("path")),
    ]
    every = facts[0]
    for more in facts[1:]:
        every = every.unionByName(more)
    ranked = running_sum(every.withColumn("_one", F.lit(1).cast("bigint")), ["kind"], ["_weight", "_order"], "_one", "rank")
    return ranked.select("kind", (F.col("rank") + 1).alias("rank"), "value", (-F.col("_weight")).alias("weight"))


def overview(records: DataFrame, name: str, top: int | None = None) -> DataFrame:
    """One row of project facts from the records, made by rule. Lists are whole unless `top`
    says how many of each to show; at scale, write `overview_facts` and show a few."""
    facts = overview_facts(records)
    shown = facts if top is None else facts.where(F.col("rank") <= top)
    kinds = ["frameworks", "key_components", "entry_points", "notable_patterns", "potential_risks"]

    def listed(kind: str) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "value"))))
        return F.transform(mine, lambda x: x["value"]).alias(kind)

    def first(kind: str) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("rank") == 1), F.col("value")))

    size = records.agg(
        F.count("*").alias("files"), F.count_distinct(package_or_root(F.col(_PACKAGE))).alias("packages")
    ).select(F.struct("*")).scalar()
    language, role, package = first("primary_language"), first("notable_patterns"), first("key_components")
    row = shown.agg(language.alias("primary_language"), role.alias("_role"), package.alias("_package"), *map(listed, kinds))
    sized = row.withColumn("_size", size)
    purpose = F.concat(F.lit("A "), F.coalesce("primary_language", F.lit("source")), F.lit(" project of "),
                       F.col("_size.files").cast("string"), F.lit(" files in "), F.col("_size.packages").cast("string"), F.lit(" packages."))
    style = F.concat(F.lit("Mostly "), F.coalesce("_role", F.lit("files")), F.lit("; the largest package is "),
                     F.coalesce("_package", F.lit(fv.ROOT_PACKAGE)), F.lit("."))
    return sized.select(
        F.lit(name).alias("name"), purpose.alias("purpose"), style.alias("architecture_summary"), "primary_language", *kinds)
