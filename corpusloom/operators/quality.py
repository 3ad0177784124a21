"""Checks of results: occurrence, agreement, golden set, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefilter import prefiltered
from corpusloom.session import cut


# A whole identifier, in any script.
IDENTIFIER = r"[\p{L}_$][\p{L}\p{N}_$]*"


def occurrence_index(texts: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """`keep` and `ids`: the hashed distinct identifiers of each text. One row per file,
    made where the text is read, so that what is joined later is narrow."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(IDENTIFIER), F.lit(0)))
    return texts.select(*keep, F.transform(found, lambda name: F.xxhash64(name)).alias("ids"))


def unfounded_methods(reported: DataFrame, index: DataFrame) -> DataFrame:
    """(path, name) of reported methods whose name is no identifier of the file.

    `reported` is (path, names array), `index` the occurrences of the files.
    """
    absent = F.filter("names", lambda name: ~F.array_contains(F.col("ids"), F.xxhash64(name)))
    return reported.join(index.select("path", "ids"), "path").select(
        "path", F.explode(absent).alias("name"))


def run_agreement(runs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, files, agreeing, share) over rows (path, fields...), one per run.

    All runs of a file agree when the smallest and the largest hash of the field are
    equal: two numbers per group, combined before the shuffle.
    """
    hashed = runs.select("path", *[F.xxhash64(F.lit(f), F.col(f)).alias(f) for f in fields])
    equal = hashed.groupBy("path").agg(
        *[(F.min(f) == F.max(f)).alias(f) for f in fields]
    )
    counts = equal.agg(F.count("*").alias("files"), *[F.count_if(f).alias(f) for f in fields])
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("agreeing")) for f in fields
    ])
    return counts.select("files", F.inline(pairs)).select(
        "field", "files", "agreeing",
        F.coalesce(F.try_divide(F.col("agreeing").cast("double"), F.col("files")), F.lit(0.0))
        .alias("share"),
    )


def _points(hits: Column, of: Column) -> Column:
    """2 for all, 1 for at least half, else 0. Nothing to hit counts as all."""
    return F.when(hits >= of, 2).when(hits * 2 >= of, 1).otherwise(0).cast("bigint")


def golden_scores(actual: DataFrame, golden: DataFrame) -> DataFrame:
    """Points 0-2 on four dimensions per golden file.

    Both sides: (path, role, summary, names, signatures). Faithful: reported names
    are in the golden list. Complete: golden names are reported. Exact: signatures of
    the golden list are reported as they are. Role: role and summary are right. A golden
    file without a record has 0 points everywhere.
    """
    g = golden.select("path", *[
        F.col(c).alias(f"golden_{c}") for c in ("role", "summary", "names", "signatures")
    ])
    shared = F.size(F.array_intersect("names", "golden_names"))
    exact = F.size(F.array_intersect("signatures", "golden_signatures"))
    role = (F.col("role") == F.col("golden_role")).cast("bigint")
    summary = (F.col("summary") == F.col("golden_summary")).cast("bigint")
    points = {
        "faithfulness": _points(shared, F.size(F.array_distinct("names"))),
        "completeness": _points(shared, F.size(F.array_distinct("golden_names"))),
        "signature_accuracy": _points(exact, F.size(F.array_distinct("golden_signatures"))),
        "role_summary": role + summary,
    }
    recorded = actual.withColumn("_recorded", F.lit(True))
    return g.join(recorded, "path", "left").select("path", *[
        F.when(F.col("_recorded"), value).otherwise(0).cast("bigint").alias(name) for name, value in points.items()
    ])


DIMENSIONS = ["faithfulness", "completeness", "signature_accuracy", "role_summary"]


def golden_gate(scores: DataFrame, threshold: float, unfounded: DataFrame | None = None) -> DataFrame:
    """One row: files, sum of points per dimension, mean score, invented methods, passed.

    `unfounded` (path, name) are reported methods that their files do not hold: one of
    them in a golden file fails the gate, whatever the mean.
    """
    total = sum((F.sum(d) for d in DIMENSIONS[1:]), F.sum(DIMENSIONS[0]))
    mean = F.try_divide(total.cast("double"), F.count("*") * len(DIMENSIONS))
    invented = F.lit(0).cast("bigint")
    if unfounded is not None:
        invented = unfounded.join(scores.select("path"), "path", "left_semi").agg(F.count("*")).scalar()
    return scores.agg(
        F.count("*").alias("files"), *[F.sum(d).alias(d) for d in DIMENSIONS],
        mean.alias("mean_score"),
    ).withColumn("invented_methods", invented).withColumn(
        "passed", F.coalesce(F.col("mean_score") >= threshold, F.lit(False)) & (F.col("invented_methods") == 0))


def folder_digests(snapshot: DataFrame) -> DataFrame:
    """(folder, files, one, other) from (path, key): a digest of all files below a folder.

    Files are summed up where they lie; folders then hand their sums to the folder above,
    level by level, in one aggregation over folders. Sums do not depend on the order, and
    two of 64 bits tell sets of files apart. The root is the empty folder.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    sums = [F.sum(c).alias(c.split("_")[0]) for c in ("one", "other")]
    own = snapshot.select(
        folder.alias("folder"), F.xxhash64("path", "key").cast("decimal(38,0)").alias("one"),
        F.xxhash64(F.lit("other"), "key", "path").cast("decimal(38,0)").alias("other"),
    ).groupBy("folder").agg(F.count("*").alias("files"), *sums)
    names = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(names))),
                        lambda d: F.array_join(F.slice(names, F.lit(1), d), "/"))
    return own.select(F.explode(above).alias("folder"), "files", "one", "other").groupBy("folder").agg(
        F.sum("files").alias("files"), *sums)


def snapshot_folders(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """(folder, files, earlier_files, same): every folder of either snapshot, and whether
    all that is below it is the same."""
    now, then = folder_digests(current), folder_digests(earlier)
    then = then.select("folder", F.col("files").alias("earlier_files"), F.col("one").alias("then_one"), F.col("other").alias("then_other"))
    same = (F.col("files") == F.col("earlier_files")) & (F.col("one") == F.col("then_one")) & (F.col("other") == F.col("then_other"))
    return now.join(then, "folder", "full_outer").select(
        "folder", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("earlier_files", F.lit(0)).alias("earlier_files"),
        F.coalesce(same, F.lit(False)).alias("same"))


def changed_folders(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """(folder): the folders below which something differs."""
    return snapshot_folders(current, earlier).where(~F.col("same")).select("folder")


def snapshot_diff(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """(path, status): new, deleted, changed or unchanged, from (path, key) tables.

    Files of folders that are the same in both are unchanged and meet no join: only those
    below folders that differ are compared by path.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    now, then = (cut(s.select("path", "key").withColumn("folder", folder)) for s in (current, earlier))
    differing = cut(changed_folders(now, then))
    same = prefiltered(now, differing, "folder", others=True).select("path", F.lit("unchanged").alias("status"))
    now = prefiltered(now, differing, "folder").select("path", F.col("key").alias("now"), F.lit(True).alias("is_now"))
    then = prefiltered(then, differing, "folder").select("path", F.col("key").alias("then"), F.lit(True).alias("was_then"))
    # A path without a key is there all the same: its content could not be read.
    status = (
        F.when(F.col("was_then").isNull(), "new").when(F.col("is_now").isNull(), "deleted")
        .when(F.col("now").eqNullSafe(F.col("then")), "unchanged").otherwise("changed")
    )
    return same.unionByName(now.join(then, "path", "full_outer").select("path", status.alias("status")))
