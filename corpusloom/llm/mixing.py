"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. A document's expected copies are its weight
times one factor of its source, at most `most`; the factor is such that the expected
words meet the target. The whole part is taken for certain. The fraction is a document's
inclusion odds: documents are ranked by random odds divided by inclusion odds, which
samples without replacement with unequal probabilities, and are taken in that order as
far as the source's remaining words go (the nearest fit).

The weight is the number of binary digits of the size, so that the sums are of integers,
a source has at most 63 weights, and longer texts, which say more per repetition, are
repeated first. The random number of a document comes from a digest of its id (for a row
with a null id, of its text), so reruns agree.

The order of a source is never sorted in one task: ranks fall into cells, whose totals
are few, and only the rows of the cell in which the target falls are sorted. Documents are
taken in order as long as they fit; then those that still fit, and at last the one that
leaves the least, so that small sources come near their targets as well.

A null text has size 0 and is taken with 0 words. A null source is one, last in order.
Rows with equal ids are documents each, told apart by their text. Equal places are ordered
by that digest, equal rows by where they were read. An empty table gives an empty table;
other columns are not read, but by `take`, which carries them. A very long text is counted
whole, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.prefilter import prefiltered
from corpusloom.session import cut as session_cut

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST = 2
CELLS = 1 << 16
#: Documents of a size class that are asked to fill what a source's cut leaves.
FILLERS = 4
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT, most: int = MOST,
) -> DataFrame:
    """(source, source_size, target) from rows with a source and a size.

    `share_percent` of all sizes is shared by weight; a source stops at `most` times its
    size, and what is over is shared again by weight until no source is above. The
    sources that stop are those with the least size per weight, so that they are a
    prefix of that order: it is found by running sums over one row per source.
    """
    sources = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int"))
    weighted = sources.withColumn("weight", weight.cast("bigint"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * share_percent / F.lit(100.0)
    left = total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rated = weighted.withColumn("rate", left / weight_left)
    stops = F.col("rate") * F.col("weight") > most * F.col("source_size")
    # The first source that does not stop fixes the rate of all from there on.
    fixed = F.min(F.when(~stops, F.struct((F.col("source_size") / F.col("weight")).alias("at"),
                                          F.col("source").isNull().alias("last"), "source", "rate"))).over(everything)
    share = F.coalesce(fixed["rate"] * F.col("weight"), F.lit(float("inf")))
    return rated.select(
        "source", "source_size", F.least(share, (most * F.col("source_size")).cast("double")).alias("target")
    )


def row_key_of(row_id: Column, text: Column) -> Column:
    """A digest of id and text: rows with one id and different texts are different."""
    told = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string"), F.lit(":"))) for c in (row_id, text)]
    return F.md5(F.concat(*told).cast("binary"))


def _random(row_id: Column) -> Column:
    """A number in (0, 1) from a digest."""
    digits = F.conv(F.substring(F.md5(row_id.cast("binary")), 1, 12), 16, 10).cast("bigint")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 48))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST,
) -> DataFrame:
    """(row_key, doc_id, source, size, source_size, target, copies, taken) per row.
    `row_key` is a digest that tells rows apart; equal rows share it and their copies."""
    text, row_id = docs[f"`{text_col}`"].cast("string"), docs[f"`{id_col}`"]
    # The texts are read here, once.
    sized = session_cut(docs.select(
        row_id.alias("doc_id"), docs[f"`{source_col}`"].alias("source"), n_words(text).alias("size"),
        row_key_of(row_id, text).alias("row_key"),
    ).withColumn("weight", F.length(F.bin(F.col("size"))).cast("bigint")).withColumn("row", F.monotonically_increasing_id()))
    targets = source_targets(sized, "source", weights, share_percent, most)

    # One row per source and weight: the factor, with the heaviest stopped at `most`.
    classes = sized.groupBy("source", "weight").agg(F.sum("size").alias("class_size"))
    same = F.col("c.source").eqNullSafe(F.col("t.source"))
    heavier = Window.partitionBy("source").orderBy(F.desc("weight"))
    up, down = heavier.rowsBetween(Window.unboundedPreceding, -1), heavier.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy("source")
    factors = (
        classes.alias("c").join(F.broadcast(targets.alias("t")), same)
        .select("c.source", "weight", "class_size", "source_size", "target")
        .withColumn("factor", F.try_divide(
            F.col("target") - most * F.coalesce(F.sum("class_size").over(up), F.lit(0)),
            F.sum(F.col("weight") * F.col("class_size")).over(down)))
        .withColumn("fits", F.col("factor") * F.col("weight") <= most)
        .withColumn("factor", F.max(F.when(F.col("fits"), F.struct("weight", "factor"))).over(every)["factor"])
        .withColumn("copies_expected", F.least(F.coalesce(F.col("factor") * F.col("weight"), F.lit(float(most))), F.lit(float(most))))
        .withColumn("certain", F.floor("copies_expected"))
        .withColumn("fraction", F.col("copies_expected") - F.col("certain"))
        .withColumn("rest", F.greatest(F.col("target") - F.sum(F.col("certain") * F.col("class_size")).over(every), F.lit(0.0)))
        .select("source", "weight", "source_size", "target", "certain", "fraction", "rest")
    )
    # At most 63 rows per source: the size of the list of sources.
    u = _random(F.col("row_key"))
    odds = F.try_divide(u / (F.lit(1.0) - u), F.col("fraction") / (F.lit(1.0) - F.col("fraction")))
    # Its increasing image in (0, 1), for cells of like size.
    place = F.when(F.col("fraction") > 0, odds / (odds + 1))
    rows = sized.alias("s").join(
        F.broadcast(factors.alias("f")),
        F.col("s.source").eqNullSafe(F.col("f.source")) & (F.col("s.weight") == F.col("f.weight")), "left",
    ).select("row", "row_key", "doc_id", "s.source", "size", "source_size", "target", "certain", "rest", place.alias("place")
             ).withColumn("cell", F.floor(F.col("place") * CELLS).cast("int"))

    # The cell in which each source's remaining words run out.
    cells = rows.where("place is not null").groupBy("source", "cell").agg(
        F.sum("size").alias("cell_size"), F.first("rest").alias("rest"))
    so_far = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        cells.withColumn("before", F.coalesce(F.sum("cell_size").over(so_far), F.lit(0)))
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("cell_size") > F.col("rest")))
        .select("source", F.col("cell").alias("cut_cell"), F.col("before").alias("cut_before"))
    )
    placed = rows.alias("r").join(
        F.broadcast(cut.alias("k")), F.col("r.source").eqNullSafe(F.col("k.source")), "left",
    ).select("r.*", "cut_cell", "cut_before")
    # Without a cut every place fits: the expected fractions are used up.
    inside = F.col("cell") == F.col("cut_cell")
    order = Window.partitionBy("source").orderBy("place", "row_key", "row")
    reach = F.col("cut_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where(inside).withColumn("reach", reach).withColumn("extra", (F.col("reach") <= F.col("rest")).cast("bigint"))
    sure = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.coalesce(
        (F.col("cell") < F.col("cut_cell")), F.col("place").isNotNull() & F.col("cut_cell").isNull()
    ).cast("bigint")).withColumn("reach", F.lit(None).cast("bigint"))
    ranked = session_cut(sure.unionByName(edge))
    more = _fillers(ranked)
    final = ranked.join(more, "row", "left")
    copies = (F.col("certain") + F.col("extra") + F.coalesce("filler", F.lit(0))).cast("bigint")
    return final.select(
        "row_key", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def _fillers(ranked: DataFrame) -> DataFrame:
    """(row, filler): documents beyond the cut of a source that still fit what it leaves, in
    order; the last one may pass the target where that leaves less than stopping before it.
    Of every source and size class the first few in order are asked: a bounded number."""
    spent = ranked.where("place is not null").groupBy("source").agg(
        F.sum(F.when(F.col("extra") == 1, F.col("size")).otherwise(0)).alias("spent"), F.first("rest").alias("left"))
    waiting = ranked.where("place is not null and extra = 0 and size > 0")
    first = Window.partitionBy("source", "size_class").orderBy("place", "row_key", "row")
    asked = (
        waiting.withColumn("size_class", F.length(F.bin(F.col("size"))))
        .withColumn("k", F.row_number().over(first)).where(F.col("k") <= FILLERS)
        .groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "row_key", "row", "size"))).alias("asked"))
    )
    gaps = asked.alias("a").join(spent.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source"))).select(
        "asked", (F.col("left") - F.col("spent")).alias("gap"))
    none = F.array().cast("array<bigint>")
    taken = F.aggregate(
        "asked", F.struct(F.col("gap").alias("gap"), none.alias("rows")),
        lambda acc, x: F.when(x["size"] <= acc["gap"], F.struct(
            (acc["gap"] - x["size"]).alias("gap"), F.array_append(acc["rows"], x["row"]).alias("rows"))).otherwise(acc),
    )
    filled = gaps.select("asked", taken.alias("t"))
    # The one that leaves the least, if that is less than the gap itself.
    over = F.array_min(F.transform(
        F.filter("asked", lambda x: ~F.array_contains(F.col("t.rows"), x["row"])),
        lambda x: F.struct(F.abs(F.col("t.gap") - x["size"]).alias("off"), x["place"], x["row"].alias("row"))))
    last = F.when(over["off"] < F.col("t.gap"), F.array(over["row"])).otherwise(none)
    return filled.select(F.explode(F.concat("t.rows", last)).alias("row")).withColumn("filler", F.lit(1).cast("bigint"))


def take(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken. A row
    travels as one struct, so its columns may have any names. Equal rows are any of them,
    so they share what is taken of them all."""
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])
    keyed = docs.select(row.alias("r"), row_key_of(docs[f"`{id_col}`"], docs[f"`{text_col}`"]).alias("row_key"))
    chosen = session_cut(mix(docs, id_col, text_col, **options).groupBy("row_key").agg(
        F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows")).where("copies > 0"))
    once, several = chosen.where("rows = 1"), chosen.where("rows > 1")
    single = keyed.join(once, "row_key")
    # Rows that differ in other columns only are equal here; one stands for all.
    repeated = prefiltered(keyed, several, "row_key").join(several, "row_key").groupBy("row_key").agg(
        F.first("r").alias("r"), F.first("copies").alias("copies"))
    every = single.select("r", "copies").unionByName(repeated.select("r", "copies"))
    return every.select("r", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col(f"r.`{c}`").alias(c) for c in docs.columns])
