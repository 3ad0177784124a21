"""N-gram Jaccard join by a token-group matrix, for groups of near-duplicate documents.

A document's tokens are the digests of its word shingles. Documents are partitioned into
groups of similar ones; the matrix holds, for each group, the union of its members' tokens
that can decide. A document's overlap with a group's union bounds its overlap with every
member, so only groups that reach the bound are opened, and members are compared exactly.

1. One pass counts tokens that come again within a window of a task's tokens, to order
   tokens from rare to common. The order changes nothing but the work.
2. One pass makes, per document, the number and digest of its tokens, four minima of
   hashes, and its prefix: the tokens of which it must share one with any partner, which
   are its rarest (of n tokens, n - ceil(t * n) + 1).
3. Documents with equal sets are one class. Classes with a common minimum form a group,
   whose pivot, the class with the fewest rare tokens, is compared with the others. Links
   found join groups: the groups of the matrix are the components so far.
4. The matrix has a row per token and group, for prefix tokens. Tokens of one group alone
   are out: every pair within a group is linked already. A class asks the other groups
   that hold its token. What it has in common with a group's union bounds its overlap with
   every member: of a pair, all common tokens but those after the end of one prefix are in
   both prefixes. Groups that reach what a partner of their lengths needs are opened. One
   proved link joins a class to a group, so the members that the matrix names most often
   for the common tokens are compared first. Where that proves nothing, the bound is made
   exact for each member, and members that reach it are compared whole.

A group may hold most documents, and nothing gathers it: pivots are compared one pair at a
time, the matrix has one row for it per token, and pairs within it are not made.

Words are runs of characters other than space and 0x09 to 0x0D, with A-Z lower-cased. A
text with fewer words than a shingle is one shingle; a text without words, or null, has no
tokens and no partner. A null id has no partner either and no component. Repeated rows
are one document. Where one id has several texts, any one of them stands for the id;
`keep_one` tells them apart. A very long text is a slice of its own and is compared whole.
Ties between pivots, or between members to be compared first, go to the smallest id, and
change the work only. An empty table gives an empty table; other columns are not read, but
by `keep_one`, which carries them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import arrays, pages
from corpusloom.llm.components import components
from corpusloom.llm.ship import ship
from corpusloom.operators.prefilter import prefiltered
from corpusloom.operators.ranking import global_rank
from corpusloom.session import batch_bytes, cut

MINIMA = 4
# Bytes of text whose tokens are in memory at a time: a byte has some ten numbers.
SLICE = 1 << 20
# Bytes of an Arrow batch: a task has one in the JVM and two in Python beside its slice.
BATCH = 4 << 20
# Tokens that a task looks through at a time for those that come again.
WINDOW = 1 << 21
# A token that windows see so often, in all, is common; so many of them at most are told.
OFTEN, MOST = 4, 1 << 19
# Cells of the table of common tokens: a fixed size, of which these fill a sixteenth.
CELL_BITS = 23


def token_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens sorted within each row, offsets per row)."""
    raw, offsets = arrays.text_bytes(column)
    starts, ends, rows = arrays.words(raw, offsets)
    hashes = arrays.word_hashes(raw, starts, ends, lower=True)
    counts = np.diff(rows)
    at = arrays.whole_windows(rows, n)
    owner = [arrays.owners(rows)[at]]
    tokens = [arrays.window_hashes(hashes, n)[at]]
    for k in range(1, n):
        short = np.nonzero(counts == k)[0]
        if len(short):
            owner.append(short)
            tokens.append(arrays.window_hashes(hashes, k)[rows[short]])
    owner, tokens = np.concatenate(owner), np.concatenate(tokens)
    order = np.lexsort((tokens, owner))
    owner, tokens = owner[order], tokens[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    owner, tokens = owner[new], tokens[new]
    return tokens, np.searchsorted(owner, np.arange(len(counts) + 1))


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def repeated(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, how often) of the tokens that come more than once."""
    tokens = np.sort(tokens)
    new = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
    at = np.nonzero(new)[0]
    times = np.diff(np.append(at, len(tokens)))
    return tokens[at[times > 1]], times[times > 1]


def common_tokens(docs: DataFrame, text: str, n: int) -> Broadcast:
    """Level per cell of token hashes: 0, or the digits of the count of the most common
    token in it. Tokens that come once in a window are not counted: of the many rare ones
    few are sent, and they do not hide those that are common. At most MOST rows of two
    numbers reach the driver, the highest levels, however large the input is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def sent() -> pa.RecordBatch:
            token, times = repeated(np.concatenate(waiting))
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times, pa.int64())], ["token", "n"])

        for batch in arrays.slices(batches, text, SLICE):
            tokens, _ = token_sets(batch.column(text), n)
            waiting.append(tokens)
            size += len(tokens)
            if size >= WINDOW:
                yield sent()
                waiting, size = [], 0
        if waiting:
            yield sent()

    counted = docs.select(text).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = cut(counted.where(F.col("n") >= OFTEN).select("token", F.length(F.bin("n")).cast("int").alias("level")))
    least, told = 65, 0
    for level, tokens in sorted(found.groupBy("level").count().collect(), reverse=True):
        told += tokens
        if told > MOST:
            break
        least = level
    common = found.where(F.col("level") >= least).toArrow()
    table = np.zeros(1 << CELL_BITS, np.uint8)
    tokens = common.column("token").to_numpy().view(np.uint64)
    np.maximum.at(table, _cell(tokens), common.column("level").to_numpy().astype(np.uint8))
    return docs.sparkSession.sparkContext.broadcast(table)


def _own_needs(n: Column, percent: int) -> Column:
    """As `_needed`, in Spark."""
    return F.floor((n * percent + 99) / 100)


def _pair_needs(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of a linked pair of sets of these sizes."""
    return F.floor(((a + b) * percent + 99 + percent) / (100 + percent))


def _bound(bn: Column, low: Column, high: Column, percent: int) -> Column:
    """Least number of common prefix tokens with any partner of low to high tokens.

    Up to bn it is least at low. Above, it falls by percent^2 / (100 (100 + percent)) a
    token, give or take less than 1 by rounding, so the least is among the last lengths,
    whose number is fixed."""
    last = -(-2 * 100 * (100 + percent) // percent ** 2)
    lengths = [low, *(F.greatest(low, high - k) for k in range(last + 1))]
    return F.least(*[
        _pair_needs(bn, x, percent) - F.greatest(_own_needs(bn, percent), _own_needs(x, percent)) + 1 for x in lengths
    ])


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any partner: ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


# last_level, last: where the prefix ends in the order of all tokens.
SETS = (
    "doc bigint, n bigint, digest bigint, digest2 bigint, minima array<bigint>, rare bigint, "
    "last_level int, last bigint, prefix array<bigint>"
)


def _sets(docs: DataFrame, n: int, percent: int, levels: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text", SLICE):
            tokens, offsets = token_sets(batch.column("text"), n)
            sizes = np.diff(offsets)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            some = np.nonzero(sizes)[0]
            digests, minima = [], []
            for k in range(MINIMA + 2):
                mixed = arrays.mix(tokens ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & (1 << 64) - 1))
                out = np.zeros(len(sizes), np.uint64)
                if len(some):
                    reduce = np.add if k < 2 else np.minimum
                    out[some] = reduce.reduceat(mixed, offsets[:-1][some])
                (digests if k < 2 else minima).append(out.view(np.int64))
            level = levels.value[_cell(tokens)]
            rare = np.bincount(owner[level == 0], minlength=len(sizes))
            order = np.lexsort((tokens.view(np.int64), level, owner))
            keep = np.where(sizes > 0, sizes - _needed(sizes, percent) + 1, 0)
            first = arrays.ranges(sizes) < np.repeat(keep, sizes)
            prefix = tokens[order][first].view(np.int64)
            ends = np.cumsum(keep)
            last = np.where(sizes > 0, prefix[ends - 1], 0) if len(prefix) else np.zeros(len(sizes), np.int64)
            last_level = np.where(sizes > 0, level[order][first][ends - 1], 0) if len(prefix) else np.zeros(len(sizes))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array(sizes, pa.int64()), *map(pa.array, digests),
                pa.ListArray.from_arrays(np.arange(0, MINIMA * len(sizes) + 1, MINIMA, dtype=np.int32),
                                         np.stack(minima, axis=1).ravel()),
                pa.array(rare, pa.int64()), pa.array(last_level.astype(np.int32)), pa.array(last),
                pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), prefix),
            ], names=[x.split()[0] for x in SETS.split(", ")])

    return docs.mapInArrow(run, SETS)


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose similarity reaches the threshold, compared
    exactly. Of `texts` (doc, text) only those in pairs move. The
    first of a pair may be in very many, so pairs of one are dealt to several tasks."""
    spark = texts.sparkSession
    wide = pages.partitions(spark)
    pairs = cut(pairs.where("a <> b").distinct())
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(16)).cast("int"))
    members = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    # Documents in pairs, once, in storage: both sides take their texts from there.
    held = cut(pages.filtered(texts, members, "doc").join(members, "doc").dropDuplicates(["doc"]))
    first = dealt.select("a", "part").distinct().join(held, F.col("a") == F.col("doc")).select(
        "a", "part", F.lit(None).cast("bigint").alias("b"), "text")
    second = dealt.join(held, F.col("b") == F.col("doc")).select("a", "part", "b", "text")
    rows = first.unionByName(second).repartition(wide, "a", "part").sortWithinPartitions(
        "a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, pivot_tokens = None, None
        for batch in arrays.slices(batches, "text", SLICE):
            tokens, offsets = token_sets(batch.column("text"), n)
            out = []
            for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                own = tokens[offsets[k]:offsets[k + 1]]
                if b is None:
                    pivot, pivot_tokens = a, own
                    continue
                assert pivot == a
                where = np.searchsorted(pivot_tokens, own)
                where[where == len(pivot_tokens)] = 0
                common = int((pivot_tokens[where] == own).sum()) if len(pivot_tokens) else 0
                if common and 100 * common >= percent * (len(own) + len(pivot_tokens) - common):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: documents whose shingle sets have
    100 * intersection >= percent * union are linked."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    # All work in Python is done within: what is returned reads written tables.
    with batch_bytes(spark, BATCH):
        return _joined(rows, n, percent)


def _joined(rows: DataFrame, n: int, percent: int) -> DataFrame:
    levels = common_tokens(rows, "text", n)
    sets = cut(_sets(rows, n, percent, levels))

    # A class is a set; its smallest id stands for it.
    full = sets.where("doc is not null and n > 0")
    firsts = full.groupBy("n", "digest", "digest2").agg(F.min("doc").alias("first"))
    members = cut(full.select("doc", "n", "digest", "digest2").join(firsts, ["n", "digest", "digest2"]).select(
        "doc", "first").distinct())
    standing = full.join(members.where("doc = first").select("doc"), "doc", "left_semi").dropDuplicates(["doc"])
    texts = rows.where("doc is not null")

    # Pivots: within each group of a common minimum, the class with the fewest rare tokens.
    minima = standing.select("doc", "n", "rare", F.posexplode("minima").alias("which", "least"))
    pivots = minima.groupBy("which", "least").agg(
        F.min(F.struct((F.col("rare") / F.col("n")).alias("share"), "doc"))["doc"].alias("a"),
        F.min_by("n", F.struct((F.col("rare") / F.col("n")).alias("share"), "doc")).alias("an"), F.count("*").alias("size"),
    ).where("size > 1")
    near = F.least("n", "an") * 100 >= F.greatest("n", "an") * percent
    stars = minima.join(pivots, ["which", "least"]).where(near & (F.col("a") != F.col("doc")))
    # Three minima of four in common, as most similar pairs have; the matrix finds the others.
    close = stars.groupBy("a", F.col("doc").alias("b")).agg(F.count("*").alias("agree")).where("agree >= 3")
    links = cut(_verified(close.select("a", "b"), texts, n, percent))
    groups = components(links)

    # The matrix: prefix tokens that more than one group holds.
    tokens = standing.select("doc", F.explode("prefix").alias("token"))
    grouped = tokens.join(groups.withColumnRenamed("id", "doc"), "doc", "left").select(
        "token", "doc", F.coalesce("component", "doc").alias("group"))
    shared = grouped.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    sizes = standing.select("doc", "n", F.struct("last_level", "last").alias("last"))
    matrix = cut(grouped.join(shared.select("token"), "token", "left_semi").join(sizes, "doc"))
    unions = matrix.groupBy("token", "group").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("doc").alias("one"), F.max("doc").alias("other"),
        F.count("*").alias("holders"))
    asked = matrix.select("token", F.col("doc").alias("b"), F.col("n").alias("bn"), F.col("last").alias("blast"),
                          F.col("group").alias("own")).join(unions, "token").where("own > group")
    # The lengths that can match, and the least that one of them needs.
    low = F.greatest("least", F.ceil(F.col("bn") * percent / 100))
    high = F.least("most", F.floor(F.col("bn") * 100 / percent))
    bound = cut(asked.groupBy("b", "bn", "group").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("common"),
        F.mode("one", True).alias("one"), F.mode("other", True).alias("other"),
    ).where(low <= high).withColumn("need", F.greatest(_bound(F.col("bn"), low, high, percent), F.lit(1))).where(
        F.col("common") >= F.col("need")).select("b", "group", "one", "other", "common", "need"))
    # One proved link joins a class to a group: the members that hold most of the common
    # tokens, as the matrix names them, are compared first.
    likely = bound.select(F.col("one").alias("a"), "b").unionByName(bound.select(F.col("other").alias("a"), "b"))
    links = cut(links.unionByName(_verified(likely, texts, n, percent)))
    now = cut(components(links))

    def side(column: str) -> DataFrame:
        return now.select(F.col("id").alias(column), F.col("component").alias(f"{column}_now"))

    # What is not joined by then is compared with every member that reaches the bound, where
    # a group has members that were not compared: most have one or two.
    sizes_of = matrix.select("group", "doc").distinct().groupBy("group").agg(F.count("*").alias("members"))
    compared = F.when(F.col("one") == F.col("other"), 1).otherwise(2)
    left = cut(bound.join(sizes_of, "group").where(F.col("members") > compared)
               .join(side("b"), "b", "left").join(side("group"), "group", "left").where(
        F.coalesce("b_now", "b") != F.coalesce("group_now", "group")).select("b", "group", "one", "other", "common", "need"))
    # Members that were compared before, or whose length alone rules a link out, are not listed.
    likes = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent
    # A partner has `need` of the common tokens, so one at least of those that are left when
    # the ones that most members hold, all but one of so many, are not listed.
    fewest = Window.partitionBy("b", "group").orderBy("holders", "token")
    told = asked.select("token", "b", "bn", "blast", "group", "holders").join(left, ["b", "group"]).withColumn(
        "place", F.row_number().over(fewest)).where(F.col("place") <= F.col("common") - F.col("need") + 1)
    opened = told.select("token", "b", "bn", "blast", "group", "one", "other", "need").join(
        matrix.select("token", "group", F.col("doc").alias("a"), F.col("n").alias("an"), F.col("last").alias("alast")),
        ["token", "group"]).where(likes & (F.col("a") != F.col("one")) & (F.col("a") != F.col("other")))
    after = F.when(F.col("alast") <= F.col("blast"), _own_needs(F.col("an"), percent)).otherwise(
        _own_needs(F.col("bn"), percent)) - 1
    pairs = opened.groupBy("a", "b", "an", "bn", "alast", "blast", "need").agg(F.count("*").alias("common")).where(
        F.col("common") + F.col("need") - 1 + after >= _pair_needs(F.col("an"), F.col("bn"), percent)).select("a", "b")
    more = _verified(pairs, texts, n, percent)
    found = components(cut(links.unionByName(more)))

    final = members.join(found.select(F.col("id").alias("first"), "component"), "first", "left").groupBy("doc").agg(
        F.min(F.coalesce("component", "first")).alias("component"))
    return sets.select("doc", "n").join(final, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of one document of each component, the one with the smallest id, and those
    without an id, with all columns, whatever their names: a row travels as one struct. Of
    equal rows one is kept. Rows with one id and different texts are documents each: all
    but the first are known by a number beyond all ids."""
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])
    text = F.col("text")
    keyed = docs.select(row.alias("r"), docs[f"`{id_col}`"].cast("bigint").alias("doc"), docs[f"`{text_col}`"].cast("string").alias("text"))
    several = _second_texts(keyed)
    named = keyed
    # As a rule ids tell texts apart, and the rows are read as they are.
    if not several.isEmpty():
        digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
        some = prefiltered(keyed, several, "doc")
        renamed = some.withColumn("digest", digest).join(several, ["doc", "digest"], "left").select(
            "r", F.coalesce("number", "doc").alias("doc"), "text")
        named = prefiltered(keyed, several, "doc", others=True).select("r", "doc", "text").unionByName(renamed)
    found = jaccard_components(named, "doc", "text", **options)
    out = cut(found.where("doc_id = component_id").select(F.col("doc_id").alias("doc")).distinct())
    kept = named.join(out, "doc").groupBy("doc").agg(F.first("r").alias("r"))
    return kept.select("r").unionByName(named.where("doc is null").select("r")).select(
        *[F.col(f"r.`{c}`").alias(c) for c in docs.columns])


def _second_texts(keyed: DataFrame) -> DataFrame:
    """(doc, digest, number): the texts of an id beyond its first, with numbers that no id
    has. There are none where ids tell texts apart."""
    told = cut(keyed.where("doc is not null").select(
        "doc", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).groupBy("doc").agg(
        F.min("digest").alias("least"), F.max("digest").alias("most")))
    largest = told.agg(F.max("doc")).first()[0] or 0
    ids = told.where("least < most").select("doc", "least")
    texts = prefiltered(keyed, ids, "doc").join(ids, "doc").select(
        "doc", "least", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    others = cut(texts.where("digest <> least").select("doc", "digest").distinct())
    return cut(global_rank(others, ["doc", "digest"], "number").withColumn("number", F.col("number") + largest))
