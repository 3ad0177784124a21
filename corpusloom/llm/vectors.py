"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learnt on a bounded sample, so that the signs of the rotated vectors are
balanced codes that lose little: alternately the codes nearest to the rotated sample, and
the rotation nearest to the codes (a singular value decomposition). Every vector gets a
code, which is cut into chunks; each chunk and its neighbours at Hamming distance 1 are
the keys of a table. Vectors that meet in any table are compared by their components.

Vectors with equal directions bit for bit (equal components) are one class; a class counts
its members, and one member stands for it. Vectors that meet are compared by blocks as a
matrix product, and only counts and links that join components leave the task; pairs do
not. A key with many vectors is cut into blocks that are compared block by block in many
tasks, so the work is spread and all of it is done. A pair that meets in several tables is
counted in the first.

Vectors of every length link among themselves: a length has its own rotation, and is part
of every key. A rotation is learnt for the most frequent lengths (LEARNT); those of the
others are random ones, which any task makes anew from the length, so no length is left
out. The bits of a chunk follow from the number of vectors, so that a key holds few of
them at any size, and the number of tables from the bits, so that a pair at the threshold
meets in one with probability RECALL.

Null, zero or non-finite vectors link with nothing. A null id has no component. Rows with
equal ids are vectors each, and repeated rows link. Ties cannot arise: all pairs found are
compared. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import pages
from corpusloom.llm.components import components
from corpusloom.llm.ship import ship
from corpusloom.session import cut

#: Vectors on which the rotation is learnt, the first by digest of their components.
SAMPLE = 4096
ROUNDS = 30
#: Bits of a chunk at least, and lengths whose rotation is learnt.
CHUNK_BITS, MOST_BITS, LEARNT = 13, 24, 16
RECALL = 0.995
#: Vectors of one key that are compared in one task.
BLOCK = 512

Projection = tuple[np.ndarray, np.ndarray]


def plan(vectors: int, least: float) -> tuple[int, int]:
    """(bits of a chunk, tables): chunks differ in at most one bit in some table with
    probability RECALL, for a pair at the threshold whose bits differ independently."""
    bits = min(MOST_BITS, max(CHUNK_BITS, int(vectors).bit_length() - 3))
    p = float(np.arccos(np.clip(least, -1, 1)) / np.pi)
    meet = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    # Learnt codes differ in fewer bits than random ones; four tables at least.
    return bits, max(4, int(np.ceil(np.log(1 - RECALL) / np.log(1 - min(meet, 1 - 1e-9)))) - 1)


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 7) -> Projection:
    """(mean, projection): codes are the signs of (x - mean) @ projection.

    A sample of fewer directions than bits is rotated as it is.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, directions = np.linalg.svd(centred, full_matrices=True)
    bits = min(bits, directions.shape[0])
    projection = directions[:bits].T
    reduced = centred @ projection
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds):
        codes = np.where(reduced @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ reduced)
        rotation = right.T @ left.T
    return mean, projection @ rotation


def learn_codes(sample: np.ndarray, bits: int) -> Projection:
    """A projection to `bits` bits: as many rotations as that takes, each learnt from
    another start."""
    parts, seed = [], 7
    while sum(p.shape[1] for p in parts) < bits:
        mean, projection = learn_rotation(sample, bits - sum(p.shape[1] for p in parts), seed=seed)
        parts.append(projection)
        seed += 1
        # Vectors of a few components have few different codes, however many bits.
        if sample.shape[1] < CHUNK_BITS:
            break
    return mean, np.concatenate(parts, axis=1)


def random_codes(width: int, bits: int) -> Projection:
    """The same, for a length that is not learnt."""
    r, parts = np.random.default_rng(width), []
    while sum(p.shape[1] for p in parts) < bits:
        q, _ = np.linalg.qr(r.standard_normal((width, width)) if width <= bits else r.standard_normal((width, bits)))
        parts.append(q)
        if width < CHUNK_BITS:
            break
    return np.zeros(width), np.concatenate(parts, axis=1)[:, :bits]


def chunks_of(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray, chunk_bits: int = CHUNK_BITS) -> np.ndarray:
    """Chunks of the code as integers, one column per table."""
    signs = ((unit - mean) @ projection >= 0).astype(np.int64)
    tables = -(-signs.shape[1] // chunk_bits)
    cuts = np.array_split(np.arange(signs.shape[1]), tables)
    return np.stack([signs[:, c] @ (1 << np.arange(len(c))) for c in cuts], axis=1)


@dataclass(frozen=True)
class Codes:
    """The codes of every length."""

    bits: int
    tables: int
    learnt: dict[int, Projection]

    def chunks(self, unit: np.ndarray) -> np.ndarray:
        width = unit.shape[1]
        projection = self.learnt.get(width) or random_codes(width, self.bits * self.tables)
        return chunks_of(unit, *projection, self.bits)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether chunks differ in at most one bit."""
    x = a ^ b
    return x & (x - 1) == 0


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, usable, class): components as double."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    # Minus zero is zero.
    plain = F.when(usable, F.transform(v, lambda x: x + F.lit(0.0)))
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), plain.alias("v"), usable.alias("usable"),
                          F.xxhash64(plain).alias("h"))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95,
    sample: int = SAMPLE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(_clean(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    good = rows.where("usable and id is not null")
    classes = good.groupBy("h", "v").agg(F.min("id").alias("least_id"), F.count("*").alias("members"))
    # A class is known by a number of its own, as ids may repeat.
    classes = cut(classes.select(
        F.monotonically_increasing_id().alias("first"), "least_id", "v", "members", F.size("v").alias("width"), F.xxhash64("v").alias("order")))
    # A bounded number of lengths, and of each a bounded sample: the smallest digests.
    widths = classes.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(LEARNT).collect()
    if not widths:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"),
                           F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    bits, tables = plan(max(r["n"] for r in widths), least)
    learnt = {}
    for r in widths:
        own = classes.where(F.col("width") == r["width"]).orderBy("order", "least_id").limit(sample)
        x = _matrix(own.select("v").toArrow().column("v"))
        learnt[r["width"]] = learn_codes(x / np.linalg.norm(x, axis=1, keepdims=True), bits * tables)
    codes = spark.sparkContext.broadcast(Codes(bits, tables, learnt))
    key_schema = "first bigint, width int, which int, chunk int"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_width = batch.column("width").to_numpy()
            for width in np.unique(of_width):
                own = batch.filter(pa.array(of_width == width))
                x = _matrix(pa.chunked_array([own.column("v")]))
                chunk = codes.value.chunks(x / np.linalg.norm(x, axis=1, keepdims=True))
                n, count = chunk.shape
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(own.column("first").to_numpy(), count)), pa.array(np.full(n * count, width, np.int32)),
                    pa.array(np.repeat(np.arange(count, dtype=np.int32), n)), pa.array(chunk.T.ravel().astype(np.int32)),
                ], names=["first", "width", "which", "chunk"])

    chunked = cut(classes.select("first", "v", "width").mapInArrow(keys, key_schema))
    # Occupied keys and how many hold them; a row per key of a table of fixed size.
    sizes = chunked.groupBy("width", "which", "chunk").agg(F.count("*").alias("n"))
    neighbours = F.expr(f"transform(sequence(0, {bits}), b -> if(b = 0, chunk, chunk ^ shiftleft(1, b - 1)))")
    wanted = sizes.select("width", "which", F.col("chunk").alias("own"), F.explode(neighbours).alias("chunk"))
    meets = wanted.join(sizes.select("width", "which", "chunk"), ["width", "which", "chunk"]).where("own <= chunk")
    blocks = sizes.select("width", "which", "chunk", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    meets = (
        meets.join(blocks.select("width", "which", F.col("chunk").alias("own"), F.col("blocks").alias("own_blocks")), ["width", "which", "own"])
        .join(blocks, ["width", "which", "chunk"])
        .select("width", "which", "own", "chunk", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("i"), "blocks")
        .select("width", "which", "own", "chunk", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
        .where("own < chunk or i <= j")
    )
    placed = chunked.join(blocks, ["width", "which", "chunk"]).withColumn(
        "block", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int")).select("first", "width", "which", "chunk", "block")
    job = F.xxhash64("width", "which", "own", "chunk", "i", "j")
    named = meets.withColumn("job", job)
    left = named.select("job", "width", "which", F.col("own").alias("chunk"), F.col("i").alias("block"), F.lit(0).alias("side"))
    same = (F.col("own") == F.col("chunk")) & (F.col("i") == F.col("j"))
    right = named.where(~same).select("job", "width", "which", "chunk", F.col("j").alias("block"), F.lit(1).alias("side"))
    sent = left.unionByName(right).join(placed, ["width", "which", "chunk", "block"]).join(
        classes.select("first", "width", "v", "members"), ["first", "width"])
    dealt = sent.select("job", "width", "which", "side", "first", "members", "v").repartition(
        pages.partitions(spark), "job").sortWithinPartitions("job")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in pages.grouped(batches, "job"):
            which = group.column("which")[0].as_py()
            x = _matrix(group.column("v"))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            chunk = codes.value.chunks(x)
            side = group.column("side").to_numpy()
            ids, members = group.column("first").to_numpy(), group.column("members").to_numpy()
            a = np.nonzero(side == 0)[0]
            b = np.nonzero(side == 1)[0]
            alone = not len(b)
            b = a if alone else b
            linked = x[a] @ x[b].T >= least
            for t in range(which):
                linked &= ~_near(chunk[a][:, None, t], chunk[b][None, :, t])
            if alone:
                linked &= ids[a][:, None] != ids[b][None, :]
            if not linked.any():
                continue
            n = np.zeros(len(x), np.int64)
            n[a] += linked @ members[b]
            if not alone:
                n[b] += linked.T @ members[a]
            hit = np.nonzero(n)[0]
            pairs = _forest(linked, ids[a], ids[b])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids[hit], pairs[:, 0]])), pa.array(np.concatenate([n[hit], np.zeros(len(pairs), np.int64)])),
                pa.array(np.concatenate([np.full(len(hit), -1), pairs[:, 1]]), mask=np.arange(len(hit) + len(pairs)) < len(hit)),
            ], names=["first", "n", "other"])

    found = cut(dealt.mapInArrow(compare, "first bigint, n bigint, other bigint"))
    counts = found.where("other is null").groupBy("first").agg(F.sum("n").alias("n"))
    links = found.where("other is not null").select(F.col("first").alias("a"), F.col("other").alias("b"))
    joined = components(links).withColumnRenamed("id", "first")
    known = cut(classes.join(counts, "first", "left").join(joined, "first", "left").select(
        "v", "least_id", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"),
        F.coalesce("component", "first").alias("component")))
    smallest = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_class = known.join(smallest, "component").select("v", "n_links", "component_id")
    of_rows = good.select("row", "h", "v").join(
        per_class.withColumn("h", F.xxhash64("v")), ["h", "v"]).select("row", "n_links", "component_id")
    out = rows.select("row", "id").join(of_rows, "row", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links that join what `linked` joins: a spanning forest, found row by row."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for i in np.nonzero(linked.any(axis=1))[0]:
        for k in b[linked[i]].tolist():
            x, y = root(int(a[i])), root(k)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(a[i]), k))
    return np.array(out, np.int64).reshape(-1, 2)


def candidates_recall(unit: np.ndarray, least: float, sample: int = SAMPLE) -> float:
    """Share of the pairs at or over `least`, by brute force, that meet in some table."""
    bits, tables = plan(len(unit), least)
    chunk = Codes(bits, tables, {unit.shape[1]: learn_codes(unit[:sample], bits * tables)}).chunks(unit)
    a, b = np.nonzero(np.triu(unit @ unit.T >= least, 1))
    if not len(a):
        return 1.0
    return float(np.mean(_near(chunk[a], chunk[b]).any(axis=1)))
