"""The prefix trie of conversations, rolled up by centroid decomposition.

Every distinct sequence of the first d turns is a node, known by a digest of the sequence:
a polynomial over the digests of its turns, modulo a prime of 127 bits. A conversation's
digests are running sums. They are taken over ranges of the sorted table, and what a range
inherits from those before it is added after, so that a conversation of any length is cut
between tasks. The first turns that a conversation takes from another one are put in front
of its own by arithmetic on the sums.

What a subtree holds is added up by centroids of the parent-edge forest. A component is a
subtree, less subtrees split off before. Its centroid is the deepest node that holds half
of the component's weight, the weight of a node being its members: a component falls apart
into its centroid's children and the rest above, none over half. What the centroid's part
holds is added to the nodes on the path from the centroid to the component's top, and the
pieces are treated alike. The digests of the first member are that path, so it is looked up
and not walked. Components above a bounded weight are split in rounds of Spark jobs, as
many as the logarithm of the weight; those below it are gathered and split on within tasks.

Rows without a conversation id belong to no conversation and are left out. Turns of one
number are ordered by the digest of their role and text, null before all numbers; equal
rows are turns each. A null role or text is empty. Very long texts cross no shuffle: rows
carry digests. An empty table gives no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays, pages
from corpusloom.llm.ship import ship
from corpusloom.session import cut

PRIME = (1 << 127) - 1
BASE = 0x5A17_93C4_E2B0_6F8D_1B3E_77A9_0C45_D2F1
#: Turns that a conversation takes from its group's first one: crc32 modulo this.
SHARED, GROUP = 6, 100
#: Members of a component that is split within a task, and rounds' rows for a broadcast.
LIMIT, HEAVY_BITS = 1 << 15, 17
#: Depths of a conversation that are one key of a join, and ids in a piece of a list.
BLOCK, PIECE = 4096, 2048
_ZERO = bytes(16)


def _number(value: bytes) -> int:
    return int.from_bytes(value, "big")


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def _sums(turns: DataFrame) -> DataFrame:
    """(part, conv_id, i, size, before, after): the turns of each conversation, numbered
    and summed from the start of its range (part) of the sorted table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, i, total, power = TaskContext.get().partitionId(), None, 0, 0, 1
        for batch in batches:
            number, before, after = [], [], []
            for c, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                if c != conv:
                    conv, i, total, power = c, 0, 0, 1
                number.append(i)
                before.append(_bytes(total))
                total = (total + _number(digest) * power) % PRIME
                after.append(_bytes(total))
                power = power * BASE % PRIME
                i += 1
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * batch.num_rows, pa.int32()), batch.column("conv_id"), pa.array(number, pa.int64()),
                batch.column("size"), pa.array(before, pa.binary()), pa.array(after, pa.binary()),
            ], names=["part", "conv_id", "i", "size", "before", "after"])

    return turns.mapInArrow(run, "part int, conv_id bigint, i bigint, size bigint, before binary, after binary")


def inherited(edges: list[tuple[int, int, int, int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """From (part, first conversation, last one, its turns there, its sum there) of each
    range: the turns and the sum that (part, conversation) goes on from."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    conv, turns, total = None, 0, 0
    for part, first, last, n, value in sorted(edges):
        if conv == first:
            out[part, first] = turns, total
        else:
            turns = total = 0
        if last != first:
            turns = total = 0
        conv, total, turns = last, (total + pow(BASE, turns, PRIME) * value) % PRIME, turns + n
    return out


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, size, before, after): every turn with its place in its conversation and
    the sums of the turns before it, without and with it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = cut(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.length(text).cast("bigint").alias("size"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        # Equal rows need not meet in one range.
        F.monotonically_increasing_id().alias("row"),
    ))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    ranged = turns.repartitionByRange(pages.partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    summed = cut(_sums(ranged.select("conv_id", "size", "digest")))
    # One row per range.
    edges = summed.groupBy("part").agg(
        F.min("conv_id").alias("first"),
        F.max(F.struct("conv_id", "i", "after")).alias("last")).collect()
    carried = inherited([(r.part, r.first, r.last.conv_id, r.last.i + 1, _number(r.last.after)) for r in edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "i", "size", "before", "after"]
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            found = set(batch.column("part").unique().to_pylist())
            for (part, conv), (n, total) in carried.items():
                if part not in found:
                    continue
                power = pow(BASE, n, PRIME)
                mask = pc.and_(pc.equal(batch.column("part"), part), pc.equal(batch.column("conv_id"), conv))
                columns["i"] = pc.if_else(mask, pc.add(columns["i"], n), columns["i"])
                for c in ("before", "after"):
                    moved = [_bytes((total + power * _number(v)) % PRIME) for v in columns[c].filter(mask).to_pylist()]
                    columns[c] = pc.replace_with_mask(columns[c], mask, pa.array(moved, pa.binary()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "conv_id bigint, i bigint, size bigint, before binary, after binary"
    return cut(summed.mapInArrow(run, schema)) if carried else summed.drop("part")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent_key, size, weight): the nodes on the way of every
    rebuilt conversation, from the root on. The weight is the number of nodes from there
    to the conversation's end."""
    head = F.struct("i", "after", "size")
    convs = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        # A few turns of each conversation.
        F.sort_array(F.collect_list(F.when(F.col("i") < SHARED - 1, head))).alias("heads"),
    ).withColumn("h", shared_turns(F.col("conv_id"))).withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}"))
    convs = cut(convs)
    first = convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("taken"))
    none = F.array().cast("array<struct<i:bigint,after:binary,size:bigint>>")
    zero = F.lit(_ZERO)
    known = convs.join(first, "base", "left").withColumn("taken", F.slice(F.coalesce("taken", none), F.lit(1), F.col("h")))
    known = known.withColumn("shift", F.size("taken")).withColumn(
        "length", F.col("shift") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    def sum_of(heads: str, k: Column) -> Column:
        return F.when(k > 0, F.get(heads, k - 1)["after"]).otherwise(zero)

    known = cut(known.select(
        "conv_id", "n", "h", "shift", "length", "taken", sum_of("taken", F.col("shift")).alias("start"),
        F.coalesce(sum_of("heads", F.col("h")), zero).alias("left_out"),
    ))
    depth = F.col("depth")
    front = known.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("shift")))).select(
        "conv_id", depth.cast("bigint").alias("depth"), sum_of("taken", depth).alias("key"),
        F.when(depth > 0, sum_of("taken", depth - 1)).alias("parent_key"),
        F.when(depth > 0, F.get("taken", depth - 1)["size"]).otherwise(0).cast("bigint").alias("size"),
        (F.col("length") - depth + 1).alias("weight"),
    )
    # A long conversation is several keys.
    blocks = known.where("n > h").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {BLOCK}"))))
    own = (
        turns.where(F.col("i") >= shared_turns(F.col("conv_id"))).withColumn("block", F.expr(f"i div {BLOCK}"))
        .join(blocks.select("conv_id", "block", "h", "shift", "length", "start", "left_out"), ["conv_id", "block"])
        .select("conv_id", (F.col("i") - F.col("h") + F.col("shift") + 1).alias("depth"), "before", "after", "start",
                "left_out", (F.col("h") - F.col("shift")).alias("moved"), "size", "length")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = [pow(BASE, -k, PRIME) for k in range(SHARED)]
        for batch in batches:
            keys, parents = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("start", "left_out", "moved", "before", "after")), strict=True)
            for start, left_out, moved, before, after in rows:
                start, left_out = _number(start), _number(left_out)
                parents.append(_bytes((start + (_number(before) - left_out) * back[moved]) % PRIME))
                keys.append(_bytes((start + (_number(after) - left_out) * back[moved]) % PRIME))
            weight = pc.add(pc.subtract(batch.column("length"), batch.column("depth")), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("depth"), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()),
                 batch.column("size"), weight], names=["conv_id", "depth", "key", "parent_key", "size", "weight"])

    schema = "conv_id bigint, depth bigint, key binary, parent_key binary, size bigint, weight bigint"
    return cut(front.unionByName(own.mapInArrow(run, schema)))


def nodes_of(paths: DataFrame) -> DataFrame:
    """One row per node: members, the smallest of them, children, and the weight below."""
    nodes = cut(paths.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"),
        F.max("size").alias("size"), F.count("*").alias("n_convs"), F.sum("weight").alias("weight"),
    ))
    kids = nodes.where("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    return cut(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))


def ends_of(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which a conversation ends. Ids are listed piece by
    piece in many tasks; a node's digest then takes its pieces in order, one at a time."""
    ends = paths.where("weight = 1").select("key", "conv_id")
    n = pages.partitions(paths.sparkSession)
    ranged = ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_pylist()
            ids = batch.column("conv_id").to_pylist()
            rows, start = [], 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or key[k] != key[start] or k - start == PIECE:
                    rows.append((key[start], ids[start], ",".join(map(str, ids[start:k]))))
                    start = k
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, found = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    found.append(state.hexdigest())
                now, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    pieces = ranged.mapInArrow(listed, "key binary, first bigint, ids string")
    return pieces.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


def decompose(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of `values` (rows x kinds) over the subtree of every node of a forest, by
    centroids of all its components at once. `parent` is -1 at a component's top; weights
    are those of whole subtrees."""
    n = len(parent)
    order = np.argsort(depth, kind="stable")
    # Places in which every subtree is a range.
    size = np.ones(n, np.int64).tolist()
    up = parent.tolist()
    down = order.tolist()
    for v in reversed(down):
        if up[v] >= 0:
            size[up[v]] += size[v]
    place, free, top = [0] * n, [0] * n, list(range(n))
    used = 0
    for v in down:
        p = up[v]
        if p < 0:
            place[v], used = used, used + size[v]
        else:
            place[v], free[p], top[v] = free[p], free[p] + size[v], top[p]
        free[v] = place[v] + 1
    place, size, top = np.array(place, np.int64), np.array(size, np.int64), np.array(top, np.int64)
    weight = weight.astype(np.int64).copy()
    out = np.zeros_like(values)
    alive = np.arange(n)
    while len(alive):
        tops, comp = np.unique(top[alive], return_inverse=True)
        heavy = 2 * weight[alive] >= weight[tops][comp]
        rows, of = alive[heavy], comp[heavy]
        last = np.lexsort((place[rows], depth[rows], of))
        ends = np.append(np.nonzero(np.diff(of[last]))[0], len(last) - 1)
        centroid = rows[last][ends]
        z = centroid[comp]
        below = (place[alive] >= place[z]) & (place[alive] < place[z] + size[z])
        above = (place[alive] <= place[z]) & (place[z] < place[alive] + size[alive])
        for k in range(values.shape[1]):
            part = np.zeros(len(tops), values.dtype)
            np.add.at(part, comp[below], values[alive[below], k])
            out[alive[above], k] += part[comp[above]]
        taken = weight[centroid].copy()
        path = above & (alive != z)
        weight[alive[path]] -= taken[comp[path]]
        # What is below belongs to the child of the centroid whose range it is in.
        child = below & (parent[alive] == z)
        starts = np.sort(comp[child] * n + place[alive[child]])
        by_start = alive[child][np.argsort(comp[child] * n + place[alive[child]])]
        moved = below & (alive != z)
        if moved.any():
            at = np.searchsorted(starts, comp[moved] * n + place[alive[moved]], side="right") - 1
            top[alive[moved]] = by_start[at]
        alive = alive[alive != z]
    return out


def _split_in_tasks(parts: DataFrame) -> DataFrame:
    """(key, n_leaves, saved) of all nodes of components that fit a task."""
    n = pages.partitions(parts.sparkSession)
    names = ["key", "parent_key", "top", "depth", "weight", "leaf", "saved"]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole components, some at a time."""
        waiting: list[pa.Table] = []
        rows = 0
        for table in by_top(batches):
            waiting.append(table)
            rows += table.num_rows
            if rows >= LIMIT:
                yield pa.concat_tables(waiting)
                waiting, rows = [], 0
        if waiting:
            yield pa.concat_tables(waiting)

    def by_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Runs of whole components of a sorted stream: the last one of a batch may go on."""
        left: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            top = batch.column("top")
            if left and left[0].column("top")[-1] != top[0]:
                yield pa.Table.from_batches(left)
                left = []
            here = pc.index(pc.equal(top, top[-1]), True).as_py()
            if here:
                yield pa.Table.from_batches([*left, batch.slice(0, here)])
                left = []
            left.append(batch.slice(here))
        if left:
            yield pa.Table.from_batches(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            key = table.column("key").combine_chunks()
            parent = pc.index_in(table.column("parent_key").combine_chunks(), value_set=key)
            is_top = pc.equal(key, table.column("top").combine_chunks())
            parent = pc.if_else(is_top, -1, pc.fill_null(parent, -1)).to_numpy(zero_copy_only=False)
            depth, weight, leaf, saved = (table.column(c).to_numpy() for c in names[3:])
            found = decompose(parent.astype(np.int64), depth, weight, np.stack([leaf, saved], axis=1))
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(found[:, 0]), pa.array(found[:, 1])], names=["key", "n_leaves", "saved_tokens"])

    dealt = parts.select(*names).repartition(n, "top").sortWithinPartitions("top")
    return dealt.mapInArrow(run, "key binary, n_leaves bigint, saved_tokens bigint")


def rollup(nodes: DataFrame, paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, n_leaves, saved_tokens) over the subtree of every node."""
    state = nodes.select(
        "key", "parent_key", "conv_id", "depth", "weight", (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), F.lit(_ZERO).alias("top"),
    )
    total = nodes.agg(F.max("weight")).first()[0] or 0
    # No more than 2 ** HEAVY_BITS components can be heavier: that many rows are broadcast.
    limit = max(limit, total >> HEAVY_BITS)
    light, added = [], []
    while True:
        heavy_tops = cut(state.where((F.col("key") == F.col("top")) & (F.col("weight") > limit)).select(
            "top", F.col("weight").alias("all"), F.col("depth").alias("top_depth")))
        if heavy_tops.isEmpty():
            light.append(state)
            break
        light.append(state.join(F.broadcast(heavy_tops), "top", "left_anti"))
        heavy = state.join(F.broadcast(heavy_tops), "top")
        # The deepest node that holds half of its component.
        centroids = cut(heavy.where("2 * weight >= all").groupBy("top", "top_depth").agg(
            F.max(F.struct("depth", (-F.col("conv_id")).alias("order"), "key", "conv_id", "weight")).alias("z")
        ).select("top", "top_depth", F.col("z.key").alias("z"), F.col("z.depth").alias("z_depth"),
                 F.col("z.conv_id").alias("z_conv"), F.col("z.weight").alias("z_weight")))
        placed = heavy.drop("top_depth").join(F.broadcast(centroids), "top").withColumn(
            "below", F.when(F.col("depth") > F.col("z_depth"), F.col("z_depth") + 1)
        ).withColumn("block", F.expr(f"depth div {BLOCK}"))
        # The node of each way one step below the centroid's depth.
        asked = placed.where("below is not null").select("conv_id", "below", "block").distinct()
        step = paths.select("conv_id", F.col("depth").alias("below"), F.col("key").alias("child"), F.col("parent_key").alias("over"))
        found = asked.join(step, ["conv_id", "below"])
        placed = cut(placed.join(found, ["conv_id", "below", "block"], "left").withColumn(
            "inside", F.coalesce(F.col("over") == F.col("z"), F.lit(False))))
        sums = placed.where(F.col("inside") | (F.col("key") == F.col("z"))).groupBy("top").agg(
            F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        # At most one row per component.
        due = cut(centroids.join(F.broadcast(sums), "top"))
        way = paths.select("conv_id", "depth", "key").join(
            F.broadcast(due), (F.col("conv_id") == F.col("z_conv")) & F.col("depth").between(F.col("top_depth"), F.col("z_depth")))
        way = cut(way.select("key", "n_leaves", "saved_tokens", F.when(F.col("key") != F.col("z"), F.col("z_weight")).alias("less")))
        added.append(way.select("key", "n_leaves", "saved_tokens"))
        state = cut(
            placed.where(F.col("key") != F.col("z")).join(way.select("key", "less"), "key", "left")
            .select("key", "parent_key", "conv_id", "depth", (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight"),
                    "leaf", "saved", F.when(F.col("inside"), F.col("child")).otherwise(F.col("top")).alias("top")))
    rest = light[0]
    for more in light[1:]:
        rest = rest.unionByName(more)
    found = _split_in_tasks(rest)
    for more in added:
        found = found.unionByName(more)
    return found.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _parents(nodes: DataFrame) -> DataFrame:
    """(key, parent_conv_id). Parents of very many children are looked up in a list of at
    most 1,000 nodes, the others by a join."""
    total = nodes.agg(F.count("*")).first()[0]
    hot = F.broadcast(nodes.where(F.col("n_children") * 1000 >= max(1, total)).select(
        F.col("key").alias("parent_key"), F.col("conv_id").alias("hot_conv_id")))
    asked = nodes.where("depth > 0").select("key", "parent_key").join(hot, "parent_key", "left")
    others = asked.where("hot_conv_id is null").select("key", "parent_key").join(
        nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key")
    return asked.where("hot_conv_id is not null").select("key", F.col("hot_conv_id").alias("parent_conv_id")).unionByName(
        others.select("key", "parent_conv_id"))


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. Components of more than `limit`
    members are split by Spark jobs."""
    ship(conversations.sparkSession)
    paths = rebuilt(numbered(conversations))
    nodes = nodes_of(paths)
    sums = rollup(nodes, paths, limit)
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(sums, "key").join(_parents(nodes), "key", "left").join(ends_of(paths), "key", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    )
