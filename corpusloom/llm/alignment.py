"""Alignment of the tokens of two public tokenizers over whole texts.

Both tokenizers cut the same bytes, a space and the text. Every token points to the token
of the other tokenizer that overlaps it and reaches farthest to the right, or to itself
where none reaches farther; successors are doubled until nothing changes, and then every
token points to the terminal token of its group: the one that ends where tokens of both
tokenizers end. Groups, links (overlapping pairs) and counts follow from the labels.

A text is cut into units before single spaces that ASCII letters, digits or marks follow,
where both tokenizers are known to cut. Units repeat, so that a Python worker aligns each
distinct one once and keeps the answer, up to a bound.

Pairs of ids are counted by the documents that hold them linked, from the distinct pairs
of each document. The most frequent pairs (a fixed number) are broadcast; the others of a
document are joined with the counts, so that a pair in very many documents is no hot key.
What an id of the first tokenizer has at most is a table of at most its vocabulary.

A null or empty text, and one whose tokens do not spell it, has no tokens: zeros and an
empty digest. A null id is kept. Repeated rows are aligned and counted each. An empty
table gives an empty table. Other columns are not read. A very long text is one unit at
least per word; memory is a few times a slice of text, or one text if that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays
from corpusloom.llm.ship import ship
from corpusloom.session import cut

SLICE = 1 << 20
#: Distinct units that a Python worker keeps; beyond it the memory is emptied.
KEPT_UNITS = 300_000
#: Pairs in the broadcast table of counts.
FREQUENT = 1 << 17
_LINE_UNITS = 200
_SPACE = 0x20
# What may follow a space at which a text is cut: never white space of any kind.
_STARTS = np.zeros(256, bool)
_STARTS[0x21:0x7F] = True
_STARTS[0xC3] = True


def _byte_decoder() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for
    themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Tokens:
    """A vocabulary as bytes: of all ids one after another, and where each starts."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        return self.data[np.repeat(self.starts[ids], n) + arrays.ranges(n)]


class ByteBpe:
    """Byte-level pairs: the text is given with its leading space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        decoder = _byte_decoder()
        entries = [b""] * (max(self._tokenizer.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            entries[i] = bytes(decoder[c] for c in token)
        self.tokens = _Tokens(entries)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceBpe:
    """Pieces of a sentence: it adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = []
        for i in range(self._pieces.get_piece_size()):
            piece = self._pieces.id_to_piece(i)
            entries.append(bytes([int(piece[3:5], 16)]) if self._pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.tokens = _Tokens(entries)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._pieces.encode([t[1:] for t in texts], num_threads=1)


def group_labels(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The terminal token of each token's group, for the tokens of A and then of B over the
    same bytes, given where they end. Terminals are tokens of A."""
    n = len(a_ends)
    # The token of the other side that holds a token's last byte reaches farthest.
    to_b = np.searchsorted(b_ends, a_ends, side="left")
    to_a = np.searchsorted(a_ends, b_ends, side="left")
    farther = b_ends[to_b] > a_ends if n else np.zeros(0, bool)
    points = np.concatenate([np.where(farther, n + to_b, np.arange(n)), to_a])
    while True:
        twice = points[points]
        if np.array_equal(twice, points):
            return points
        points = twice


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of all pairs whose bytes overlap, in order."""
    starts = np.concatenate([[0], a_ends[:-1]]) if len(a_ends) else a_ends
    first = np.searchsorted(b_ends, starts, side="right")
    count = np.searchsorted(b_ends, a_ends, side="left") - first + 1
    return np.repeat(np.arange(len(a_ends)), count), np.repeat(first, count) + arrays.ranges(count)


class _Flat:
    """Rows of numbers one after another, which grow by doubling."""

    def __init__(self, dtype):
        self.data, self.ends, self.rows = np.zeros(1 << 14, dtype), np.zeros(1 << 12, np.int64), 0

    def add(self, data: np.ndarray, lengths: np.ndarray) -> None:
        used, n = int(self.ends[self.rows]), self.rows
        while len(self.data) < used + len(data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while len(self.ends) < n + len(lengths) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.data[used:used + len(data)] = data
        self.ends[n + 1:n + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.rows += len(lengths)

    def lengths(self) -> np.ndarray:
        return np.diff(self.ends[:self.rows + 1])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(data of the rows one after another, lengths)."""
        n = self.ends[rows + 1] - self.ends[rows]
        return self.data[np.repeat(self.ends[rows], n) + arrays.ranges(n)], n


def _join(values: pa.Array, lengths: np.ndarray, between: str) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(ends, values), between)


class Aligner:
    """Aligns texts by two tokenizers, and keeps what it has found of distinct units."""

    def __init__(self, a: ByteBpe, b: PieceBpe, kept: int = KEPT_UNITS):
        self.a, self.b, self._kept = a, b, kept
        self.b_size = len(b.tokens.lengths)
        self._clear()

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        #: Per unit: tokens of A, of B, groups, and whether the tokens spell it.
        self._sizes, self._pairs, self._text = _Flat(np.int64), _Flat(np.int64), _Flat(np.uint8)

    def _ask(self, tokenizer, units: list[str], raw: list[bytes]) -> list[list[int] | None]:
        """Ids of each unit, None where they do not spell it. Units that a text can be cut
        between are asked for in lines of many."""
        out: list[list[int] | None] = [None] * len(units)
        plain = [k for k, r in enumerate(raw) if len(r) > 1 and _STARTS[r[1]] and r[-1] != _SPACE]
        alone = sorted(set(range(len(units))) - set(plain))
        lines = [plain[k:k + _LINE_UNITS] for k in range(0, len(plain), _LINE_UNITS)]
        for line, ids in zip(lines, tokenizer.encode(["".join([units[k] for k in line]) for line in lines]), strict=True):
            found = np.array(ids, np.int64)
            if tokenizer.tokens.spell(found).tobytes() != b"".join([raw[k] for k in line]):
                alone += line
                continue
            ends = np.cumsum(tokenizer.tokens.lengths[found])
            cuts = (np.searchsorted(ends, np.cumsum([len(raw[k]) for k in line])) + 1).tolist()
            start = 0
            for k, end in zip(line, cuts, strict=True):
                out[k] = ids[start:end]
                start = end
        for k, ids in zip(alone, tokenizer.encode([units[k] for k in alone]), strict=True):
            if tokenizer.tokens.spell(np.array(ids, np.int64)).tobytes() == raw[k]:
                out[k] = ids
        return out

    def _learn(self, units: list[str]) -> None:
        raw = [u.encode() for u in units]
        a, b = self._ask(self.a, units, raw), self._ask(self.b, units, raw)
        good = [x is not None and y is not None for x, y in zip(a, b, strict=True)]
        a = [x if ok else [] for x, ok in zip(a, good, strict=True)]
        b = [x if ok else [] for x, ok in zip(b, good, strict=True)]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a_ids = np.array([i for x in a for i in x], np.int64)
        b_ids = np.array([i for x in b for i in x], np.int64)
        a_unit = np.repeat(np.arange(len(units)), n_a)
        a_ends, b_ends = np.cumsum(self.a.tokens.lengths[a_ids]), np.cumsum(self.b.tokens.lengths[b_ids])
        labels = group_labels(a_ends, b_ends)
        terminal = labels[:len(a_ids)] == np.arange(len(a_ids))
        n_groups = np.bincount(a_unit[terminal], minlength=len(units))
        a_at, b_at = links(a_ends, b_ends)
        n_links = np.bincount(a_unit[a_at], minlength=len(units))
        # The tokens of a group follow one another on both sides.
        group = np.cumsum(terminal) - 1
        rank = group[labels]
        groups = int(terminal.sum())
        sides = [
            _join(pa.array(ids).cast(pa.string()), np.bincount(rank[part], minlength=groups), ",")
            for ids, part in ((a_ids, slice(0, len(a_ids))), (b_ids, slice(len(a_ids), None)))
        ]
        # Every group with its separator, so that the text of a row is that of its units.
        data, offsets = arrays.text_bytes(pc.binary_join_element_wise(pc.binary_join_element_wise(*sides, "|"), ";", ""))
        offsets = offsets[np.concatenate([[0], np.cumsum(n_groups)])]
        n = len(self._known)
        self._sizes.add(np.stack([n_a, n_b, n_groups, np.array(good, np.int64)], axis=1).ravel(), np.full(len(units), 4))
        self._pairs.add(a_ids[a_at] * self.b_size + b_ids[b_at], n_links)
        self._text.add(data, np.diff(offsets))
        self._known.update(zip(units, range(n, n + len(units)), strict=True))

    def _units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(unit of each occurrence, occurrences before each row)."""
        space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        full = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(space, texts, nothing), nothing)
        raw, offsets = arrays.text_bytes(full)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        is_space = raw == _SPACE
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True
        starts = np.zeros(len(raw), bool)
        starts[1:-1] = is_space[1:-1] & ~is_space[:-2] & _STARTS[raw[2:]] & ~first[2:-1]
        starts |= first[:-1]
        at = np.nonzero(starts)[0]
        ends = np.append(at, len(raw)).astype(np.int64)
        column = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self._known) + len(distinct) > self._kept:
            self._clear()
        new = [u for u in distinct if u not in self._known]
        if new:
            self._learn(new)
        unit = np.array([self._known[u] for u in distinct], np.int64)
        return unit[coded.indices.to_numpy()], np.searchsorted(at, offsets)

    def align(self, texts: pa.Array) -> dict[str, pa.Array | list[bytes]]:
        """Columns of a slice of texts (null: empty): sizes, the distinct pairs of each row
        with how often each is linked, and the groups as text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        unit, offsets = self._units(texts)
        rows = len(texts)
        sizes = self._sizes.data[:4 * self._sizes.rows].reshape(-1, 4)
        owner = arrays.owners(offsets)
        bad = np.bincount(owner[sizes[unit, 3] == 0], minlength=rows) > 0
        kept = ~bad[owner]
        unit, owner = unit[kept], owner[kept]
        n_a, n_b, n_groups = (np.bincount(owner, weights=sizes[unit, k], minlength=rows).astype(np.int64) for k in range(3))
        pairs, n = self._pairs.take(unit)
        n_links = np.bincount(owner, weights=n, minlength=rows).astype(np.int64)
        key = np.sort(np.repeat(owner.astype(np.int64), n) * (len(self.a.tokens.lengths) * self.b_size) + pairs)
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
        row, pair = np.divmod(key[first], len(self.a.tokens.lengths) * self.b_size)
        at = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
        data, lengths = self._text.take(unit)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=lengths, minlength=rows).astype(np.int64))])
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links),
            "pairs": pa.ListArray.from_arrays(at, pa.array(pair)),
            "times": pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))),
            "groups": [data[a:max(a, b - 1)].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)],
        }


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker, which serves many tasks."""
    return Aligner(ByteBpe(a_path), PieceBpe(b_path))


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, pairs, times, groups_sha256) per row, and the
    groups themselves (`a1,a2|b1;a3|b2,b3`) if asked for. A pair is the id of A times the
    size of B's vocabulary plus the id of B."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, pairs array<bigint>, "
              "times array<int>, groups_sha256 string" + (", groups string" if with_groups else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(a_path, b_path)
        for batch in arrays.slices(batches, "text", SLICE):
            found = one.align(batch.column("text"))
            groups = found.pop("groups")
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            columns = {"doc_id": batch.column("doc_id"), **found, "groups_sha256": pa.array(digests, pa.string())}
            if with_groups:
                columns["groups"] = pa.array([g.decode() for g in groups], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): the documents that hold the pair linked, and whether no pair of the
    same id of A is held by more."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    most = counts.groupBy(F.expr(f"pair div {b_size}").alias("a")).agg(F.max("n").alias("most"))
    keyed = counts.withColumn("a", F.expr(f"pair div {b_size}"))
    # At most one row per id of A.
    return keyed.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row."""
    spark = docs.sparkSession
    b_size = len(aligner(a_path, b_path).b.tokens.lengths)
    aligned = cut(align(docs, a_path, b_path, id_col, text_col))
    counts = cut(pair_counts(aligned, b_size))
    # A fixed number of rows.
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    types = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + (
        ", n_best bigint, count_sum bigint, rare array<struct<pair:bigint,times:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("pairs")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            pair, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            seen = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            owner = arrays.owners(ends)[seen]
            hit, often = at[seen], times[seen].astype(np.int64)
            sums = [np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)]
            np.add.at(sums[0], owner, often * best[hit])
            np.add.at(sums[1], owner, often * n[hit])
            rare = pa.StructArray.from_arrays([pa.array(pair[~seen]), pa.array(times[~seen])], names=["pair", "times"])
            left = np.concatenate([[0], np.cumsum(~seen)])[ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *map(pa.array, sums), pa.ListArray.from_arrays(left, rare)],
                names=[*kept, "n_best", "count_sum", "rare"])

    looked = cut(aligned.select(*kept, "pairs", "times").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    asked = looked.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times")
    more = asked.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"),
    )
    return looked.drop("rare").join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
