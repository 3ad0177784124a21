"""Quality rules as a ledger: measurements and a bit per failed rule, then policies.

Every rule is evaluated once for every document. A policy is a version and the set of
rules that reject by it; applying one, or asking what a document failed alone, is an
operation on the bits. No text is read again, and nothing is shuffled but counts per
distinct bit pattern.

Words are runs of characters other than space and 0x09 to 0x0D. A null text has none. A
null document id stays null. Repeated rows are measured each, and there are no ties. A very
long text is measured whole, as a slice of its own. An empty table gives an empty table.
Other columns are not read, but by `keep_good`, which carries them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays
from corpusloom.llm.ship import ship

# Bit of each rule, and when a document fails it.
RULES = {
    "few_words": "fewer than 10 words",
    "repeated_words": "over 20 % of the words lie in 5-word windows that come twice",
    "symbols": "over 30 symbols per 100 words",
    "repeated_lines": "over half of the lines with a word repeat an earlier line",
    "word_length": "words of fewer than 2 or more than 20 characters on average",
    "long_word": "all text is one unbroken run of over 1,000 characters per word",
}
BITS = {rule: 1 << k for k, rule in enumerate(RULES)}
SYMBOLS = b"#*$%&|<>"
# Bytes of text whose arrays are in memory at a time, where rows wait for their measurements.
SLICE = 1 << 19
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


POLICIES = (
    Policy("base", ("few_words", "repeated_words")),
    Policy("standard", ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")),
    Policy("strict", tuple(RULES)),
)
STANDARD = POLICIES[1]


def _measure(column: pa.Array) -> list[np.ndarray]:
    """The measurements of one slice of texts, in the order of MEASURES."""
    raw, offsets = arrays.text_bytes(column)
    rows = len(offsets) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    starts, ends, word_offsets = arrays.words(raw, offsets)
    # Characters are bytes other than continuation bytes.
    chars = count(((raw & 0xC0) != 0x80) & ~arrays.SEPARATORS[raw])
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True

    hashes = arrays.word_hashes(raw, starts, ends)
    word_row = arrays.owners(word_offsets)
    keyed = arrays.mix(hashes + word_row.astype(np.uint64))
    at = arrays.whole_windows(word_offsets, WINDOW)
    windows = arrays.window_hashes(keyed, WINDOW)[at]
    again = at[_repeats(windows, first=True)]
    repeated = arrays.covered(again, WINDOW, len(starts))
    n_repeat = np.diff(np.concatenate([[0], np.cumsum(repeated)])[word_offsets])

    # A line is a range of bytes; it has a word when a word starts in it.
    newline = np.nonzero(raw == 10)[0]
    first = np.union1d(offsets[:-1][np.diff(offsets) > 0], newline + 1)
    first = first[first < len(raw)]
    line_row = np.searchsorted(offsets, first, side="right") - 1
    last = np.append(first[1:], len(raw))
    last -= (raw[last - 1] == 10) if len(first) else 0
    has_word = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last, line_row = first[has_word], last[has_word], line_row[has_word]
    lines = arrays.range_hashes(arrays.prefix_hashes(raw), first, last)
    lines = arrays.mix(lines + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    n_dup = np.bincount(line_row[_repeats(lines, first=False)], minlength=rows)
    return [
        np.diff(word_offsets), chars, count(is_symbol[raw]), n_dup, n_repeat,
        np.bincount(line_row, minlength=rows),
    ]


def _repeats(values: np.ndarray, first: bool) -> np.ndarray:
    """Mask of the values that come again (`first`), or that came before."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    mask = np.zeros(len(values), bool)
    mask[order[1:]] = same
    if first:
        mask[order[:-1]] |= same
    return mask


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the measurements, as long."""
    ship(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{m} bigint" for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "_text"):
            found = [pa.array(m, pa.int64()) for m in _measure(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + found, names=[*keep, *MEASURES])

    return rows.mapInArrow(run, schema)


def failed_bits(measures: Column | None = None) -> Column:
    """The bits of the rules that a measured row fails; `measures` is a struct of them."""
    m = {name: F.col(name) if measures is None else measures[name] for name in MEASURES}
    n = m["n_words"]
    fails = {
        "few_words": n < 10,
        "repeated_words": m["n_repeat_words"] * 100 > n * 20,
        "symbols": m["n_symbols"] * 100 > n * 30,
        "repeated_lines": m["n_dup_lines"] * 2 > m["n_lines"],
        "word_length": (m["word_chars"] < n * 2) | (m["word_chars"] > n * 20),
        "long_word": m["word_chars"] > n * 1000,
    }
    bits = [F.when(fails[rule], F.lit(bit)).otherwise(0) for rule, bit in BITS.items()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total.cast("bigint")


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, measurements and `failed`: the bits of all failed rules."""
    return measure(docs, text_col, keep).withColumn("failed", failed_bits())


def kept_by(policy: Policy) -> Column:
    """Whether a ledger row passes."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """(policy, rule, rejected, rejected_only): documents that a policy rejects and that
    fail the rule, and those that it would keep without that rule. Documents are counted
    per bit pattern first, so at most 2 ** rules rows are looked at again."""
    patterns = entries.groupBy("failed").agg(F.count("*").alias("documents"))
    cases = entries.sparkSession.createDataFrame(
        [(p.version, r, p.mask, BITS[r]) for p in policies for r in p.rules],
        "policy string, rule string, mask bigint, bit bigint",
    )
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    return (
        patterns.join(F.broadcast(cases), F.col("failed").bitwiseAND(F.col("bit")) != 0)
        .groupBy("policy", "rule").agg(
            F.sum("documents").alias("rejected"),
            F.sum(F.when(hit == F.col("bit"), F.col("documents")).otherwise(0)).alias("rejected_only"),
        )
    )


def failures(entries: DataFrame) -> DataFrame:
    """One row: the rules that some document fails, and that all fail, as bits."""
    return entries.agg(F.bit_or("failed").alias("by_any"), F.bit_and("failed").alias("by_all"))


def _measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The measurements of each text as a struct."""
    for column in texts:
        found: list[list[np.ndarray]] = [[] for _ in MEASURES]
        for part in arrays.slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", SLICE):
            for own, more in zip(found, _measure(part.column("text")), strict=True):
                own.append(more)
        columns = [pa.array(np.concatenate(m) if m else [], pa.int64()) for m in found]
        yield pa.StructArray.from_arrays(columns, names=MEASURES)


def keep_good(docs: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns, whatever their names. Only the
    text goes to the Python workers, once, and only measurements come back."""
    ship(docs.sparkSession)
    measures = F.arrow_udf(_measured, ", ".join(f"{m} bigint" for m in MEASURES), F.ArrowUDFType.SCALAR_ITER)
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])
    found = docs.select(row.alias("r"), measures(docs[f"`{text_col}`"].cast("string")).alias("m"))
    passed = found.where(failed_bits(F.col("m")).bitwiseAND(F.lit(policy.mask)) == 0)
    return passed.select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns])
