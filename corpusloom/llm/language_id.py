"""The language of texts by error-correcting output codes.

Every language has a codeword of bits; a bit divides the languages in two, and a binary
classifier over hashed n-grams of bytes predicts it. A text gets the language whose
codeword is nearest by weighted loss: a classifier's loss counts by how well it does on
that language. The share of the nearest codeword among all is the score, and texts whose
two nearest codewords are about as near are flagged.

The classifiers learn from a bounded sample of labelled rows (SAMPLE), shared equally by
the languages, the rows of a language by the order of a digest of their id; the most
frequent LANGUAGES are learnt. Counts of languages, and predictions, cover all rows. A row
of the sample is a vector of fixed size, so what the driver gets is bounded.

A text without a letter, or null, is `und`, and so is every text where nothing can be
learnt. One language alone is predicted for every other text. A null id counts as held
out. An empty text is `und`; a very long one is read whole, a piece at a time. Repeated
rows are predicted alike and may be learnt from each; a tie is the language first in
order. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays
from corpusloom.llm.ship import ship

UNKNOWN = "und"
#: Rows to learn from, languages learnt, and the size of a row's vector.
SAMPLE, LANGUAGES, FEATURES = 4096, 1024, 4096
#: Lengths of the n-grams in bytes.
GRAMS = (1, 2, 3, 4)
#: Bytes and rows that are counted at a time.
PIECE, ROWS = 1 << 19, 256
#: All divisions of so few languages are used; of more, this many bits per binary digit.
EXHAUSTIVE, BITS_PER_DIGIT = 5, 12
STEPS, RATE, DECAY = 150, 0.5, 1e-4
#: Texts whose second language has at least this share of the first's are flagged.
AMBIGUOUS = 0.5


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def codewords(languages: int) -> np.ndarray:
    """languages x bits of -1 and 1: every division of a few languages, or for more the
    random code (of many tried) whose codewords are farthest apart."""
    if languages < 2:
        return np.ones((languages, 0), np.float32)
    if languages <= EXHAUSTIVE:
        # The first language is always 1, and no bit is the same for all.
        splits = np.arange(1 << (languages - 1)) [:-1]
        rest = (splits[None, :] >> np.arange(languages - 1)[:, None]) & 1
        return np.concatenate([np.ones((1, len(splits))), 2 * rest - 1]).astype(np.float32)
    r = np.random.default_rng(17)
    bits = BITS_PER_DIGIT * int(np.ceil(np.log2(languages)))
    best, most = None, -1.0
    for _ in range(20):
        code = r.choice(np.array([-1, 1], np.float32), (languages, bits))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        distance = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(distance, bits)
        if distance.min() > most:
            best, most = code, float(distance.min())
    return best


def vectors(texts: pa.Array, features: int = FEATURES) -> np.ndarray:
    """One vector of length 1 per text: square roots of the counts of hashed n-grams of the
    lower-cased bytes. A text begins and ends with a space."""
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    space = pa.scalar(" ", pa.large_string())
    raw, offsets = arrays.text_bytes(pc.binary_join_element_wise(space, texts, space, pa.scalar("", pa.large_string())))
    rows = len(offsets) - 1
    counts = np.zeros(rows * features, np.int64)
    longest = max(GRAMS)
    for start in range(0, len(raw), PIECE):
        end = min(start + PIECE, len(raw))
        # Beyond the last byte there are zeros, which are in no whole n-gram.
        piece = np.zeros(end - start + longest - 1, np.uint32)
        piece[:min(len(piece), len(raw) - start)] = raw[start:start + len(piece)]
        at = np.arange(start, end)
        row = np.searchsorted(offsets, at, side="right") - 1
        last = offsets[row + 1]
        gram = np.zeros(end - start, np.uint32)
        for n in range(1, longest + 1):
            gram = gram * np.uint32(257) + piece[n - 1:n - 1 + len(gram)]
            whole = at + n <= last
            if n not in GRAMS:
                continue
            hashed = (gram + np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0x85EBCA77)
            cell = (hashed >> np.uint32(8)) % np.uint32(features)
            counts += np.bincount((row * features + cell)[whole], minlength=len(counts))
    out = np.sqrt(counts.reshape(rows, features).astype(np.float32))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # features x bits
    bias: np.ndarray      # bits
    trust: np.ndarray     # languages x bits, each row of sum 1

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous, bits that differ) of each vector."""
        rows = len(x)
        if len(self.languages) == 1:
            return np.zeros(rows, np.int64), np.ones(rows), np.zeros(rows, bool), np.zeros(rows, np.int64)
        margin = x @ self.weights + self.bias
        # The loss of every bit, once for codewords with 1 and once for those with -1.
        plus, minus = (np.logaddexp(0, sign * margin) for sign in (-1, 1))
        of_plus = self.trust * (self.code > 0)
        loss = plus @ of_plus.T + minus @ (self.trust - of_plus).T
        share = np.exp(-self.code.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        score = share[np.arange(rows), best]
        second = np.partition(share, -2, axis=1)[:, -2]
        off = (np.where(margin > 0, 1, -1) != self.code[best]).sum(axis=1)
        return best, score, second >= AMBIGUOUS * score, off


def fit(x: np.ndarray, label: np.ndarray, languages: list[str]) -> Model:
    """Logistic regression of every bit at once, by gradient steps with momentum over all
    rows; then how often each bit is right for each language."""
    code = codewords(len(languages))
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    target = code[label]
    per_language = np.bincount(label, minlength=len(languages))
    share = (1 / (len(languages) * per_language[label]))[:, None].astype(np.float32)
    first_w, second_w, first_b, second_b = (np.zeros_like(v) for v in (w, w, b, b))
    for step in range(1, (STEPS if code.shape[1] else 0) + 1):
        d = -target * share / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        for v, g, m1, m2 in ((w, x.T @ d + DECAY * w / 10, first_w, second_w), (b, d.sum(axis=0), first_b, second_b)):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
    right = ((x @ w + b) * target > 0).astype(np.float64)
    trust = np.stack([right[label == k].mean(axis=0) for k in range(len(languages))]) if len(label) else np.ones_like(code)
    trust = np.maximum(trust, 1e-3)
    return Model(languages, code, w, b, trust / trust.sum(axis=1, keepdims=True) if code.shape[1] else trust)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model | None:
    """The model of the rows that are not held out; None without any."""
    has_letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    labelled = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull())
    # The number of languages is the size of this, at most LANGUAGES rows.
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    quota = max(1, sample // len(counts))
    order = F.xxhash64(F.lit("sample"), F.col(id_col))
    # Twice the quota is let through by digest, so that rows without letters leave enough.
    share = F.create_map(*[F.lit(v) for r in counts for v in (r.lang, min(1.0, (2 * quota + 20) / r.n))])
    chosen = labelled.select(
        F.col(lang_col).alias("lang"), order.alias("order"), F.col(text_col).cast("string").alias("text"), has_letter.alias("good"),
    ).where((F.pmod("order", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)) & F.col("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            x = vectors(batch.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("order"), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["lang", "order", "vector"])

    got = chosen.select("lang", "order", "text").mapInArrow(run, "lang string, order bigint, vector binary").toArrow()
    rows = sorted(zip(got.column("lang").to_pylist(), got.column("order").to_pylist(), range(got.num_rows), strict=True))
    taken: dict[str, list[int]] = {}
    for lang, _, k in rows:
        own = taken.setdefault(lang, [])
        if len(own) < quota:
            own.append(k)
    if not taken:
        return None
    languages = sorted(taken)
    vector = got.column("vector").to_pylist()
    x = np.stack([np.frombuffer(vector[k], np.float16) for lang in languages for k in taken[lang]]).astype(np.float32)
    label = np.repeat(np.arange(len(languages)), [len(taken[lang]) for lang in languages])
    return fit(x, label, languages)


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row's vector is as large for a short text as for a long one."""
    for batch in arrays.slices(batches, "text", PIECE):
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous, bits_off) per row: the language, the
    share of its codeword (0 for `und`), whether another one is about as near, and the bits
    in which the classifiers differ from the codeword."""
    spark = docs.sparkSession
    ship(spark)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(train(named, "doc_id", "text", "lang", sample))
    rows = named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text",
                        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("good"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in _few_rows(batches):
            n = batch.num_rows
            good = batch.column("good").to_numpy(zero_copy_only=False)
            if m is None:
                good = np.zeros(n, bool)
                best, score, ambiguous, off = np.zeros(n, np.int64), np.zeros(n), good, np.zeros(n, np.int64)
            else:
                best, score, ambiguous, off = m.predict(vectors(batch.column("text")))
            names = np.array([*(m.languages if m else []), UNKNOWN], object)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(names[np.where(good, best, len(names) - 1)], pa.string()),
                pa.array(np.where(good, np.clip(score, 0, 1), 0.0), pa.float64()), pa.array(ambiguous & good),
                pa.array(np.where(good, off, 0), pa.int64()),
            ], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous", "bits_off"])

    return rows.mapInArrow(
        run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, ambiguous boolean, bits_off bigint")
