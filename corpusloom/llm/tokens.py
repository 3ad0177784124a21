"""Token ids of whole texts, by a public tokenizer file.

The tokenizer of the query lower-cases, drops white space and never joins pieces across
it, so the ids of a text are the ids of its words in order. Words repeat: each task asks
the tokenizer once per distinct word and keeps the answers, up to a bound.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2
# Distinct pieces and words kept in a Python worker; beyond it the memory is emptied.
KEPT_WORDS = 600_000
# Words asked for in a line, and what stands between those that need the whole tokenizer.
_LINE_WORDS, _MARK = 200, "\x01"
_BETWEEN = f" {_MARK} "
# Latin letters that normalizing leaves whole and that lower-case to one of them.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
# A word of these goes to the tokenizer's model piece by piece.
_PLAIN = re.compile(f"[!-;=-~{_LATIN}]+")
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\sa-z0-9{_LATIN}]+"
# A word, and the marks after its last letter or digit (but for one that lower-cases to more).
_TAIL = re.compile(r"(?s)(.*?)((?<=[^\W_\u0130])[.,;:!?]+)?")


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of string columns. For a word of printable ASCII and Latin letters, normalizing is lower-casing
    and splitting is one pattern, so its pieces go to the tokenizer's model as they are;
    every other word goes through the whole tokenizer. New pieces and words are asked for
    in lines of many, and kept until the memory is full."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = [p["type"] for p in parts["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or parts["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("a tokenizer that lower-cases and ends pieces with words is needed")
        self._tokenizer, self._kept = Tokenizer.from_file(path), kept
        self._model = Tokenizer.from_file(path)
        self._model.normalizer = None
        self._model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._mark = self._tokenizer.encode(_MARK, add_special_tokens=False).ids
        if len(self._mark) != 1:
            raise ValueError("a tokenizer with one id for the mark between words is needed")
        self._clear()

    def _clear(self):
        # Units are pieces of plain words, and other words whole; unit 0 is the end of a row.
        self._known: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, np.int32)
        self._starts = np.zeros(1 << 16, np.int64)
        self._starts[1] = self._used = 1

    def _store(self, units: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Units one after another, each with the ids up to its end."""
        n, used, more = len(self._known) + 1, self._used, len(ids)
        while len(self._ids) < used + more:
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while len(self._starts) < n + len(units) + 1:
            self._starts = np.concatenate([self._starts, np.zeros_like(self._starts)])
        self._ids[used:used + more] = ids
        self._starts[n + 1:n + len(units) + 1] = used + ends
        self._used += more
        self._known.update(zip(units, range(n, n + len(units)), strict=True))

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Store new units, and tell their numbers. A mark at the end of a word that is not
        plain is a piece of its own after a letter or digit, so words that differ in it are
        asked for once."""
        is_plain = pc.match_substring_regex(new, f"^{_PLAIN.pattern}$")
        plain, others = (new.filter(x).to_numpy(zero_copy_only=False).tolist() for x in (is_plain, pc.invert(is_plain)))
        at = np.argsort(~is_plain.to_numpy(zero_copy_only=False), kind="stable")
        numbers = np.empty(len(new), np.int64)
        numbers[at] = np.arange(len(new)) + len(self._known) + 1
        self._store(plain, *self._ask_pieces(plain))
        parts = [_TAIL.fullmatch(word).groups() for word in others]
        cores = list({core: 0 for core, _ in parts})
        tails = list({tail: 0 for _, tail in parts if tail})
        cores = dict(zip(cores, self._ask_words(cores), strict=True))
        tails = dict(zip(tails, _cut(*self._ask_pieces(tails), 0), strict=True))
        lists = [cores[core] + tails[tail] if tail else cores[core] for core, tail in parts]
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        self._store(others, np.fromiter(chain.from_iterable(lists), np.int32), ends)
        return numbers

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(units of all distinct words, offsets per word)."""
        plain = pc.match_substring_regex(words, f"^{_PLAIN.pattern}$")
        cut = pc.if_else(plain, pc.utf8_lower(words), words)
        mixed = pc.and_not(plain, pc.match_substring_regex(words, f"^[A-Za-z{_LATIN}]+$"))
        split = pc.replace_substring_regex(cut.filter(mixed), f"({_PIECES})", "\\1 ")
        pieces = pc.ascii_split_whitespace(pc.replace_with_mask(cut, mixed, pc.ascii_rtrim_whitespace(split)))
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self._known) + len(distinct) > self._kept:
            self._clear()
        at = np.fromiter(map(self._known.get, distinct, repeat(0)), np.int64, len(distinct))
        new = at == 0
        if new.any():
            at[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        offsets = pieces.offsets.to_numpy()
        return at[coded.indices.to_numpy()], offsets - offsets[0]

    def _ask_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of pieces of plain words: each ends with the next id that ends a word."""
        found = self._lines(self._model, pieces, " ")
        return found, np.nonzero(self._ends[found])[0] + 1

    def _ask_words(self, words: list[str]) -> list[list[int]]:
        """Ids of any words, by a mark after each; those with a mark, or the first character
        of an added token, are asked alone."""
        alone = [k for k, word in enumerate(words) if _MARK in word or "<" in word]
        lone = set(alone)
        found = self._lines(self._tokenizer, [w for k, w in enumerate(words) if k not in lone], _BETWEEN)
        lists = iter(_cut(found, np.nonzero(found == self._mark[0])[0], 1))
        encoded = self._tokenizer.encode_batch_fast([words[k] for k in alone], add_special_tokens=False)
        singles = iter([e.ids for e in encoded])
        return [next(singles) if k in lone else next(lists) for k in range(len(words))]

    @staticmethod
    def _lines(tokenizer, words: list[str], between: str) -> np.ndarray:
        lines = [between.join(words[k:k + _LINE_WORDS]) + between for k in range(0, len(words), _LINE_WORDS)]
        encoded = tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        return np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in encoded)])

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets per row); null is empty; `end_id` ends each row."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        rows = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        word = coded.indices.to_numpy()
        units, offsets = self._units(coded.dictionary)
        if end_id is not None:
            # One more word, which is the end.
            self._ids[0] = end_id
            word, rows = np.insert(word, rows[1:], len(offsets) - 1), rows + np.arange(len(rows))
            units, offsets = np.append(units, 0), np.append(offsets, len(units) + 1)
        stored = pa.LargeListArray.from_arrays(self._starts[:len(self._known) + 2], self._ids[:self._used])
        found = stored.take(pa.array(units))
        lists = pa.LargeListArray.from_arrays(found.offsets.to_numpy()[offsets], found.values).take(pa.array(word))
        ends = lists.offsets.to_numpy()
        return lists.flatten().to_numpy(), (ends - ends[0])[rows]


def _cut(ids: np.ndarray, ends: np.ndarray, gap: int) -> list[list[int]]:
    """The ids between ends, without the `gap` ids at each."""
    flat, a, out = ids.tolist(), 0, []
    for b in ends.tolist():
        out.append(flat[a:b])
        a = b + gap
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per Python worker, which serves many tasks. Spark gives a task its core, so the
    tokenizer starts no threads of its own beside them, unless the worker's setting says so."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)
