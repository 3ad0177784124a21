"""Ids of the word encoder against the tokenizer itself."""

import os

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm.tokens import END_ID, WordEncoder, encoder as worker_encoder, tokenizer_path

COLUMNS = {
    "null": [None],
    "empty": [""],
    "no rows": [],
    "plain": ["abc DEF it's 12", "don't'll ''s __a_b1c2 ~~~ '"],
    "not plain": ["Ünï", "́a  Å ΣΑΣ ΑΣ. İ! é's 中文字 　x\x85y\xa0z W̊!?", None],
    "Latin": [" ".join(f"{chr(k)} a{chr(k)}Z,{chr(k)}'s" for k in range(a, a + 32)) for a in range(0xA1, 0x250, 32)],
    "marks and added tokens": ["a\x01b \x01 <|endoftext|> x<|endoftext|>y"],
    "long": ["x" * 3000 + " q,"],
    "more than is kept": [f"w{i} é{i}" for i in range(300)],
}


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(tokenizer_path(), kept=50)


@pytest.mark.parametrize("name", COLUMNS)
@pytest.mark.parametrize("end_id", [END_ID, None])
def test_ids_are_the_tokenizers(encoder, name, end_id):
    end = [] if end_id is None else [end_id]
    want = [encoder._tokenizer.encode(x or "", add_special_tokens=False).ids + end for x in COLUMNS[name]]
    ids, offsets = encoder.encode(pa.array(COLUMNS[name], pa.string()), end_id)
    assert ids.tolist() == [i for row in want for i in row]
    assert offsets.tolist() == np.cumsum([0, *map(len, want)]).tolist()


def test_the_whole_tokenizer_is_asked_for_few_words(encoder, monkeypatch):
    """Latin letters are one piece as ASCII is; letters that normalizing may change are not."""
    asked, ask = [], encoder._ask_words
    monkeypatch.setattr(encoder, "_ask_words", lambda words: asked.extend(words) or ask(words))
    encoder.encode(pa.array(["Straße ÇA œuvre, ŽLUTÝ1 naïve's", "e\u0301 \u0130 \u0149 \u017f 東京 \u0178x"]))
    assert asked == ["e\u0301", "\u0130", "\u0149", "\u017f", "東京"]


def test_a_worker_starts_no_threads_beside_its_task(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    worker_encoder.cache_clear()
    worker_encoder(tokenizer_path())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
