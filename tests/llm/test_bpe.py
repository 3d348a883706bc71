"""The encoder against the public library, whole tables and awkward texts."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe

AWKWARD = [
    "", " ", "\n\n \t x", "a" * 3000, "it's they'll  we've x \x1c\x1d y", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
    "  　wide space", "\U0001f600 emoji ́ combining", "日本語テキスト", "x\u0000y", "123 ½ ²³ ٣", "\r\n\r\n", "é" * 500,
    "\u0085next line", "<|endoftext", "﻿bom",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


class Own:
    def __init__(self):
        self.encoder = bpe.Encoder(bpe.default_vocabulary())
        self.runs = bpe.Runs(self.encoder.run_ids, self.encoder.special)
        self.decode = self.encoder.decode

    def encode(self, text):
        return np.frombuffer(self.runs.encode(text), "<i4")


@pytest.fixture(scope="module")
def own():
    return Own()


@pytest.mark.parametrize("text", AWKWARD)
def test_awkward(own, library, text):
    ids = own.encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_partial_ids_decode_like_the_library(own, library):
    ids = own.encode("日本 \U0001f600 naïve").tolist()
    for cut in range(len(ids)):
        assert own.decode(own.encode("")) == ""
        assert own.decode(np.array(ids[cut:])) == library.decode(ids[cut:], skip_special_tokens=False)


def test_full_cache_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    text = "one two three four five six one two three"
    assert Own().encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_table(spark, folder, library):
    rows = bpe.op1_bpe(spark, folder).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    assert len(rows) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        got = rows.loc[doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_nulls_repeats_and_other_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (1, "", "y"), (2, "word word", None), (2, "word word", None)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, len(r.ids), r.decoded) for r in bpe.decode_documents(bpe.encode_documents(docs)).collect())
    assert got == [(1, 0, ""), (1, 0, ""), (2, 2, "word word"), (2, 2, "word word")]
    assert bpe.decode_documents(bpe.encode_documents(docs.limit(0))).count() == 0
