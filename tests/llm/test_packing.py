"""Packing: ids against the library, every id in one piece, windows gapless, little padding."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe, packing
from tests.llm.test_bpe import AWKWARD


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def own():
    return packing.runs(bpe.default_vocabulary())


@pytest.mark.parametrize("text", AWKWARD)
def test_awkward_ids(own, library, text):
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=['Cs']), st.sampled_from(" \n\t \u0085\x1c's")), max_size=40))
def test_any_ids(own, library, text):
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 4), max_size=6), st.integers(1, 16))
def test_fill_is_the_best_sum(counts, room):
    items = [x for x, n in counts.items() for _ in range(n)]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    chosen = packing.fill(dict(counts), room)
    assert sum(k * v for k, v in chosen.items()) == max(sums)
    assert all(v <= counts[k] for k, v in chosen.items())


def check(rows, lengths, capacity):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: sum(n for _, n in p) for d, p in by_doc.items()} == lengths
    for found in by_doc.values():
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
    for found in by_window.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return by_window


def test_table(spark, folder, library):
    rows = packing.op8_packing(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    ids = {d.doc_id: np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4") for d in docs}
    windows = check(rows, {d: len(x) for d, x in ids.items()}, 1024)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
    total = sum(map(len, ids.values()))
    assert len(windows) <= -(-total // 1024) + 2


def test_nulls_ties_empty(spark):
    docs = spark.createDataFrame(
        [(i, None if i % 3 == 0 else "same text here", 7) for i in range(50)], "doc_id long, text string, n long")
    rows = packing.pack_documents(docs, 16).collect()
    n = len(np.frombuffer(packing.runs(bpe.default_vocabulary()).encode("same text here"), "<u4")) + 1
    check(rows, {i: 1 if i % 3 == 0 else n for i in range(50)}, 16)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_repeated_rows_and_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 5000), (2, "x"), (2, "x")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    places = [(r.sequence_id, r.offset + i) for r in rows for i in range(r.length)]
    assert len(places) == len(set(places)) == sum(r.length for r in rows)
