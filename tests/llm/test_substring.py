"""Cuts against brute force over all windows."""

import random
import re

import numpy as np
import pytest

from quire.llm import substring
from tests.oracle import compare


def test_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", substring.op9_substring, substring.OP9_SQL) == 1000


def brute(docs, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, w in words:
        gone = {k for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < d for k in range(i, i + window)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def random_docs(seed, n=60):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(40)}" for _ in range(rng.randrange(5, 30))] for _ in range(6)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 12))]
        docs.append((i, " ".join(words)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "a " * 100), (n + 3, "a " * 90), (n + 4, docs[3][1])]


@pytest.mark.parametrize(("seed", "hot", "shard"), [(1, 400, 1000), (2, 400, 3), (3, 1, 5)])
def test_random_passages(spark, seed, hot, shard):
    docs = random_docs(seed)
    table = spark.createDataFrame([(d, t, d, 1) for d, t in docs], "doc_id long, text string, start long, n int").repartition(3)
    spans = substring.removals(table, window=8, gram=3, shard=shard, hot=hot)
    got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.cut(table, spans, ["doc_id", "start"]).collect()}
    assert got == brute(docs, 8)


def test_automaton_first_documents():
    rng, window = random.Random(5), 4
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 25))] for _ in range(6)]
        own = substring.Automaton()
        for doc, words in enumerate(texts):
            own.add(words, doc)
        for words in [*texts, [rng.randrange(4) for _ in range(30)]]:
            want = []
            for i in range(len(words) - window + 1):
                cut = words[i:i + window]
                want.append(next((d for d, t in enumerate(texts) if any(t[k:k + window] == cut for k in range(len(t) - window + 1))), -1))
            assert own.statistics(words, window) == want


def test_segments_cover_every_window_once():
    words = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    row = np.sort(np.random.default_rng(2).integers(0, 6, 400))
    _, start, n = substring.anchors(words, row, 10, 3)
    covered = [k for a, m in zip(start, n) for k in range(a, a + m)]
    assert covered == [i for i in range(391) if row[i] == row[i + 9]]


def test_stage_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", len(text)), (2, "x\n" + text + "\ty z", "en", 9), (3, "short  text", "en", 11), (4, None, None, None)],
                                 "doc_id long, text string, lang string, n_chars long")
    rows = {r.doc_id: (r.text, r.n_chars) for r in substring.keep_unseen(docs).collect()}
    assert rows == {1: (text, len(text)), 2: ("x y z", 5), 3: ("short  text", 11), 4: (None, None)}
    assert substring.keep_unseen(docs).columns == docs.columns
    assert substring.keep_unseen(docs.limit(0)).count() == 0
    twice = docs.union(docs)
    assert sorted(r.doc_id for r in substring.keep_unseen(twice).collect()) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_any_column_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    shape = "doc_id long, text string, `_id` long, `spans` string, `row` int, `n_words` string, `kept` array<int>, `a b` struct<x: int>"
    docs = spark.createDataFrame([(i, text, 10 + i, "s", i, None, [i], (i,)) for i in (1, 2)], shape)
    rows = [tuple(r) for r in substring.keep_unseen(docs).orderBy("doc_id").collect()]
    assert rows == [(1, text, 11, "s", 1, None, [1], (1,)), (2, "", 12, "s", 2, None, [2], (2,))]
    assert substring.keep_unseen(docs).dtypes == docs.dtypes


def test_window_runs_join(spark):
    rng = random.Random(9)
    core = " ".join(f"p{i}" for i in range(12))
    docs = [(i, " ".join(f"c{rng.randrange(5)}" for _ in range(rng.randrange(9))) + " " + core + " " + " ".join(
        f"d{rng.randrange(5)}" for _ in range(rng.randrange(9)))) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    spans = substring.removals(frame, window=8, gram=3, hot=2)
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.cut(frame, spans, ["doc_id"]).collect()} == brute(docs, 8)
