"""The join against brute force over all pairs."""

import re

import numpy as np
import pytest

from quire.llm import jaccard
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.01"


def brute(docs):
    sets = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = min(5, len(words))
        sets[doc_id] = frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else frozenset()
    by_token = {}
    for d, s in sets.items():
        for t in s:
            by_token.setdefault(t, []).append(d)
    pairs = {(a, b) for ids in by_token.values() if len(ids) < 400 for a in ids for b in ids if a < b}
    links, root = dict.fromkeys(sets, 0), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (find(d), links[d]) for d in sets}


def got(rows):
    return {r.doc_id: (r.class_id, r.n_links) for r in rows.collect()}


def test_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert got(jaccard.op7_jaccard(spark, FOLDER)) == brute(docs)


def test_against_sql(spark):
    assert compare(spark, FOLDER, jaccard.op7_jaccard, jaccard.OP7_SQL) == 1000


def near_copies(n, length=60, own=()):
    """n texts that differ from one another in a few words."""
    base = [f"w{i}" for i in range(length)]
    out = []
    for i in range(n):
        words = base.copy()
        words[(7 * i) % length] = f"x{i}"
        out.append(" ".join([*words, *own]))
    return out


@pytest.mark.parametrize(("limit", "block"), [(10_000, 512), (20, 16)])
def test_groups_and_awkward_texts(spark, monkeypatch, limit, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies(60) + ["same text of six words here"] * 5 + [None, "", " ", "one", "one", "two words", "a b c d", "a b c d"]
    texts += ["shared start of a line " * 2 + f"then {i} {i + 1} {i + 2} more {i} words {i}" for i in range(80)]
    texts += ["long " + " ".join(str(i) for i in range(30_000)), "long " + " ".join(str(i) for i in range(30_001))]
    docs = list(enumerate(texts))
    table = spark.createDataFrame([(i, t, i, b"x") for i, t in docs], "doc_id long, text string, class_id long, tokens binary")
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(table, limit=limit).collect()}
    want = {d: v for d, v in brute(docs).items() if (texts[d] or "").strip()}
    assert found == want


def test_runs_lose_pairs_independently(spark):
    """Pairs just above the threshold, all of shingles that stand in a quarter of the sets."""
    rng = np.random.default_rng(4)
    passages, texts = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(40)], []
    for _ in range(300):
        chosen = rng.permutation(40)[:11]
        texts += [" ".join(passages[i] for i in chosen[:10]), " ".join(passages[i] for i in [*chosen[:9], chosen[10]])]
    docs = list(enumerate(texts))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(table, limit=5).collect()}
    want = brute(docs)
    assert all(n for _, n in want.values()) and found == want


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert got(jaccard.all_rows(docs).where("doc_id <> 1")) == {2: (1, 1), 3: (3, 0)}
    assert jaccard.all_rows(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(near_copies(10) + [None, "", "other"])], "doc_id long, text string, lang string")
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 11, 12]


def test_number_of_runs():
    for s in (0.5, 0.8, 0.9):
        assert 1 - (1 - 0.9 * s) ** jaccard.runs_needed(s, 0.9999) >= 0.9999
