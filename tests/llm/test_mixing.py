"""Targets and cuts against loops that share the excess again and again."""

import hashlib
import random
import re
from fractions import Fraction

import pytest

from quire.llm import mixing
from tests.oracle import compare


def brute_targets(sizes):
    """Share by weight, stop what exceeds three times its source, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            rest -= target[s]
        open_ -= over
    return target


def brute(docs):
    rows = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in docs]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, out = brute_targets(sizes), []
    for source in sizes:
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (
            hashlib.md5(f"12:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]))
        budget, taken = min(3 * sizes[source], int(float(target[source]) + 0.5)), [0] * len(own)
        while budget > 0 and sizes[source]:
            for i, r in enumerate(own):
                n = min(r[2], budget)
                taken[i] += n
                budget -= n
        out += [(r[0], r[2], sizes[source], float(target[source]), t) for r, t in zip(own, taken)]
    return out


def test_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", mixing.op12_mixing, mixing.OP12_SQL) == 1000


def random_docs(seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "é", "😀", "zz", "hot"]
    weights = [1, 1, 1, 2, 1, 1, 1, 20]
    docs = [(i, rng.choices(sources, weights)[0], " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(40)))) for i in range(150)]
    docs += [(500, "none", ""), (501, "none", None), (502, "tiny", "x"), (None, "a", "no id"), (None, "a", "no id"), (7, "B", "another\tseven x")]
    return docs + docs[:5]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_mixes(spark, ranges, seed):
    docs = random_docs(seed)
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, source string, text string, size int, key int").repartition(4)
    mixed = mixing.mixture(frame)
    got = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixed.collect()]
    plain = lambda rows: sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in rows)
    assert plain(got) == plain(brute(docs))
    assert all(t <= 3 * s for _, s, _, _, t in got)
    for source in {r.source for r in mixed.collect()}:
        own = [r for r in mixed.collect() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5


def test_texts_hold_the_words_taken(spark):
    docs = {d: (s, t) for d, s, t in random_docs(4) if d is not None}
    frame = spark.createDataFrame([(d, s, t) for d, (s, t) in docs.items()], "doc_id long, source string, text string")
    mixed = mixing.mixture(frame)
    words = {}
    for r in mixing.texts(frame, mixed).collect():
        whole = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id][1] or "")
        assert r.words == whole[:len(r.words)] and r.words
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.words)
    assert words == {r.doc_id: r.taken for r in mixed.collect() if r.taken}


def test_empty_and_wordless(spark):
    shape = "doc_id long, source string, text string"
    assert mixing.mixture(spark.createDataFrame([], shape)).count() == 0
    only = [(r.size, r.source_size, r.target, r.taken) for r in mixing.mixture(spark.createDataFrame([(1, "a", " "), (2, None, None)], shape)).collect()]
    assert only == [(0, 0, 0.0, 0)] * 2
