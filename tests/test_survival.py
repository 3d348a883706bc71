"""Containment, votes and costs against plain searches."""

import random
import re

from quire.operators import survival


def test_contained(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("ab é字") for _ in range(n))
    hays = [(i, text(rng.randrange(120))) for i in range(40)] + [(50, None), (51, ""), (52, "short")]
    for least in (3, 40):
        needles = {h[a:a + n] for _, h in hays if h and len(h) > 60 for a in (0, 7, 20) for n in (least, least + 9)} | {text(least + 2) for _ in range(20)}
        frame = spark.createDataFrame([(n,) for n in [*needles, None, ""]], "needle string")
        docs = spark.createDataFrame([*hays, hays[0]], "doc_id long, hay string").repartition(4)
        got = {(r.doc_id, r.needle) for r in survival.contained(docs, "doc_id", frame).collect()}
        assert got == {(d, n) for d, h in hays for n in needles if h and n in h}
    assert survival.contained(docs, "doc_id", frame.limit(0)).count() == 0
    assert survival.contained(docs.limit(0), "doc_id", frame).count() == 0


def windows(tokens, least):
    """Runs as a reader makes them, and the steps that takes."""
    out, steps, end, letters = [], 0, 0, 0
    for start in range(len(tokens)):
        while letters < least and end < len(tokens):
            letters += len(tokens[end])
            end += 1
            steps += 1
        if letters < least:
            break
        steps += end - start
        out.append(tokens[start:end])
        letters -= len(tokens[start])
    return out, steps


def test_cost_is_the_readers_and_refuses_beyond_it(spark):
    rng = random.Random(1)
    texts = [" ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(60))) for _ in range(20)] + [None, "", "ab", "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for least in (1, 4, 12, 50):
        want = {i: windows(re.findall("[A-Za-z]+", t or ""), least)[1] for i, t in enumerate(texts)}
        most = sorted(want.values())[len(want) // 2]
        for limit in (most - 1, most):
            rows = survival.probe_cost(docs, "doc_id", "text", least, limit).collect()
            assert {r.doc_id: r.steps for r in rows} == want
            assert {r.doc_id for r in rows if not r.admitted} == {i for i, s in want.items() if s > limit}
    assert survival.probe_cost(docs.limit(0), "doc_id", "text", 4).count() == 0


def test_orders(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    plain = " ".join(words)
    texts = [(1, "x " + plain.replace(" ", "\n") + " y"), (2, plain.replace(" ", "")[::-1]), (3, "‮" + " ".join(words[::-1])),
             (4, plain + " " + plain.replace(" ", "")[::-1]), (5, "nothing at all"), (6, None), (7, " ".join(words[:4]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(9, plain)], "item_id long, text string")
    probes = survival.distinct_probes(survival.probe_windows(items, "item_id", "text", 12), "item_id")
    got = {r.doc_id: (r.forward, r.backward, r.verdict, r.gate) for r in survival.verdict(
        survival.order_votes(probes, "item_id", docs, "doc_id", "text")).collect()}
    n = probes.count()
    assert got[1] == (n, 0, "logical", "passed") and got[2] == (0, n, "visual", "failed") and got[3] == (0, n, "visual", "failed")
    assert got[4][:2] == (0, 0) and got[4][2:] == ("inconclusive", "inconclusive") and got[7][2] == "logical" and got[7][0] < n
    assert set(got) == {1, 2, 3, 4, 7}


def test_survival_needs_whole_tokens(spark):
    items = spark.createDataFrame([(1, "aaaa bbbb cccc"), (2, "zz")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x aaaa-bbbb, cccc"), (2, "xaaaa bbbb cccc"), (3, "aaaa bbbb ccccc"), (4, None)], "doc_id long, text string")
    got = {(r.item_id, r.doc_id): r.found for r in survival.surviving(items, "item_id", docs, "doc_id", "text", 8).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (1, 3): 1}
