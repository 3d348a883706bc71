"""Dictionary matching against a search from left to right."""

import random
import re

import pytest

from quire.operators import terms

CJK = re.compile("[぀-ヿ㐀-鿿]")


def search(text, term):
    """Hits of a term as a left-to-right search finds them; the boundary is tested afterwards."""
    for m in re.finditer(re.escape(term), text, re.IGNORECASE):
        before, after = text[m.start() - 1:m.start()] if m.start() else "", text[m.end():m.end() + 1]
        if CJK.search(term) or not re.match(r"\w", before) and not re.match(r"\w", after):
            line = text.count("\n", 0, m.start()) + 1
            yield m.start(), m.end(), m[0], line, m.start() - text.rfind("\n", 0, m.start())


def brute(docs, words):
    return sorted((d, t.lower(), *h) for d, text in docs for t in {w.lower() for w in words if w and w.strip()} for h in search(text or "", t))


DOCS = [
    (1, "The load balancer, a Load  balancer and LOAD BALANCER.\nload balancers; x load balancer"),
    (2, "负载均衡器和均衡器 C++ and .NET, in in in, xin in in\nin in in in"), (3, None), (4, ""), (5, "é load éload loadé _load load_"),
    (6, "人人人人 API接口api接口 a-b-a-b-a"), (7, "load"), (8, "load balancer of the load balancer of the load"),
]
WORDS = ["load balancer", "load", "均衡器", "负载均衡", "C++", ".net", "in in", "人人", "api接口", "a-b-a", "load balancer of the", "LOAD", None, " ", "",
         "balancer of the load balancer", "器", "+"]


@pytest.mark.parametrize("parts", [1, 5])
def test_phrases(spark, parts):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(parts)
    found = terms.phrases(docs, spark.createDataFrame([(w,) for w in WORDS], "term string"))
    assert sorted(tuple(r) for r in found.select("doc_id", "key", "start", "end", "token", "line", "col").collect()) == brute(DOCS, WORDS)


def test_random_phrases(spark):
    rng = random.Random(5)
    signs = ["a", "b", "ab", " ", " ", "-", "字", "\n", "Ä", "."]
    text = lambda most: "".join(rng.choice(signs) for _ in range(rng.randrange(1, most)))
    docs, words = [(i, text(80)) for i in range(60)], [text(7).replace("\n", " ") for _ in range(80)]
    found = terms.phrases(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(w,) for w in words], "term string"))
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, words)


def test_longest_form_stands(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    forms = spark.createDataFrame([("a", "load"), ("b", "Load balancer"), ("c", "of the load"), ("d", "load balancer of the"), ("e", "load"), (None, None)],
                                  "source string, form string")
    got = sorted((r.start, r.key, r.source) for r in terms.forbidden(docs, forms).where("doc_id = 8").collect())
    assert got == [(0, "load balancer of the", "d"), (21, "load balancer of the", "d"), (42, "load", "a"), (42, "load", "e")]


def test_ambiguity_counts_met_terms_only(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    pairs = spark.createDataFrame([("Load", "x", "1"), ("load", "y", "1"), ("c++", "x", "1"), ("C++", "x", "1"), ("never", "a", "1"), ("never", "b", "1"),
                                   (None, "a", None)], "source string, output string, concept string")
    hits = terms.phrases(docs, pairs, "source")
    assert {(r.doc_id, r.key, r.outputs) for r in terms.ambiguous_matched(hits, pairs).collect()} == {(d, "load", 2) for d in (1, 5, 7, 8)}


def test_empty_sides(spark):
    docs, none = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "term string")
    assert terms.phrases(docs, none).count() == 0
    assert terms.phrases(docs.limit(0), spark.createDataFrame([("load",)], "term string")).count() == 0
    assert terms.occurrences(docs, spark.createDataFrame([("LOAD",), ("load balancer",)], "term string"), "[a-z]+").where("doc_id = 7").count() == 1


def test_terms_that_overlap_themselves_leave_few_places(spark):
    """A text with the first characters of such a term everywhere is no place of it."""
    docs = spark.createDataFrame([(1, "it is i " * 500 + "it is of it"), (2, "it is of " * 300), (3, None), (4, "i t i"), (5, "x")], "doc_id long, text string")
    index = terms.indexed(spark.createDataFrame([("it is of it",), ("i t i",)], "term string"))
    assert {r.kind for r in index.collect()} == {"chars"}
    assert terms.candidates(docs, index).count() <= 311
    found = terms.phrases(docs, spark.createDataFrame([("it is of it",), ("i t i",)], "term string"))
    assert found.where("doc_id = 1").count() == 1 and found.where("doc_id = 2").count() == len(list(search("it is of " * 300, "it is of it")))


def test_final_sigma(spark):
    docs = spark.createDataFrame([(1, "字ΔΟΣΑ 字ΔΟΣ"), (2, "ΟΔΟΣ οδος")], "doc_id long, text string")
    found = terms.phrases(docs, spark.createDataFrame([("字ΔΟΣ",), ("ΟΔΟΣ",)], "term string"))
    assert sorted((r.doc_id, r.start) for r in found.collect()) == [(1, 0), (1, 6), (2, 0), (2, 5)]
