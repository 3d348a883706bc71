"""Operators on small frames: boundaries, ties, nulls, large keys and repartitioned inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.text import casefold, excerpt, trimmed
from quire.operators import graphs, identity, locate, report, scan, spans


def test_long_hits_keep_their_neighbours(spark):
    docs = spark.createDataFrame([(1, "a" * 70 + "Z"), (2, "aaaZ"), (3, "b " + "a" * 90 + " c")], "doc_id long, text string")
    assert {(r.doc_id, r.after) for r in locate.find_all(docs, "a+").collect()} == {(1, "Z"), (2, "Z"), (3, " ")}
    assert [r.doc_id for r in locate.find_bounded(docs, "a+", after="A-Z").collect()] == [3]


def test_hits_equal_the_standard_library(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab1 \né.") for _ in range(rng.randrange(200))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for m in re.finditer("[ab]+|1", t):
            want.add((d, m.start(), m.end(), m[0], t[:m.start()].count("\n") + 1, m.start() - t.rfind("\n", 0, m.start()),
                      t[m.start() - 1:m.start()], t[m.end():m.end() + 1], t[max(0, m.start() - 20):][:60].replace("\n", " ").strip(" ")))
    got = {(r.doc_id, r.start, r.end, r.token, r.line, r.col, r.before, r.after, r.excerpt) for r in locate.find_all(docs, "[ab]+|1").collect()}
    assert got == want


def islands(rows):
    out = {}
    for key, a, b in sorted(r for r in rows if r[1] < r[2]):
        own = out.setdefault(key, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
            own[-1][2] += 1
        else:
            own.append([a, b, 1])
    return sorted((k, *x) for k, own in out.items() for x in own)


@pytest.mark.parametrize("width", [None, 7])
def test_merged_spans_with_repeats(spark, width):
    rng = random.Random(1)
    rows = [("k" + str(rng.randrange(3)), a := rng.randrange(300), a + rng.randrange(6)) for _ in range(400)]
    rows += rows[:80]
    frame = spark.createDataFrame(rows, "k string, start int, end int")
    for parts in (1, 5):
        got = spans.merge_spans(frame.repartition(parts), ["k"], width=width)
        assert sorted((r.k, r.start, r.end, r.pieces) for r in got.collect()) == islands(rows)


@pytest.mark.parametrize("width", [None, 4])
def test_asof_keeps_nulls_and_fractions(spark, width):
    left = spark.createDataFrame([("a", 1.4), ("a", 9.9), (None, 3.0), ("a", None), ("b", 0.1)], "k string, at double")
    right = spark.createDataFrame([("a", 1.5, 7), ("a", 1.3, 6), (None, 2.0, 5)], "k string, since double, v int")
    got = scan.asof(left, right, ["k"], "at", "since", ["v"], width)
    assert {(r.k, r.at, r.v) for r in got.collect()} == {("a", 1.4, 6), ("a", 9.9, 7), (None, 3.0, 5), ("a", None, None), ("b", 0.1, None)}


def test_first_region_wins(spark):
    docs = spark.createDataFrame([(1, "x [% lit] y % c [z]")], "doc_id long, text string")
    got = spans.find_regions(docs, {"comment": "%[^\n]*", "literal": r"\[[^\]]*\]"})
    assert sorted((r.kind, r.token) for r in got.collect()) == [("comment", "% c [z]"), ("literal", "[% lit]")]


def test_nested_paths(spark):
    paths = spark.createDataFrame([(p,) for p in ("/", "/a", "/A/", "/a/b", "/ab", "c/d", None)], "path string")
    got = {(r.outer_path, r.inner_path) for r in spans.nested_paths(paths).collect()}
    assert got == {("/", "/a"), ("/", "/A/"), ("/", "/a/b"), ("/", "/ab"), ("/A/", "/a"), ("/a", "/a/b"), ("/A/", "/a/b")}


def stack_pairs(marks):
    """Scopes of one text by a plain stack."""
    stack, out = [], []
    for name, opens, start, end in marks:
        if opens:
            stack.append((name, end))
        elif stack and stack[-1][0] == name:
            out.append((name, stack.pop()[1], start, len(stack)))
    return out


def test_scopes_pair_by_stack(spark):
    """Crossing names, surplus closers, openers that stay open, null keys and names."""
    rng = random.Random(6)
    texts = {1: "<u><u></u></u></u><u><p></u>", 2: "<a><b></a></b>", 3: "</a></b><a></a><b>", None: "<u></u>", 4: ""}
    texts |= {i: "".join(rng.choice(["<a>", "</a>", "<b>", "</b>", "<c>", "</c>", "x"]) for _ in range(60)) for i in range(10, 30)}
    rows = [(d, m[0].strip("</>"), not m[0].startswith("</"), m.start(), m.end()) for d, t in texts.items() for m in re.finditer("</?[abcup]>", t)]
    frame = spark.createDataFrame([*rows, (1, None, True, 2, 3)], "doc_id long, name string, open boolean, start int, end int").repartition(5)
    got = sorted((str(r.doc_id), r.name, r.start, r.end, r.depth) for r in spans.pair_scopes(frame).collect())
    assert got == sorted((str(d), *s) for d in texts for s in stack_pairs([r[1:] for r in rows if r[0] == d]))
    assert [g[1:] for g in got if g[0] == "2"] == [("b", 6, 10, 1)]
    assert sorted(g[1:] for g in got if g[0] == "1") == [("u", 3, 10, 0), ("u", 6, 6, 1)]
    assert spans.pair_scopes(frame.limit(0)).count() == 0


def test_overlaps_longest_first(spark):
    rng = random.Random(7)
    hits = []
    for i in range(200):
        start, size = rng.randrange(400), rng.randrange(1, 12)
        hits.append((1, start, start + size, size, i))
    frame = spark.createDataFrame(hits, "doc_id long, start int, end int, form_length int, ord int").repartition(4)
    kept = []
    for h in sorted(hits, key=lambda h: (-h[3], h[4], h[1])):
        if all(h[2] <= k[1] or k[2] <= h[1] for k in kept):
            kept.append(h)
    assert sorted(r.ord for r in spans.resolve_overlaps(frame).collect()) == sorted(h[4] for h in kept)


def test_waivers_reach_the_next_line_unless_protected(spark):
    findings = spark.createDataFrame([(1, n, "x") for n in range(1, 7)], "doc_id long, line int, check string")
    waivers = spark.createDataFrame([(1, 1, "x", False), (1, 4, "x", True), (1, 6, "all", False)], "doc_id long, line int, check string, protected boolean")
    assert sorted(r.line for r in spans.apply_waivers(findings, waivers).collect()) == [3, 4, 5]


def test_report_keeps_null_groups_and_cells(spark):
    rows = spark.createDataFrame([(None, 1, None), ("a", 2, "x|y"), ("a", 3, "<z>")], "check string, line int, token string")
    top = report.top_per_group(rows, ["check"], ["line"], 1)
    assert {(r.check, r.line, r.total, r.more) for r in top.collect()} == {(None, 1, 1, 0), ("a", 2, 2, 1)}
    shown = [r.line_text for r in report.render_locations(rows, ["check", "line", "token"], ["line"], 2).orderBy("place").collect()]
    assert shown == ["| <code></code> | 1 | <code></code> |", "| <code>a</code> | 2 | <code>x&#124;y</code> |", "1 more"]
    none = report.render_locations(rows.limit(0), ["line"], ["line"], 2).collect()
    assert [r.line_text for r in none] == ["0 more"]


def test_text_functions(spark):
    one = spark.createDataFrame([("Straße", "\t  a b "), ("STRASSE", "x"), (None, None)], "a string, b string")
    rows = one.select(casefold(F.col("a")).alias("a"), trimmed(F.col("b")).alias("b"), excerpt(F.col("a"), F.lit(0)).alias("e")).collect()
    assert [r.a for r in rows] == ["strasse", "strasse", None] and [r.b for r in rows] == ["a b", "x", None]


def test_patch_refuses_whole_batches(spark):
    units = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "part string, i int, text string")
    good = spark.createDataFrame([("a", 0, "x", "X"), ("b", 0, "old", "Z"), ("c", 0, "q", "Q")], "part string, i int, expected string, text string")
    got = {(r.part, r.i): (r.text, r.refused) for r in identity.apply_patch(units, good, ["i"], "part").collect()}
    assert got == {("a", 0): ("X", False), ("a", 1): ("y", False), ("b", 0): ("z", True)}


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (5, 1), (6, 6)], "src long, dst long")
    assert sorted(r.node for r in graphs.cyclic_nodes(edges).collect()) == [2, 3, 6]
    found = graphs.closure(edges, spark.createDataFrame([(5,)], "node long"))
    assert sorted((r.node, r.depth) for r in found.collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 0)]
