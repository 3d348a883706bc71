"""Composed offset maps against one map after the other, for every offset."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import locate


def step(pieces, x):
    """An offset across one map."""
    held = [p for p in pieces if p[0] <= x]
    if not held:
        return x
    a0, a1, b0, b1 = max(held)
    return b0 if x < a1 else x - a1 + b1


def replaced(text, pattern, kept):
    out, gone = [], 0
    for m in re.finditer(pattern, text):
        out.append((m.start(), m.end(), m.start() - gone, m.start() - gone + kept))
        gone += m.end() - m.start() - kept
    return out, re.sub(pattern, "_" * kept, text)


@pytest.mark.parametrize(("first", "second"), [(("x+", 0), ("_+|b+", 1)), (("x+", 2), ("[_b]+", 1)), (("x{2}", 1), ("b", 3)), (("xx?", 0), ("bb?", 0))])
def test_every_offset(spark, first, second):
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("axbb_x") for _ in range(rng.randrange(40))) for i in range(30)} | {90: "", 91: "xxxx", 92: "bxbxb", None: "abxxba"}
    maps, want_there, want_back = ([], []), set(), set()
    for key, text in texts.items():
        a, mid = replaced(text, *first)
        b, final = replaced(mid, *second)
        maps[0].extend((key, *p) for p in a)
        maps[1].extend((key, *p) for p in b)
        want_there |= {(str(key), x, step(b, step(a, x))) for x in range(len(text) + 1)}
        back = lambda pieces, x: step([(p[2], p[3], p[0], p[1]) for p in pieces], x)
        want_back |= {(str(key), x, back(a, back(b, x))) for x in range(len(final) + 1)}
    shape = "doc_id long, from_start int, from_end int, to_start int, to_end int"
    one, two = (spark.createDataFrame(m, shape).repartition(3) for m in maps)
    both = locate.compose_maps(one, two).cache()
    for want, back in ((want_there, False), (want_back, True)):
        points = spark.createDataFrame([(None if k == "None" else int(k), x) for k, x, _ in want], "doc_id long, start int")
        got = {(str(r.doc_id), r.start, r.translated) for r in locate.translate_offsets(points, both, back=back).collect()}
        assert got == want, sorted(got ^ want, key=str)[:6]
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    built = locate.replacement_map(frame, *first)
    assert {tuple(r) for r in built.collect()} == set(maps[0])
    assert locate.compose_maps(one.limit(0), two.limit(0)).count() == 0
    if second[1]:  # else neighbouring pieces become one
        assert {tuple(r) for r in locate.compose_maps(one.limit(0), two).where(F.col("from_end") > F.col("from_start")).collect()} == {m for m in maps[1]}


def test_texts_are_searched_once_for_each_map(spark):
    frame = spark.createDataFrame([(1, "axxb__x"), (2, None), (3, "")], "doc_id long, text string")
    both = locate.compose_maps(locate.replacement_map(frame, "x+", 0), locate.replacement_map(frame, "_+", 1))
    assert "regexp" not in both._jdf.queryExecution().optimizedPlan().toString()
