"""Running totals and lookups against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm.prefix import attach, scan


@pytest.fixture()
def rows():
    rng = random.Random(3)
    keys = [None, "a", "b", "c"] + ["hot"] * 8
    return [(rng.choice(keys), rng.randrange(50), rng.randrange(99)) for _ in range(600)]


def test_scan(spark, rows, ranges):
    frame = spark.createDataFrame(rows, "k string, o int, v long").withColumn("w", F.xxhash64("o", "v")).repartition(7)
    done = scan(frame, ["k"], ["o", "v"], {"v": "sum", "w": "xor"}, "test-scan").collect()
    assert len({r["_part"] for r in done if r["k"] == "hot"}) > 1  # a key over several ranges
    # equal rows may stand in any order, so the totals of a key are compared as sorted lists
    sums, xors = {}, {}
    for r in sorted(done, key=lambda r: (str(r.k), r.o, r.v, r.before_v)):
        assert sums.get(r.k, 0) == r.before_v
        sums[r.k] = sums.get(r.k, 0) + r.v
    for key in {r.k for r in done}:
        own = [r for r in done if r.k == key]
        after = sorted(r.before_w ^ r.w for r in own)
        before = sorted(r.before_w for r in own)
        total = 0
        for r in own:
            total ^= r.w
        assert sorted([*before, total]) == sorted([0, *after])
        xors[key] = total
    assert len(xors) == 5


def test_scan_without_keys_and_empty(spark, ranges):
    frame = spark.createDataFrame([(i, 1) for i in range(100)], "o int, v long").repartition(5)
    done = scan(frame, [], ["o"], {"v": "sum"}, "test-all")
    assert sorted((r.o, r.before_v) for r in done.collect()) == [(i, i) for i in range(100)]
    assert scan(frame.limit(0), ["o"], ["v"], {"v": "sum"}, "test-none").count() == 0


def test_attach_meets_nulls_and_hot_keys(spark, rows, ranges):
    placed = scan(spark.createDataFrame(rows, "k string, o int, v long").repartition(4), ["k"], ["o"], {"v": "sum"}, "test-attach")
    info = spark.createDataFrame([(None, 1), ("hot", 2), ("z", 3)], "k string, i int")
    met = attach(placed, info, ["k"])
    assert {(r.k, r.i) for r in met.collect()} == {(None, 1), ("hot", 2)}
    assert met.count() == sum(k in (None, "hot") for k, _, _ in rows)
    assert attach(placed, info, ["k"], "left").count() == len(rows)
