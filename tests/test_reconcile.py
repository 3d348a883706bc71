"""Reconciliation on small frames: null keys, repeats, empty sides, and every state."""

import random

from pyspark.sql import functions as F

from quire.operators import identity, reconcile


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k string")


class rows(list):
    """Rows in any order."""

    def __init__(self, df):
        super().__init__(sorted(map(tuple, df.collect()), key=str))

    def __eq__(self, other):
        return list(self) == sorted(other, key=str)


def test_null_keys_equal_each_other(spark):
    a, b = keys(spark, None, "x", "x", "y"), keys(spark, None, "y", "z")
    assert rows(reconcile.missing(a, b, ["k"])) == [("x",)]
    assert rows(reconcile.set_equal(a, b, ["k"])) == [("x", "missing"), ("z", "unexpected")]
    assert rows(reconcile.set_equal(a, a, ["k"])) == []
    assert rows(reconcile.coverage(a, b.union(b.where("k = 'y'")), "k")) == [
        (None, 1, "covered"), ("x", 0, "missing"), ("y", 2, "repeated"), ("z", 1, "unknown")]
    ab = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    assert rows(reconcile.reciprocal(ab, ab, "a", "b")) == []
    assert rows(reconcile.reciprocal(ab, ab.limit(0), "a", "b")) == [(1, 2, "forward"), (1, None, "forward")]
    cells = reconcile.scope_matrix([keys(spark, "x", None), spark.createDataFrame([(1,)], "d int")],
                                   spark.createDataFrame([(None, 1), ("q", 1), ("q", 1)], "k string, d int"), ["k", "d"])
    assert rows(cells) == [("q", 1, 2, "unexpected"), ("x", 1, 0, "missing"), (None, 1, 1, "once")]


def test_snapshots_and_revisions(spark):
    shape = "k string, v string"
    a = spark.createDataFrame([(None, "1"), ("x", "1"), ("x", "2"), ("n", None), ("gone", "1")], shape)
    b = spark.createDataFrame([(None, "1"), ("x", "2"), ("n", None), ("new", None)], shape)
    assert rows(identity.snapshot_diff(a, b, "k", "v")) == [("gone", "removed"), ("n", "same"), ("new", "added"), ("x", "same"), (None, "same")]
    assert rows(identity.merge_revisions(a.where("v is null or v <> '2'"), b, "k", "v")) == [
        ("gone", "1", False), ("n", None, False), ("new", None, False), ("x", "1", True), (None, "1", False)]
    assert rows(identity.snapshot_diff(a.limit(0), b.limit(0), "k", "v")) == []


def test_relations_meet_every_state(spark):
    ab = spark.createDataFrame([(1, [10, 11, 12, 12]), (2, [10]), (3, None), (None, [10]), (9, [10])], "a int, bs array<int>")
    ba = spark.createDataFrame([(10, [1, 2, 2]), (11, []), (12, [1]), (13, [1]), (99, [1])], "b int, xs array<int>")
    got = reconcile.relations(ab, ba, "a", "b", spark.createDataFrame([(i,) for i in (1, 2, 3)], "a int"), spark.createDataFrame([(i,) for i in (10, 11, 12, 13)], "b int"))
    assert {(r.a, r.b): (r.forward, r.backward, r.state) for r in got.collect()} == {
        (1, 10): (1, 1, "mutual"), (1, 11): (1, 0, "one-sided"), (1, 12): (2, 1, "repeated"), (1, 13): (0, 1, "one-sided"), (1, 99): (0, 1, "dangling"),
        (2, 10): (1, 2, "repeated"), (None, 10): (1, 0, "dangling"), (9, 10): (1, 0, "dangling")}


def test_latest_attempt_refuses_repeated_generations(spark):
    jobs = spark.createDataFrame([("Build", 1, "x"), ("build", 2, "y"), ("BUILD", 2, "z"), ("test", 1, "a"), ("test", 3, "b"), ("old", 1, "p"), ("old", 1, "p"),
                                  ("old", 2, "q"), (None, 1, "n")], "name string, attempt int, state string")
    got = reconcile.latest_attempt(jobs, F.col("name"), ["attempt"])
    assert rows(got.select("key", "attempts", "refused", "attempt", "state")) == [
        ("build", 3, True, 2, "y"), ("old", 3, True, 2, "q"), ("test", 2, False, 3, "b"), (None, 1, False, 1, "n")]


def test_crosswalk_keeps_items_once(spark):
    items, source = keys(spark, "a", "a", "b", None), spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x"), (None, "x")], "k string, state string")
    assert rows(reconcile.crosswalk(items, {"s": source}, "k")) == [("a", "ambiguous"), ("b", "not-performed"), (None, "x")]


def brute_contract(events):
    first, out = {}, {}
    for scope, id_, parent, seq, passed in events:
        if None not in (scope, id_, seq):
            first.setdefault((scope, id_), []).append((seq, (parent is not None, parent or ""), passed))
    for (scope, id_), own in first.items():
        seq, (has, parent), _ = min((s, p, 0) for s, p, _ in own)
        seqs = {min(r[0] for r in v) for (s, _), v in first.items() if s == scope}
        earlier = [s for s in seqs if s < seq]
        above = first.get((scope, parent)) if has else None
        faults = ["duplicate"] * (len(own) > 1) + ["gap"] * (seq > max(earlier, default=0) + 1) + ["orphan"] * (has and above is None)
        faults += ["early"] * (above is not None and min(r[0] for r in above) >= seq) + ["failed"] * (not all(p for *_, p in own))
        out[scope, id_] = faults
    return out


def test_event_contract(spark):
    rng = random.Random(4)
    events = [(rng.choice("st"), f"e{i}", rng.choice([None, f"e{rng.randrange(40)}", "nobody"]), rng.randrange(1, 60), rng.choice([True, True, False, None]))
              for i in range(40)]
    events += events[:6] + [("u", "a", None, 1, True), ("u", "b", "a", 2, True), (None, "a", None, 1, True), ("u", None, None, 3, True), ("u", "c", "b", None, True)]
    frame = spark.createDataFrame(events, "scope string, id string, parent string, sequence int, passed boolean").repartition(4)
    want = brute_contract(events)
    for width in (1024, 5):
        got = {(r.scope, r.id): list(r.faults) for r in reconcile.event_contract(frame, width=width).collect()}
        assert got == want
    assert {f for fs in want.values() for f in fs} == {"duplicate", "gap", "orphan", "early", "failed"} and want["u", "b"] == []
    assert reconcile.event_contract(frame.limit(0)).count() == 0
