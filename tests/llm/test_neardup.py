"""Links and components against brute force."""

import numpy as np
import pytest

from quire.llm import neardup
from tests.oracle import compare


def test_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", neardup.op5_neardup, neardup.OP5_SQL) == 500


def brute(rows):
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9] for i in good}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(seen))
    return out


@pytest.mark.parametrize("block", [128, 7])
def test_groups_chains_copies_and_bad_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 1, 2, 3, 40, 90):  # tight groups, some far above the length of a list
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * 0.05).tolist() for _ in range(size)]
    a, b = rng.normal(size=(2, 16))
    rows += [(np.cos(t) * a / np.linalg.norm(a) + np.sin(t) * b / np.linalg.norm(b)).tolist() for t in np.linspace(0, 1.5, 9)]  # a chain
    rows += [rows[0]] * 5 + [[2 * x for x in rows[1]]] + rng.normal(size=(60, 16)).tolist()
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0, 0.0], [1.0, 0.01]]
    listed = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(rows)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in listed], "vec_id long, embedding array<double>, node int, size int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.all_rows(table.union(table.limit(2))).collect()}
    assert got == brute(listed)


def found(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id) for r in neardup.all_rows(table).collect()}


@pytest.mark.parametrize("block", [128, 7])
def test_links_that_are_not_transitive(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(5)
    arc = lambda plane, d: np.cos(np.radians(d)) * np.eye(12)[2 * plane] + np.sin(np.radians(d)) * np.eye(12)[2 * plane + 1]
    rows = [arc(0, d) for d in (0, 50, 25)] + [arc(1, d) for d in (25, 0, 50)]  # V shapes
    order = [int(i) for i in rng.permutation(np.arange(10, 50))]
    rows += [arc(2 + i % 4, 20 * (i // 4)) for i in range(40)]  # chains with shuffled ids
    listed = [(i, [float(x) for x in v]) for i, v in zip([1, 2, 3, 4, 5, 6, *order], rows)]
    got = found(spark, listed)
    assert got == brute(listed)
    assert [got[i] for i in (1, 2, 3)] == [(1, 1), (1, 1), (2, 1)]


def test_bridge_between_saturated_groups(spark):
    rng = np.random.default_rng(6)
    a, b = np.eye(32)[:2]
    at = lambda d: np.cos(np.radians(d)) * a + np.sin(np.radians(d)) * b
    cloud = lambda d: [at(d) + rng.normal(size=30) @ np.eye(32)[2:] * 0.015 for _ in range(40)]
    rows = [*cloud(0), *cloud(30), at(3), at(27)]  # only the last two link the groups
    listed = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows)]
    want = brute(listed)
    assert {root for _, root in want.values()} == {0} and sorted({n for n, _ in want.values()}) == [40, 41]
    assert found(spark, listed) == want


def test_search_that_finds_nothing_ends_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup, "start", lambda rows, *rest: spark.createDataFrame([], neardup.PROPOSED))
    monkeypatch.setattr(neardup, "descend", lambda rows, lists, seed: (lists, 0))
    rng = np.random.default_rng(7)
    rows = [v + rng.normal(size=16) * 0.02 for v in rng.normal(size=(30, 16)) for _ in range(3)]
    listed = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    assert found(spark, listed) == brute(listed)


def test_audit_sees_lost_pairs_beside_a_hot_group(spark):
    rng = np.random.default_rng(8)
    centre, places = rng.normal(size=32), rng.normal(size=(40, 32))
    rows = [centre + rng.normal(size=32) * 0.02 for _ in range(400)] + [v + rng.normal(size=32) * 0.02 for v in places for _ in range(2)]
    nodes = spark.createDataFrame([(i, (v / np.linalg.norm(v)).astype(np.float32).tobytes()) for i, v in enumerate(rows)], "node long, v binary")
    hot = [(i, 0) for i in range(400)]
    pairs = [(i, i - i % 2) for i in range(400, 480)]
    grouped = lambda rows: spark.createDataFrame(rows, "node long, component long")
    assert neardup.audit(nodes, grouped(hot), 0) == 0
    assert neardup.audit(nodes, grouped(hot + pairs), 0) == 1


def test_trees_grow_with_the_table():
    for bits in (1, 8, 16):
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** neardup.trees_needed(bits) >= 0.999


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neardup.all_rows(none).count() == 0
    bad = spark.createDataFrame([(4, None), (5, [0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.all_rows(bad).collect()) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_extreme_finite_vectors_link(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1e-200, 0.0]), (4, [5e-324, 0.0]), (5, [0.0, 1e308]), (6, [0.0, 0.0]), (7, [float("inf"), 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.all_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_audit_without_links_measures_nothing(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 64)))], "vec_id long, embedding array<double>")
    classes = neardup.unit_vectors(vectors).withColumnRenamed("vec_id", "node")
    rows = neardup._single(classes)
    grouped = classes.select("node", classes["node"].alias("component"))
    assert neardup.audit(rows, grouped, 0, spark.createDataFrame([], "node long, near long, s double")) is None
    assert {r.n_links for r in neardup.all_rows(vectors).collect()} == {0}
