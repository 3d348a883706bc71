"""Components, cycles and closures against walks over small graphs."""

import random
import time

import pytest

from quire.operators import graphs


def reachable(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for node in {x for e in edges for x in e}:
        seen, todo = set(), [node]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        found[node] = seen
    return found


def some_graphs():
    rng = random.Random(8)
    yield [(rng.randrange(40), rng.randrange(40)) for _ in range(48)]
    yield [(i, i + 1) for i in range(12)] + [(20, 21), (21, 22), (22, 20), (22, 12), (5, 20), (30, 30), (31, 30), (30, 32)]
    yield [(i, (i + 1) % 9) for i in range(9)] + [(3, 1), (9, 10), (10, 9), (10, 4)]


@pytest.mark.parametrize("edges", list(some_graphs()))
def test_components_and_cycles(spark, edges):
    frame = spark.createDataFrame([*edges, *edges[:3], (None, 1), (2, None)], "src long, dst long").repartition(3)
    ways = reachable(edges)
    want = {v: min(u for u in ways if u in ways[v] and v in ways[u]) for v in ways if v in ways[v]}
    parts = graphs.components(frame)
    assert {r.node: r.component for r in parts.collect()} == want and parts.count() == len(want)
    assert {r.node for r in graphs.cyclic_nodes(frame).collect()} == set(want)
    named = {r.component: list(r.cycle) for r in graphs.cycles(frame, parts).collect()}
    assert set(named) == set(want.values())
    for root, nodes in named.items():
        assert nodes[0] == root and len(set(nodes)) == len(nodes)
        assert all((a, b) in edges for a, b in zip(nodes, nodes[1:] + nodes[:1]))


def test_no_cycle_and_empty(spark):
    line = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert graphs.components(line).count() == 0 and graphs.components(line.limit(0)).count() == 0
    assert graphs.trim(line).count() == 0


def read(edges, node, path=(), order=None, ways=None):
    """Depth-first reading of includes in order; every way counts as a visit."""
    order, ways = ([], {}) if order is None else (order, ways)
    if node not in ways:
        order.append(node)
    ways[node] = ways.get(node, 0) + 1
    for _, child in sorted(edges.get(node, [])):
        read(edges, child, (*path, node), order, ways)
    return order, ways


def test_ordered_closure(spark):
    rng = random.Random(2)
    rows = {(a, b, rng.randrange(9)) for _ in range(60) if (a := rng.randrange(24)) < (b := rng.randrange(25))}
    rows |= {(100, 101, 1), (101, 102, 1), (102, 100, 2), (99, 100, 5), (7, 7000, 3)}
    by = {}
    ords = {}
    for a, b, o in sorted(rows):  # one place for one include
        o = ords[a] = ords.get(a, 0) + 1
        by.setdefault(a, []).append((o, b))
    frame = spark.createDataFrame([(a, b, o) for a, cs in by.items() for o, b in cs], "src long, dst long, ord int")
    roots = [0, 3, 24, 99, 101, 5000]
    found, gate = graphs.ordered_closure(frame, spark.createDataFrame([(r,) for r in [*roots, 3, None]], "node long"))
    rows, gates = found.collect(), {r.root: r for r in graphs.closure_gate(gate, 6, 40).collect()}
    assert set(gates) == set(roots)
    for root in roots:
        if root in (99, 101):
            assert gates[root].state == "cycle" and not any(r.root == root for r in rows)
            continue
        order, ways = read(by, root)
        own = sorted((r for r in rows if r.root == root), key=lambda r: list(r.first))
        assert [r.node for r in own] == order
        assert {r.node: int(r.visits) for r in own} == ways
        assert int(gates[root].visits) == sum(ways.values()) and gates[root].sources == len(order)
    states = {r: gates[r].state for r in roots}
    assert states[5000] == "ok" and states[24] == "ok"


def shuffled(spark, action):
    """Bytes that an action shuffles."""
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.range(1).count()
    before = total()
    action()
    time.sleep(0.5)
    spark.range(1).count()  # the store is written again when a task ends
    return total() - before


def tree(spark):
    """Edges from a root to 40 folders, their 1,600 files and 24 lines of each, and the root."""
    rows = [("r", f"d{i}", i) for i in range(40)] + [(f"d{i % 40}", f"f{i}", i) for i in range(1600)]
    rows += [(f"f{i % 1600}", f"l{i * 7919 % 7000}", i) for i in range(38400)]
    return spark.createDataFrame(rows, "src string, dst string, ord long").repartition(3).localCheckpoint(), spark.createDataFrame([("r",)], "node string")


def test_edges_are_moved_once(spark):
    edges, roots = tree(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        once = shuffled(spark, lambda: edges.repartition(8, "src").foreach(lambda r: None))
        contents = shuffled(spark, lambda: graphs.ordered_closure(edges, roots)[0].write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert once > 100_000 and contents < 4 * once, (contents, once)


def test_gate_moves_edges_once(spark):
    edges, roots = tree(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = shuffled(spark, lambda: edges.repartition(8, "src").foreach(lambda r: None))
        rows = []
        gate = shuffled(spark, lambda: rows.extend(graphs.closure_gate(graphs.ordered_closure(edges, roots)[1], 32, 128).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert once > 100_000 and gate < 3 * once, (gate, once)
    assert [(r.root, r.cyclic, r.sources, int(r.visits), r.deepest, r.state) for r in rows] == [("r", False, 8641, 40041, 3, "too-many")]


def test_sources_with_many_edges(spark, monkeypatch):
    """Edges of such a source lie in several buckets; long walks are checked for cycles first."""
    monkeypatch.setattr(graphs, "BUCKET", 3)
    by = {0: [(i, 1 + i % 9) for i in range(1, 25)], **{i: [(1, 30), (2, 31)] for i in range(1, 10)},
          30: [(i, 40 + i) for i in range(1, 8)], **{n: [(1, n + 1)] for n in range(41, 60)}}
    rows = [(a, b, o) for a, outs in by.items() for o, b in outs] + [(70, 71, 1), (71, 70, 1), *[(71, 80 + i, i) for i in range(9)]]
    frame = spark.createDataFrame([*rows, *rows[:9], (None, 1, 1), (0, None, 2)], "src long, dst long, ord int").repartition(5)
    found, gate = graphs.ordered_closure(frame, spark.createDataFrame([(0,), (30,), (70,), (4,)], "node int"))
    out, gates = found.collect(), {r.root: r for r in gate.collect()}
    assert gates[70].cyclic and not any(r.root == 70 for r in out)
    for root in (0, 30, 4):
        _, ways = read(by, root)
        own = [r for r in out if r.root == root]
        assert {r.node: int(r.visits) for r in own} == ways and len(own) == gates[root].sources
        assert int(gates[root].visits) == sum(ways.values()) and not gates[root].cyclic
    assert graphs._Steps(frame).slots > 1 and spark.sql("show tables").count() == 0


def test_gate_sides(spark):
    gate = spark.createDataFrame([("a", False, 3, 31, 128), ("b", False, 3, 32, 1), ("c", False, 3, 3, 129), ("d", True, None, None, None)],
                                 "root string, cyclic boolean, sources long, deepest int, visits long")
    assert {r.root: r.state for r in graphs.closure_gate(gate, 32, 128).collect()} == {"a": "ok", "b": "too-deep", "c": "too-many", "d": "cycle"}


def test_rounds_read_written_edges(spark):
    """The table under the edges is read once, not in every round."""
    table = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 2), (None, 3)], "a long, b long")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    edges = table.repartition(2).mapInArrow(count, "src long, dst long")
    found = graphs.closure(edges, spark.createDataFrame([(0,)], "node long"))
    assert {(r.node, r.depth) for r in found.collect()} == {(i, i) for i in range(7)} and read.value == 8
    once = graphs.plain(edges)
    read.value = 0
    parts = graphs.components(once, written=True)
    assert {r.node for r in parts.collect()} == set(range(2, 7))
    assert [list(r.cycle) for r in graphs.cycles(once, parts, written=True).collect()] == [[2, 3, 4, 5, 6]] and read.value == 0
