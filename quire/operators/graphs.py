"""Fixpoints over edge tables. Rounds run until nothing changes; each writes only what is new.

Edges are ``src, dst``; edges with a null end are no edges, repeated edges count once, and a node's edge to
itself is a cycle. A round is a join on a node and a sum per node, so a node with very many edges is
pre-aggregated on the side of the messages and split on the side of the edges, by the adaptive join or,
where edges lie in buckets, into slots.
Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import bucketed, ensure_checkpoint_dir

# Edges in one bucket of a written table, and steps after which a walk is taken to be on a cycle until that is checked.
BUCKET, PROBE = 1_000_000, 8


def plain(edges: DataFrame) -> DataFrame:
    """Each edge once, written: for ``components`` and ``cycles`` of the same edges with ``written``."""
    ensure_checkpoint_dir(edges.sparkSession)
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct().checkpoint()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def trim(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without a predecessor and nodes without a successor are taken away
    again and again; none exactly if there is no cycle."""
    live, count = edges, edges.count()
    while count:
        # ends go before beginnings: leaves are most of a tree
        inner = live.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = inner.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst").checkpoint()
        left = kept.count()
        if left == count:
            break
        live, count = kept, left
    return live


def _spread(edges: DataFrame, start: DataFrame, value: str) -> DataFrame:
    """``node, value``: the least value that reaches each node; only nodes that changed send on."""
    known = front = start
    while not front.isEmpty():
        sent = front.select(F.col("node").alias("src"), value).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(
            F.min(value).alias("sent"))
        front = sent.join(known, "node").where(F.col("sent") < F.col(value)).select("node", F.col("sent").alias(value)).checkpoint()
        known = known.unionByName(front).groupBy("node").agg(F.min(value).alias(value)).checkpoint()
    return known


def reach(edges: DataFrame, roots: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``*keys, node, depth``: everything reachable from ``roots(*keys, node)`` along edges ``*keys, src, dst``,
    with the fewest steps to it."""
    ensure_checkpoint_dir(edges.sparkSession)
    on = [*keys, "node"]
    front = roots.select(*on).distinct().withColumn("depth", F.lit(0)).checkpoint()
    seen = [front]
    while not front.isEmpty():
        step = front.withColumnRenamed("node", "src").select(*keys, "src").join(edges, [*keys, "src"]).select(
            *keys, F.col("dst").alias("node")).distinct()
        front = step.join(_union(seen).select(*on), on, "left_anti").withColumn("depth", F.lit(len(seen))).checkpoint()
        seen.append(front)
    return _union(seen)


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, depth``: everything reachable from ``roots(node)`` and the fewest steps to it. Every round
    reads the edges, so they are written first."""
    return reach(plain(edges), roots)


def components(edges: DataFrame, written: bool = False) -> DataFrame:
    """``node, component``: every node on a cycle with the least node of its strongly connected component.

    Each round trims both ends, lets every node take the least node that reaches it, and walks back from
    these nodes among nodes of their own colour: what is reached both ways is a component and goes.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    live, found = trim(edges.select("src", "dst") if written else plain(edges)), []
    while not live.isEmpty():
        nodes = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = _spread(live, nodes.withColumn("colour", F.col("node")).checkpoint(), "colour")
        inner = live.join(colours.withColumnsRenamed({"node": "src", "colour": "component"}), "src").join(
            colours.withColumnsRenamed({"node": "dst", "colour": "other"}), "dst").where("component = other")
        back = inner.select("component", F.col("dst").alias("src"), F.col("src").alias("dst")).checkpoint()
        own = colours.where("node = colour").select(F.col("colour").alias("component"), "node")
        members = reach(back, own, ("component",)).select("node", "component").checkpoint()
        # a colour whose first node is on no cycle is that node alone
        cyclic = members.groupBy("component").agg(F.count("*").alias("n")).join(
            live.where("src = dst").select(F.col("src").alias("component"), F.lit(True).alias("loop")), "component", "left").where(
            "n > 1 or loop").select("component")
        found.append(members.join(cyclic, "component", "left_semi").select("node", "component").checkpoint())
        gone = members.select("node")
        live = trim(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(
            gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst").checkpoint())
    if found:
        return _union(found)
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).where(F.lit(False))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes ``node`` that lie on a cycle."""
    return components(edges).select("node")


def cycles(edges: DataFrame, parts: DataFrame, written: bool = False) -> DataFrame:
    """``component, cycle``: of each component a shortest cycle through its least node, beginning there;
    of equal ones the one whose nodes, from the last, are least."""
    inner = (edges if written else plain(edges)).join(parts.withColumnRenamed("node", "src"), "src").join(
        parts.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other").select(
        "component", "src", "dst").checkpoint()
    found = reach(inner, parts.where("node = component"), ("component",)).checkpoint()
    far = found.select("component", F.col("node").alias("src"), "depth")
    # of each node the least one a step nearer to the first
    before = inner.join(far, ["component", "src"]).join(
        found.select("component", F.col("node").alias("dst"), F.col("depth").alias("at")), ["component", "dst"]).where(
        "depth = at - 1").groupBy("component", "dst").agg(F.min("src").alias("before")).checkpoint()
    ends = inner.where("dst = component").join(far, ["component", "src"]).groupBy("component").agg(F.min(F.struct("depth", "src")).alias("e"))
    walk, done = ends.select("component", F.col("e.src").alias("at"), F.array("e.src").alias("cycle")).checkpoint(), []
    while True:
        done.append(walk.where("at = component").select("component", "cycle"))
        walk = walk.where("at <> component").join(before.withColumnRenamed("dst", "at"), ["component", "at"]).select(
            "component", F.col("before").alias("at"), F.concat(F.array("before"), "cycle").alias("cycle")).checkpoint()
        if walk.isEmpty():
            return _union(done)


class _Steps:
    """Edges ``src, dst, ord``, each once, written in buckets of their source; what goes one step on is moved to them. The
    edges of a source with more than a bucket of them lie in several slots, and what stands at it is sent to each slot."""

    def __init__(self, edges: DataFrame) -> None:
        edges = edges.where("src is not null and dst is not null").select("src", "dst", "ord")
        self.kind = edges.select(F.coalesce("src", "dst")).schema[0].dataType
        seen = edges.select(F.xxhash64(F.col("src").cast(self.kind)).alias("h")).agg(
            F.count("*").alias("n"), F.expr("approx_top_k(h, 1000, 10000)").alias("top")).first()
        often = {r["item"]: r["count"] for r in seen.top or () if r["count"] > BUCKET}
        self.hot, self.slots = list(often), -(-max(often.values(), default=0) // BUCKET)
        self.keys = ["src", "slot"] if self.hot else ["src"]  # one slot for all would be taken for no key
        conf = edges.sparkSession.conf
        # fewer buckets than a shuffle has parts would be shuffled again
        buckets = max(int(conf.get("spark.sql.shuffle.partitions")), -(-seen.n // BUCKET),
                      int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1")))
        if self.hot:
            spread = F.pmod(F.xxhash64("dst", "ord"), F.lit(self.slots)).cast("int")
            edges = edges.withColumn("slot", F.when(self._often("src"), spread).otherwise(0))
        once = edges.repartition(buckets, *self.keys).groupBy(*self.keys, "dst", "ord").agg(F.lit(1).alias("_n")).drop("_n")
        self.rows = bucketed(once, buckets, *self.keys)

    def _often(self, node: str):
        return F.xxhash64(F.col(node).try_cast(self.kind)).isin(self.hot)

    def after(self, front: DataFrame) -> DataFrame:
        """Rows of ``front(node, ..)`` with each edge that leaves their node."""
        at = front.withColumnRenamed("node", "src")
        if self.hot:
            slots = F.when(self._often("src"), F.sequence(F.lit(0), F.lit(self.slots - 1))).otherwise(F.array(F.lit(0)))
            at = at.withColumn("slot", F.explode(slots))
        return at.join(self.rows, self.keys)

    def longest(self, nodes: DataFrame) -> int | None:
        """Steps of the longest walk from ``nodes(node)``; none if it has more than ``PROBE``, as every walk on a cycle has."""
        for steps in range(PROBE + 1):
            nodes = self.after(nodes).select(F.col("dst").alias("node")).distinct().checkpoint()
            if nodes.isEmpty():
                return steps
        return None


def ordered_closure(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each root includes, as a depth-first reading of ``src, dst, ord`` would meet it.

    The first table has ``root, node, first, visits, depth``: the ordinals of the first way to the node, whose
    order is the order of first visits, how many ways lead there, and the steps of the shortest. A
    round carries for each root the nodes one step on, with their number of ways and the first of them,
    so ways are counted and never listed; the edges stay where they are written. Walks that end within a few steps
    meet no cycle; only where one does not, nodes that reach a cycle are looked for. The second table has ``root, cyclic,
    sources, visits, deepest``: a root that reaches a cycle is refused and has nothing but itself. Limits are for the
    caller to judge; nothing is cut.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    steps = _Steps(edges)
    named = roots.select(F.col("node").alias("root")).where("root is not null").distinct().checkpoint()
    longest = steps.longest(named.withColumnRenamed("root", "node"))
    bad = named.limit(0)
    if longest is None:
        on_cycle = components(steps.rows, written=True).select("node").checkpoint()
        back = steps.rows.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
        bad = reach(back, on_cycle).select(F.col("node").alias("root")).distinct().checkpoint()
    one = F.lit(1).cast("decimal(38,0)")
    front = named.join(bad, "root", "left_anti").select(
        "root", F.col("root").alias("node"), F.array().cast("array<bigint>").alias("first"), one.alias("ways"), F.lit(0).alias("depth")).checkpoint()
    levels = [front]
    while len(levels) <= longest if longest is not None else not front.isEmpty():
        sent = steps.after(front).select(
            "root", F.col("dst").alias("node"), F.concat("first", F.array(F.col("ord").cast("bigint"))).alias("first"), "ways",
            F.lit(len(levels)).alias("depth"))
        # the last step is summed with the rest
        front = sent if len(levels) == longest else sent.groupBy("root", "node").agg(
            F.min("first").alias("first"), F.sum("ways").cast("decimal(38,0)").alias("ways"), F.min("depth").alias("depth")).checkpoint()
        levels.append(front)
    every = _union(levels)
    found = every.groupBy("root", "node").agg(
        F.min("first").alias("first"), F.sum("ways").cast("decimal(38,0)").alias("visits"), F.min("depth").alias("depth"), F.max("depth").alias("deepest"))
    totals = found.groupBy("root").agg(
        F.count("*").alias("sources"), F.sum("visits").cast("decimal(38,0)").alias("visits"), F.max("deepest").alias("deepest"))
    gate = named.join(bad.withColumn("cyclic", F.lit(True)), "root", "left").join(totals, "root", "left").select(
        "root", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "sources", "visits", "deepest")
    return found.drop("deepest"), gate


def closure_gate(gate: DataFrame, most_depth: int, most_visits: int) -> DataFrame:
    """``root, state``: ``cycle``, ``too-deep``, ``too-many`` or ``ok``; ``most_depth`` counts the root."""
    state = F.when(F.col("cyclic"), "cycle").when(F.col("deepest") + 1 > most_depth, "too-deep").when(
        F.col("visits") > most_visits, "too-many").otherwise("ok")
    return gate.withColumn("state", state)
