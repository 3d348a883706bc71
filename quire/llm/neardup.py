"""Near-duplicate embeddings by NN-descent.

Equal vectors form one class and enter as one node. Each node keeps a list of near nodes. The
lists start from trees of random hyperplanes and are refined by rounds of neighbours-of-neighbours
joins: at each node its neighbours, and the nodes that list it, meet, and the pairs met are
proposed to both lists. Rounds stop when few lists change. A bounded sample of nodes is compared
with all rows to audit the recall; while it is below the target, twice as many trees follow, until
they would compare as much as all rows with one another: then that is done, which is exact.

A list whose last place is still above the threshold is saturated: it may have more to hold. Lists
are therefore enlarged to everything their component can hold, a component being what near links
connect: its nodes are compared block against block, in double precision, which decides the links.
A link between two components whose lists are saturated on both sides may stand in no list. So the
saturated nodes of each component are put into balls, and the nodes of two balls near enough for a
link are compared; components that a link is found between become one.
The search before that uses single precision and a slightly lower threshold.

Vectors that are null, zero or hold null or non-finite components link with nothing. Repeated rows
of one vec_id with one vector count once; vectors of different widths never meet. An empty table
gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.graph import components
from quire.llm.shared import batches, by_group, drop, mix, read_table, save

SIMILARITY = 0.9
# Places in a list; nodes that meet at one node of the join at most; nodes in a leaf of a tree.
PLACES, MEET, LEAF = 10, 24, 200
ROUNDS, CHANGED = 4, 0.01
# What single precision may take from a similarity.
LOOSE = 1e-4
# Chance that the trees of the first pass bring a pair at the threshold into one leaf.
MET = 0.999
# Nodes compared with all rows to audit the recall, how many with links to ask for, how many nodes
# to take at most in search of those, and the share of them that must have all their links.
AUDIT, LINKED, WIDEST, RECALL = 400, 20, 6400, 0.99
STRIPE, BLOCK = 512, 128
# Balls in a block when balls are compared.
BALLS = 1024


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: the unit vector of each row that has one, in double precision, as bytes."""

    def unit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for row in batch.column("embedding").to_pylist():
                v = np.array([np.nan if x is None else x for x in row or ()], np.float64)
                most = np.abs(v).max(initial=0.0) if np.isfinite(v).all() else 0.0
                # scaled first, so that no square over- or underflows
                v = v / most if most > 0 else v
                out.append((v / np.sqrt((v * v).sum())).tobytes() if most > 0 else None)
            yield batches({"vec_id": batch.column("vec_id"), "v": pa.array(out, pa.binary())})

    units = vectors.select("vec_id", "embedding").mapInArrow(unit, "vec_id long, v binary")
    return units.where("v is not null").distinct()


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float32) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _single(rows: DataFrame) -> DataFrame:
    """``node, v`` with v in single precision, for the search."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield batches({"node": batch.column("node"), "v": pa.array(
                [np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in batch.column("v").to_pylist()], pa.binary())})

    return rows.select("node", "v").mapInArrow(run, "node long, v binary")


def trees_needed(bits: int) -> int:
    """Trees for ``MET``: a hyperplane parts a pair at the threshold in proportion to its angle."""
    shared = (1 - np.arccos(SIMILARITY) / np.pi) ** bits
    return 1 if shared == 1 else int(np.ceil(np.log(1 - MET) / np.log(1 - shared)))


def codes(rows: DataFrame, bits: int, trees: int, seed: int) -> DataFrame:
    """``leaf, node``: each node once for each tree, in the leaf that the signs of its products with
    the tree's hyperplanes lead to."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            by_width: dict[int, list[int]] = {}
            for i, v in enumerate(batch.column("v")):
                by_width.setdefault(len(v.as_py()), []).append(i)
            for width, index in by_width.items():
                own = batch.take(pa.array(index))
                v = _matrix(own.column("v"))
                for tree in range(trees):
                    planes = np.random.default_rng([seed, tree, width]).normal(size=(v.shape[1], max(bits, 1)))
                    signs = (v @ planes > 0) @ (1 << np.arange(max(bits, 1), dtype=np.int64))
                    leaf = (signs * trees + tree) * 1_000_003 + width
                    yield batches({"leaf": leaf, "node": own.column("node")})

    return rows.mapInArrow(run, "leaf long, node long")


PROPOSED = "node long, near long, s double"


def _best(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The nearest ``PLACES`` of each node among those it meets under one key."""
    for table in by_group(rows, key):
        ids, first = np.unique(table["node"].to_numpy(), return_index=True)
        if len(ids) < 2:
            continue
        v = _matrix(table["v"].take(pa.array(first)))
        for a in range(0, len(ids), STRIPE):
            s = v[a:a + STRIPE] @ v.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            k = min(PLACES, len(ids) - 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield batches({"node": np.repeat(ids[a:a + STRIPE], k), "near": ids[top].ravel(),
                           "s": np.take_along_axis(s, top, 1).ravel().astype(np.float64)})


def shortest(proposed: DataFrame) -> DataFrame:
    """``node, near, s``: the best places of each node. Ranks are cut before the shuffle as well, so
    a node that very many propose to brings few rows from each task."""
    order = Window.partitionBy("node").orderBy(F.desc("s"), "near")
    return proposed.groupBy("node", "near").agg(F.max("s").alias("s")).withColumn(
        "place", F.row_number().over(order)).where(F.col("place") <= PLACES).drop("place")


def start(rows: DataFrame, bits: int, trees: int, seed: int) -> DataFrame:
    """Lists from trees; a leaf with too many nodes is cut into random parts of ``LEAF``."""
    placed = save(codes(rows, bits, trees, seed), "leaves")
    crowd = save(placed.groupBy("leaf").agg(F.count("*").alias("n")), "crowds")
    lists = save(shortest(_near(_parts(placed, crowd, "leaf", LEAF, seed), rows)), "lists")
    drop(placed)
    drop(crowd)
    return lists


def _parts(placed: DataFrame, crowd: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """``part, node``: the nodes of each key in random parts of about ``most``."""
    part = F.pmod(F.xxhash64("node", key, F.lit(seed)), F.ceil(F.col("n") / most).cast("int"))
    return placed.join(crowd, key).select(F.xxhash64(key, part).alias("part"), "node")


def _near(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """Nearest of each node among the nodes of its parts."""
    grouped = parts.join(rows, "node").select("part", "node", "v").repartition("part").sortWithinPartitions("part", "node")
    return grouped.mapInArrow(lambda source: _best(source, "part"), PROPOSED)


def descend(rows: DataFrame, lists: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """One round: at each node, the nodes it lists and those that list it meet. A node that very
    many list lets them meet in random groups of ``MEET``. Returns the lists and how many places
    are new."""
    listed = lists.select(F.col("node").alias("at"), F.col("near").alias("node")).unionByName(
        lists.select(F.col("near").alias("at"), "node")).unionByName(
        lists.select(F.col("node").alias("at"), "node")).distinct()
    crowd = save(listed.groupBy("at").agg(F.count("*").alias("n")), "crowds")
    better = shortest(_near(_parts(listed, crowd, "at", MEET, seed), rows).unionByName(lists))
    found = save(better, "lists")
    new = found.join(lists.select("node", "near"), ["node", "near"], "left_anti").count()
    drop(crowd)
    return found, new


def enlarge(classes: DataFrame, grouped: DataFrame) -> DataFrame:
    """``node, links, root`` of components ``node, component``: how many vectors link with a node in
    one comparison of two blocks, and the smallest node that it reaches by links there."""
    sized = save(grouped.groupBy("component").agg(F.count("*").alias("n")), "component-sizes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = grouped.join(sized, "component").select(
        "node", "component", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = placed.withColumn("cell", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"))).join(
        classes.select("node", "size", "v"), "node").select("cell", "block", "other", "node", "size", "v")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(source, "cell"):
            block, other = table["block"].to_numpy(), table["other"].to_numpy()
            low, high = np.minimum(block, other)[0], np.maximum(block, other)[0]
            x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
            v, size, ids = _matrix(table["v"], np.float64), table["size"].to_numpy(), table["node"].to_numpy()
            alike = v[x] @ v[y].T >= SIMILARITY
            if low == high:
                np.fill_diagonal(alike, False)
            links = np.zeros(len(ids), np.int64)
            for a, b, near in ((x, y, alike), (y, x, alike.T))[:1 if low == high else 2]:
                links[a] += near @ size[b]
            live = links > 0
            yield batches({"node": ids[live], "links": links[live], "root": _roots(ids, x, y, alike)[live]})

    counted = cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, "node long, links long, root long")
    out = save(counted, "enlarged")
    drop(sized)
    return out


def bridged(classes: DataFrame, near: DataFrame, grouped: DataFrame) -> DataFrame:
    """``node, component`` after components that link between saturated nodes have become one.

    A ball holds saturated nodes of one component, about ``BLOCK`` at most, within an angle of their
    mean. Two balls can only hold a link if their means are no further apart than both angles and
    that of the threshold, so no link is lost by comparing only such balls.
    """
    full = near.groupBy("node").agg(F.count("*").alias("places")).where(F.col("places") >= PLACES).select("node")
    held = save(full.join(grouped, "node"), "saturated")
    sized = held.groupBy("component").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK).cast("int"))
    balled = save(held.join(sized, "component").join(classes.select("node", "v"), "node").select(
        F.xxhash64("component", F.length("v"), part).alias("ball"), "component", "node", "v"), "balls")
    centred = balled.repartition("ball").sortWithinPartitions("ball", "node").mapInArrow(
        _centres, "ball long, component long, width int, radius double, v binary")
    centres = save(centred, "centres")
    most = centres.groupBy("width").agg(F.ceil(F.count("*") / BALLS).cast("int").alias("blocks"))
    placed = centres.join(most, "width").select(
        "ball", "component", "width", "radius", "v", F.pmod(F.xxhash64("ball"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = placed.withColumn("cell", F.xxhash64("width", F.least("block", "other"), F.greatest("block", "other"))).drop("width")
    pairs = save(cells.repartition("cell").sortWithinPartitions("cell", "ball").mapInArrow(
        _close, "cell long, a long, b long"), "close-balls")
    sides = pairs.select("cell", F.explode(F.array("a", "b")).alias("ball")).join(balled, "ball")
    between = save(sides.repartition("cell").sortWithinPartitions("cell", "component").mapInArrow(
        _joined, "a long, b long").distinct(), "bridges")
    for table in (held, balled, centres, pairs):
        drop(table)
    if not between.limit(1).count():
        return grouped
    whole = components(between).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return grouped.join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def _angle(cosine: np.ndarray | float) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _centres(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each ball and the largest angle from it."""
    for table in by_group(rows, "ball"):
        v = _matrix(table["v"], np.float64)
        mean = v.sum(axis=0)
        norm = np.linalg.norm(mean)
        mean = mean / norm if norm > 0 else v[0]
        yield batches({
            "ball": table["ball"].slice(0, 1).combine_chunks(), "component": table["component"].slice(0, 1).combine_chunks(),
            "width": pa.array([v.shape[1]], pa.int32()), "radius": np.array([_angle(v @ mean).max()]),
            "v": pa.array([mean.tobytes()], pa.binary())})


def _close(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Balls of different components that are near enough for a link, each two under a key."""
    for table in by_group(rows, "cell"):
        block, other = table["block"].to_numpy(), table["other"].to_numpy()
        low, high = np.minimum(block, other)[0], np.maximum(block, other)[0]
        x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
        v, radius = _matrix(table["v"], np.float64), table["radius"].to_numpy()
        ball, component = table["ball"].to_numpy(), table["component"].to_numpy()
        near = _angle(v[x] @ v[y].T) <= radius[x, None] + radius[None, y] + _angle(SIMILARITY) + LOOSE
        near &= component[x, None] != component[None, y]
        i, j = np.nonzero(np.triu(near, 1) if low == high else near)
        a, b = ball[x[i]], ball[y[j]]
        yield batches({"cell": _key(a, b), "a": a, "b": b})


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.minimum(a, b).view(np.uint64), np.maximum(a, b).view(np.uint64)
    return mix(mix(low) ^ high).view(np.int64)


def _joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of two balls that a link is found between."""
    for table in by_group(rows, "cell"):
        component, v = table["component"].to_numpy(), _matrix(table["v"], np.float64)
        first = component == component[0]
        if (v[first] @ v[~first].T >= SIMILARITY).any():
            yield batches({"a": component[:1], "b": component[-1:]})


def _roots(ids: np.ndarray, x: np.ndarray, y: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Smallest node reachable by links between the rows ``x`` and ``y`` of a cell."""
    label = ids.copy()
    if not len(x) or not len(y):
        return label
    while True:
        before = label.copy()
        for a, b, near in ((x, y, alike), (y, x, alike.T)):
            label[a] = np.minimum(label[a], np.where(near, label[b], np.iinfo(np.int64).max).min(axis=1))
        if (label == before).all():
            return label


def audit(rows: DataFrame, grouped: DataFrame, seed: int, near: DataFrame | None = None) -> float | None:
    """Share of the sampled nodes with links whose links all lie within the components: the lowest one of
    nodes in components above ``LEAF``, which are hot, of other nodes that a link has been found of, and of all others.

    The sample of the others grows until ``LINKED`` of them have links or ``WIDEST`` are compared. None if no
    sampled node has a link: then nothing has been measured.
    """
    sizes = grouped.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > LEAF).select("component")
    hot = save(grouped.join(sizes, "component").select("node"), "hot-nodes")
    shares = [r / n for r, n in [_audited(rows.join(hot, "node", "left_semi"), rows, grouped, AUDIT, seed)] if n]
    rest = save(rows.join(hot, "node", "left_anti"), "other-nodes")
    if near is not None:
        found = near.select("node").distinct()
        shares += [r / n for r, n in [_audited(rest.join(found, "node", "left_semi"), rows, grouped, AUDIT, seed)] if n]
    most, count = AUDIT, rest.count()
    while True:
        right, linked = _audited(rest, rows, grouped, most, seed)
        if linked >= LINKED or most >= min(count, WIDEST):
            break
        most *= 4
    drop(hot)
    drop(rest)
    return min([*shares, *([right / linked] if linked else [])], default=None)


def _audited(asked: DataFrame, rows: DataFrame, grouped: DataFrame, most: int, seed: int) -> tuple[int, int]:
    """How many of up to ``most`` sampled nodes have links and all of them within the components, and
    how many have links."""
    sample = asked.select("node", "v").orderBy(F.xxhash64("node", F.lit(seed))).limit(most).collect()
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {len(r.v) for r in sample}:
        own = [r for r in sample if len(r.v) == width]
        by_width[width] = (np.array([r.node for r in own]), np.frombuffer(b"".join(bytes(r.v) for r in own), np.float32).reshape(len(own), -1))
    if not sample:
        return 0, 0

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, values = batch.column("node").to_numpy(), batch.column("v").to_pylist()
            for width, (asked, q) in by_width.items():
                index = np.array([i for i, v in enumerate(values) if len(v) == width])
                for part in np.array_split(index, len(index) // STRIPE + 1):
                    if len(part):
                        v = np.frombuffer(b"".join(values[i] for i in part), np.float32).reshape(len(part), -1)
                        i, j = np.nonzero(q @ v.T >= SIMILARITY)
                        other = ids[part[j]]
                        real = asked[i] != other
                        yield batches({"node": asked[i][real], "near": other[real]})

    true = save(rows.select("node", "v").mapInArrow(run, "node long, near long"), "true-links")
    found = true.join(grouped, "node", "left").join(grouped.select(
        F.col("node").alias("near"), F.col("component").alias("c")), "near", "left")
    whole = found.groupBy("node").agg(F.min(F.coalesce(F.col("component") == F.col("c"), F.lit(False))).alias("whole"))
    right, linked = whole.agg(F.count_if("whole"), F.count("*")).first()
    drop(true)
    return right, linked


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id`` of every vector that can link."""
    units = save(unit_vectors(vectors), "units")
    classes = save(units.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("size")), "vector-classes")
    rows, count, lists = save(_single(classes), "nodes"), classes.count(), None
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / LEAF))))
    trees, attempt = trees_needed(bits), 0
    while True:
        fresh = start(rows, bits, trees, attempt)
        lists = fresh if lists is None else save(shortest(lists.unionByName(fresh)), "lists")
        for turn in range(ROUNDS):
            lists, new = descend(rows, lists, 100 * attempt + turn)
            if new <= CHANGED * PLACES * count:
                break
        near = lists.where(F.col("s") >= SIMILARITY - LOOSE)
        grouped = bridged(classes, near, components(near.select(F.col("node").alias("a"), F.col("near").alias("b"))))
        recall = audit(rows, grouped, attempt, near)
        if recall is None and attempt:
            # twice nothing was found by either search, and none of WIDEST nodes compared with all rows has a link
            warnings.warn(f"near duplicates: recall not measured, no link among {min(count, WIDEST)} sampled nodes", stacklevel=2)
            break
        if recall is not None and recall >= RECALL:
            break
        trees, attempt = 2 * trees, attempt + 1
        if trees * LEAF >= count:
            grouped = classes.select("node", F.length("v").cast("bigint").alias("component")).distinct()
            break
    exact = enlarge(classes, grouped)
    labels = components(exact.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    totals = save(classes.join(links, "node", "left").join(labels, "node", "left").select(
        "v", F.coalesce("component", "node").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "vector-links")
    return units.join(totals, "v").select("vec_id", "n_links", "component_id")


def op5_neardup(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return all_rows(vectors)


def all_rows(vectors: DataFrame) -> DataFrame:
    linked = near_duplicates(vectors).groupBy("vec_id").agg(
        F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return vectors.select("vec_id").distinct().join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b
          WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v
          UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id"""
