"""Jaccard join of documents on five-word shingles, by chosen paths.

A document is the set of its shingles' hashes. A run splits all sets on one sampled token of each:
the one that the run's hash function ranks lowest. Two sets share it with a probability equal to
their similarity. A bucket above ``LIMIT`` is split again, on two further tokens of its sets, which
each run samples anew for each level, and so on down its path, unless most of its sets share a
further token: such a dense bucket would only be copied by a split. Runs repeat until the target
recall is reached.

Small buckets are compared by brute force, larger ones block against block, so no task gets more
than two blocks. Sketches sieve the pairs; classes with a likely partner are then compared on their
full sets. Documents with equal sets form one class and enter as one. A pair that shares several
buckets is counted in the first of them only, which both sides can tell from their lists of
buckets; no pair is ever written down: a comparison yields, for each class, a count of links and
the smallest class it leads to.

A text of one to four words is one shingle of all its words; a null or empty text has no shingle
and links with nothing. Rows that repeat a doc_id count once if their texts are equal; else their
links add up. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.graph import components
from quire.llm.shared import batches, by_group, drop, grams, mix, pieces, read_table, save, text_bytes, word_bounds, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
# Target recall of a pair at the threshold, and the least share of pairs lost on a path's way down
# that the number of runs allows for.
RECALL, PATH_LOSS = 0.9999, 0.1
# Sets in a bucket that is not split further; further tokens, two for each level.
LIMIT, DEEPER = 2048, 8
# A bucket is dense when this share of its sets has one further token in common.
DENSE = 0.4
# Bytes of a sketch, one for each hash function, and how far below the threshold a sketch may lie:
# over four standard deviations of 64 samples.
SKETCH, SLACK = 64, 0.22
# Sets in a block.
BLOCK = 512
EMPTY = np.uint64(2**64 - 1)


def runs_needed(similarity: float, recall: float) -> int:
    """Runs that miss a pair independently: by the first token, or by both further tokens of a level."""
    loss = max(PATH_LOSS, 1 - (1 - (1 - similarity) ** 2) ** (DEEPER // 2))
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity * (1 - loss))))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, at = text_bytes(column)
    starts, ends, first = word_bounds(data, at)
    words, found = word_hashes(data, starts, ends), []
    for a, b in zip(first[:-1], first[1:]):
        own = words[a:b]
        found.append(np.unique(grams(own, min(SHINGLE, len(own)))) if b > a else np.zeros(0, np.uint64))
    return found


def _multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1 + seed, n + 1 + seed, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def lowest(tokens: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The lowest rank that each hash function gives to one of the tokens."""
    found = np.full(len(multipliers), EMPTY)
    for a in range(0, len(tokens), 1 << 14):
        ranks = tokens[a:a + (1 << 14), None] * multipliers
        found = np.minimum(found, (ranks ^ (ranks >> np.uint64(32))).min(axis=0))
    return found


def profiles(docs: DataFrame, runs: int) -> DataFrame:
    """``doc_id, set_id, tokens, sketch``: a hash of the whole set, the sampled token of each run,
    then ``DEEPER`` further ones of each run, and one byte of each of ``SKETCH`` other samples. Texts
    without shingles are left out."""
    choose, sketch = _multipliers(runs * (1 + DEEPER), 0), _multipliers(SKETCH, 1_000_000)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in pieces(whole):
                sets = shingle_sets(batch.column("text"))
                live = [i for i, s in enumerate(sets) if len(s)]
                yield batches({
                    "doc_id": batch.column("doc_id").take(pa.array(live, pa.int64())),
                    "set_id": pa.array([_set_id(sets[i]) for i in live], pa.binary()),
                    "tokens": pa.array([lowest(sets[i], choose).tobytes() for i in live], pa.binary()),
                    "sketch": pa.array([lowest(sets[i], sketch).astype(np.uint8).tobytes() for i in live], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_id binary, tokens binary, sketch binary")


def _set_id(tokens: np.ndarray) -> bytes:
    """A 128-bit hash of a set: two sums over its tokens, and its size within one of them."""
    sums = np.array([mix(tokens).sum(), mix(tokens * np.uint64(0x9E3779B97F4A7C15)).sum()], np.uint64)
    return (sums + np.array([len(tokens), 1], np.uint64)).tobytes()


def leaves(classes: DataFrame, runs: int, limit: int = LIMIT) -> DataFrame:
    """``class_id, bucket, n``: the buckets, of n sets, in which each class ends. Buckets of one
    class are left out."""
    tokens = lambda i, n=1: F.substring("tokens", 8 * i + 1, 8 * n)
    # each run goes down on tokens of its own, so that runs lose a pair independently of one another
    live = classes.select("class_id", F.explode(F.array(*[F.struct(
        F.xxhash64(F.lit(i), tokens(i)).alias("bucket"), tokens(runs + DEEPER * i, DEEPER).alias("further"))
        for i in range(runs)])).alias("run")).select("class_id", "run.bucket", *[
            F.substring("run.further", 8 * i + 1, 8).alias(f"t{i}") for i in range(DEEPER)])
    done, made = None, []
    for level in range(0, DEEPER + 1, 2):
        keys = ["class_id", "bucket", *[f"t{i}" for i in range(level, DEEPER)]]
        sizes = live.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        if level < DEEPER:
            # the most common further token of large buckets, counted before anything is gathered
            common = live.groupBy("bucket", f"t{level}").agg(F.count("*").alias("m")).groupBy("bucket").agg(
                F.max("m").alias("m"), F.sum("m").alias("n"))
            sizes = common.where("n > 1").select(
                "bucket", "n", ((F.col("n") > limit) & (F.col("m") < DENSE * F.col("n"))).alias("split"))
        else:
            sizes = sizes.withColumn("split", F.lit(False))
        sized = save(sizes, "buckets")
        joined = save(live.select(keys).join(sized, "bucket"), "bucket-rows")
        made += [sized, joined]
        ended = joined.where("not split").select("class_id", "bucket", "n")
        done = ended if done is None else done.unionByName(ended)
        if level == DEEPER or not sized.where("split").limit(1).count():
            break
        live = joined.where("split").select("class_id", *[f"t{i}" for i in range(level + 2, DEEPER)], F.explode(F.array(*[
            F.xxhash64("bucket", F.lit(i), F.col(f"t{i}")) for i in (level, level + 1)])).alias("bucket"))
    out = save(done, "leaves")
    for table in made:
        drop(table)
    return out


def cells(found: DataFrame, classes: DataFrame) -> DataFrame:
    """``cell, block, other, bucket, buckets, class_id, size, sketch``: each set once for every
    pair of blocks of its bucket that its own block is part of."""
    listed = found.groupBy("class_id").agg(F.collect_list(F.struct("bucket", "n")).alias("leaves"))
    rows = classes.select("class_id", "size", "sketch").join(listed, "class_id").select(
        "class_id", "size", "sketch", F.array_sort(F.transform("leaves", lambda x: x["bucket"])).alias("buckets"),
        F.explode("leaves").alias("leaf"))
    blocks = F.ceil(F.col("leaf.n") / BLOCK).cast("int")
    placed = rows.select(
        "class_id", "size", "sketch", "buckets", F.col("leaf.bucket").alias("bucket"),
        F.pmod(F.xxhash64("class_id", "leaf.bucket"), blocks).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return placed.withColumn("cell", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the cell's lower and upper block; the same rows in a cell of one block."""
    block, other = table["block"].to_numpy(), table["other"].to_numpy()
    low = np.minimum(block, other).min()
    return np.flatnonzero(block == low), np.flatnonzero(block == np.maximum(block, other).max())


def _pairs(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides of a cell and their likely pairs that share no bucket before this one."""
    x, y = _sides(table)
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, SKETCH)
    pairs = _likely(sketch[x], sketch[y], least)
    if len(x) == len(y) and (x == y).all():
        pairs = np.triu(pairs, 1)
    if pairs.any():
        lists = table["buckets"].combine_chunks()
        bucket, flat = table["bucket"][0].as_py(), lists.flatten().to_numpy()
        row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
        row, flat = row[flat < bucket], flat[flat < bucket]
        shared, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        inside = np.zeros((table.num_rows, len(shared)), np.float32)
        inside[row, column] = 1
        inside = inside[:, count > 1]
        pairs &= inside[x] @ inside[y].T == 0
    return x, y, pairs


def _likely(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    same = np.zeros((len(x), len(y)), np.int16)
    for i in range(SKETCH):
        same += x[:, i, None] == y[None, :, i]
    return same >= least


def candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """``cell, class_id`` of classes with a likely partner in their cell."""
    least = int(np.floor(SKETCH * (similarity - SLACK)))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(source, "cell"):
            if table.num_rows < 2:
                continue
            x, y, pairs = _pairs(table, least)
            live = np.union1d(x[pairs.any(axis=1)], y[pairs.any(axis=0)])
            if len(live):
                kept = table.select(COLUMNS).take(pa.array(live)).combine_chunks()
                yield from kept.to_batches()

    return _grouped(rows.select(COLUMNS)).mapInArrow(run, SHAPE)


COLUMNS = ["cell", "block", "other", "bucket", "buckets", "class_id", "size", "sketch"]
SHAPE = "cell long, block int, other int, bucket long, buckets array<long>, class_id long, size long, sketch binary"


def verified(rows: DataFrame, similarity: float) -> DataFrame:
    """``class_id, links, root``: for each class of a cell, how many documents of other classes are
    similar to it and first met here, and the smallest class that the cell's links lead to."""
    least = int(np.floor(SKETCH * (similarity - SLACK)))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(source, "cell"):
            if table.num_rows < 2:
                continue
            x, y, pairs = _pairs(table, least)
            i, j = np.nonzero(pairs)
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["full"]]
            i, j = x[i], y[j]
            common = _common(sets, i, j)
            both = np.array([len(s) for s in sets])
            alike = common * (1 + similarity) >= similarity * (both[i] + both[j]) - 1e-9
            i, j, ids, size = i[alike], j[alike], table["class_id"].to_numpy(), table["size"].to_numpy()
            links = np.bincount(i, size[j], len(ids)) + np.bincount(j, size[i], len(ids))
            live = np.flatnonzero(links)
            if len(live):
                yield batches({"class_id": ids[live], "links": links[live].astype(np.int64),
                               "root": _roots(ids, i, j)[live]})

    return _grouped(rows).mapInArrow(run, "class_id long, links long, root long")


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tokens that the sets of each pair (i, j) have in common, exactly.

    Few pairs are merged one by one. Many pairs of few sets are counted as a product of 0/1
    matrices, a stretch of their tokens at a time.
    """
    rows = np.union1d(i, j)
    if len(i) <= 16 * len(rows):
        return np.array([np.isin(sets[a], sets[b], assume_unique=True).sum() for a, b in zip(i, j)], np.int64)
    vocabulary = np.unique(np.concatenate([sets[r] for r in rows]))
    places = [np.searchsorted(vocabulary, sets[r]) for r in rows]
    both, step = np.zeros((len(rows), len(rows)), np.float32), 4096
    for start in range(0, len(vocabulary), step):
        ones = np.zeros((len(rows), step), np.float32)
        for k, p in enumerate(places):
            a, b = np.searchsorted(p, (start, start + step))
            ones[k, p[a:b] - start] = 1
        both += ones @ ones.T
    return both[np.searchsorted(rows, i), np.searchsorted(rows, j)].astype(np.int64)


def _roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest class reachable within the cell."""
    label = ids.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            return label


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, limit: int = LIMIT) -> DataFrame:
    """One row per document with shingles: ``doc_id, set_class, class_id, n_links``.

    ``set_class`` is the smallest id with an equal set, ``class_id`` the smallest id reachable by
    links, ``n_links`` how many other documents are similar, equal ones included.
    """
    runs = runs_needed(similarity, recall)
    found = save(profiles(docs, runs), "profiles")
    classes = save(found.groupBy("set_id").agg(
        F.min("doc_id").alias("class_id"), F.countDistinct("doc_id").alias("size"),
        F.any_value("tokens").alias("tokens"), F.any_value("sketch").alias("sketch")), "set-classes")
    ended = leaves(classes, runs, limit)
    likely = save(candidates(cells(ended, classes), similarity), "likely")
    # full sets of the classes that need them, from the text of the class's first document
    wanted = likely.select("class_id").distinct()
    # ids grow with the corpus: the same shuffled join at every size
    texts = docs.select("doc_id", "text").join(
        wanted.hint("merge"), docs["doc_id"] == wanted["class_id"]).select("class_id", "text")
    full = save(_full_sets(texts.dropDuplicates(["class_id"])), "full-sets")
    checked = save(verified(likely.join(full, "class_id").select(*COLUMNS, "full"), similarity), "verified")
    links = checked.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    linked = save(links.join(roots.withColumnRenamed("node", "class_id"), "class_id"), "linked-classes")
    totals = save(classes.select("set_id", "class_id", "size").join(linked, "class_id", "left").select(
        "set_id", F.col("class_id").alias("set_class"), F.coalesce("component", "class_id").alias("class_id"),
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "class-links")
    result = save(found.select("doc_id", "set_id").join(totals, "set_id").select(
        "doc_id", "set_class", "class_id", "n_links"), "document-links")
    for table in (found, classes, ended, likely, full, checked, linked, totals):
        drop(table)
    return result


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows of a cell next to each other in one partition."""
    return rows.repartition("cell").sortWithinPartitions("cell", "class_id")


def _full_sets(texts: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in pieces(whole):
                yield batches({"class_id": batch.column("class_id"), "full": pa.array(
                    [s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())})

    return texts.mapInArrow(run, "class_id long, full binary")


def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document; those without words are classes of their own."""
    docs = read_table(spark, folder, "documents")
    return all_rows(docs)


def all_rows(docs: DataFrame) -> DataFrame:
    linked = join(docs)
    return docs.select("doc_id").distinct().join(linked.groupBy("doc_id").agg(
        F.min("set_class").alias("set_class"), F.min("class_id").alias("class_id"),
        F.sum("n_links").alias("n_links")), "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("set_class", "doc_id").alias("set_class"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The smallest document of each group of similar ones; columns as they came."""
    removed = save(join(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), "near-copies")
    return docs.join(removed.hint("merge"), docs["doc_id"] == removed["_id"], "left_anti")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(ws) - least(5, len(ws)) + 2),
        lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) AS sh FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS key FROM s),
t AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS set_class FROM n)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(set_class, d.doc_id) AS set_class
FROM documents d JOIN g ON g.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id"""
