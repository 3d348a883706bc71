"""Conversation prefix trie by collapsing whole sequences.

Conversations are rebuilt from the first turns of another one and their own later turns. Identical
rebuilt conversations are one weighted sequence: it keeps the smallest conversation as its head, the
number of its members and the digest of their list. Only heads go on. Sequences that are proper
prefixes of others are dropped by an anti-join from those that end in leaves, and the prefixes of all
sequences are added up with their weights to the nodes of the trie.

A prefix is named by its depth and by two 64-bit hashes, each the exclusive or of its turns hashed with their
positions, so that hashes of all prefixes are a running total, however long a conversation is. Turns
are equal if role and text have equal 128-bit digests.

Tokens saved are sums over subtrees. Each node belongs to the leaf with the smallest head below it, so
the nodes of a leaf are the last stretch of its path. A subtree then holds the whole stretches
of all leaves below it but for the part of its own leaf's stretch that lies above: one running total
by leaf and depth, and one sum over the paths of leaves, linear in the turns.

Turns are ordered by number, null first, then by the digest of role and text; a null role or text counts as
empty. Rows with a null conv_id belong to no conversation and are left out. Repeated rows are
turns of their own. Other columns are ignored. Without conversations there is no root: the result is
empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.prefix import attach, scan
from quire.llm.shared import read_table, save

SHARED, GROUP = 6, 100
NODE = ["depth", "a", "b"]
# Members named in one chunk of a list.
CHUNK = 20_000


def heads_taken():
    """Turns that a conversation takes from the first one of its hundred."""
    return F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("bigint")


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, mark, size, before_one, _part``: the turns with their place in the conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("mark"),
        F.length(text).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("one"))
    return save(scan(save(turns, "turns"), ["conv_id"], [F.asc_nulls_first("turn"), F.col("mark")], {"one": "sum"}, "turn-order").select(
        "conv_id", "mark", "size", "_part", F.col("before_one").alias("at")), "turn-places")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, mark, size, _part`` of rebuilt conversations, and ``conv_id`` of all of them."""
    convs = save(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", heads_taken()).withColumn(
        "donor", F.col("conv_id") - F.col("conv_id") % GROUP), "conversations")
    lent = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("donor"), F.col("n").alias("lent"))
    taken = save(convs.join(lent, "donor", "left").withColumn("got", F.least("h", F.coalesce("lent", F.lit(0)))).select(
        "conv_id", "donor", "h", "got"), "conversation-heads")
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("at") < SHARED - 1)).select(
        F.col("conv_id").alias("donor"), "at", "mark", "size")  # a few turns of one in a hundred
    given = taken.where("got > 0").join(first, "donor").where("at < got").select(
        "conv_id", F.col("at").alias("pos"), "mark", "size", F.lit(-1).alias("_part"))
    later = turns.withColumn("h", heads_taken()).where("at >= h").drop("h")
    own = attach(later, taken.select("conv_id", "h", "got"), ["conv_id"]).select(
        "conv_id", (F.col("at") - F.col("h") + F.col("got")).alias("pos"), "mark", "size", "_part")
    return save(given.unionByName(own).withColumns({
        "x": F.xxhash64("mark", "pos"), "y": F.xxhash64("pos", F.lit("y"), "mark")}), "rebuilt"), convs


def collapsed(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted sequences ``depth, a, b, head, members``, and each conversation's sequence."""
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("depth"), F.bit_xor("x").alias("a"), F.bit_xor("y").alias("b"))
    none = F.lit(0).cast("bigint")
    named = save(convs.select("conv_id").join(whole, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, none).alias(c) for c in NODE]), "conversation-sequences")
    sequences = named.groupBy(*NODE).agg(F.min("conv_id").alias("head"), F.count("*").alias("members"))
    return save(sequences, "sequences"), named


def member_lists(named: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256``: digest of the members of each sequence, ascending, joined by commas.

    Members are range-sorted; each range joins stretches of a list to chunks, and the chunks of a list are streamed
    into one digest, so even a list of a third of all conversations is a few rows for its task.
    """
    shape = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []
        for batch in batches:
            for *own, conv in zip(*[batch.column(c).to_pylist() for c in (*NODE, "conv_id")]):
                if own != key or len(ids) >= CHUNK:
                    if ids:
                        rows.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = own, []
                ids.append(conv)
            if len(rows) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)
                rows = []
        if ids:
            rows.append((*key, ids[0], ",".join(map(str, ids))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        names = [*NODE, "ends_sha256"]
        for batch in batches:
            for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if own == key:
                    sha.update(b",")
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = own, hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
                done = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*key, sha.hexdigest())])], names=names)

    by = [*NODE, "conv_id"]
    listed = named.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        chunks, "depth long, a long, b long, first long, ids string")
    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        digest, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node with its counts, its parent and the digest of the conversations that end there."""
    zero = F.lit(0).cast("bigint")
    rows, convs = rebuilt(numbered(conversations))
    sequences, named = collapsed(rows, convs)
    # only heads of sequences go on; each stands for all its members
    heads = sequences.select(F.col("head").alias("conv_id"), F.col("depth").alias("last"), "members")
    kept = attach(rows, heads, ["conv_id"])
    hashed = scan(kept.select("conv_id", "pos", "size", "x", "y", "last", "members"), ["conv_id"], ["pos"], {"x": "xor", "y": "xor"}, "prefix-hashes")
    below = hashed.select(
        F.col("conv_id").alias("head"), "last", "members", "size", "_part", (F.col("pos") + 1).alias("depth"),
        F.col("before_x").bitwiseXOR(F.col("x")).alias("a"), F.col("before_y").bitwiseXOR(F.col("y")).alias("b"),
        F.col("before_x").alias("pa"), F.col("before_y").alias("pb"))
    roots = sequences.select("head", F.col("depth").alias("last"), "members", zero.alias("size"), F.lit(-1).alias("_part"), zero.alias("depth"),
                             zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"))
    paths = save(below.unionByName(roots), "paths")
    proper = paths.where("depth < last").select(*NODE).distinct()
    leaves = save(sequences.join(proper, NODE, "left_anti").select("head", F.lit(True).alias("leaf")), "leaves")
    marked = save(attach(paths, leaves, ["head"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(False))), "marked-paths")
    nodes = save(marked.groupBy(*NODE).agg(
        F.sum("members").alias("n_convs"), F.min("head").alias("conv_id"), F.count_if("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("head"))).alias("owner"), F.max("size").alias("size"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
    ).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), "nodes")

    # subtree sums: whole stretches of the leaves below, less what the own leaf has above
    stretches = save(nodes.groupBy("owner").agg(F.sum("saved").alias("stretch")).withColumnRenamed("owner", "head"), "stretches")
    under = attach(marked.where("leaf").select("head", "_part", *NODE), stretches, ["head"]).groupBy(*NODE).agg(F.sum("stretch").alias("under"))
    above = scan(nodes, ["owner"], ["depth"], {"saved": "sum"}, "owned-nodes")

    # children of one node may be very many: the parent is met once per range of its children
    child = F.struct(*[F.when(F.col("depth") > 0, c).alias(n) for n, c in (
        ("up", F.col("depth") - 1), ("pa", F.col("pa")), ("pb", F.col("pb")))])
    linked = above.withColumn("u", child).select("*", "u.up").drop("u")
    parents = nodes.select(F.col("depth").alias("up"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    with_parent = attach(linked, parents, ["up", "pa", "pb"], "left")
    children = linked.where("up is not null").groupBy("up", "pa", "pb").agg(F.count("*").alias("n_children")).select(
        F.col("up").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children")
    empty = hashlib.sha256(b"").hexdigest()
    return with_parent.join(children, NODE, "left").join(under, NODE).join(member_lists(named), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("under") - F.col("before_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie(read_table(spark, folder, "conversations"))


_CRC = ("xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), "
        "lambda c, s: list_reduce([xor(c, s), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")
OP13_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 6 AS h, conv_id - conv_id % 100 AS donor FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS side, t.place, role, text FROM c JOIN t ON t.conv_id = c.donor AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, t.place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS size,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY side, place ROWS UNBOUNDED PRECEDING)),
q AS (SELECT conv_id, depth, size, md5(path) AS k, coalesce(lag(md5(path)) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS pk FROM p
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c),
f AS (SELECT conv_id, max(depth) AS last, arg_max(k, depth) AS full_key FROM q GROUP BY conv_id),
e AS (SELECT full_key AS k, last AS depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM f GROUP BY ALL),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, any_value(pk) AS pk FROM q GROUP BY depth, k),
ch AS (SELECT pk AS k, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
g AS (SELECT n.*, coalesce(ch.n, 0) AS n_children FROM n LEFT JOIN ch ON ch.k = n.k AND ch.depth = n.depth),
s AS (SELECT v.depth, v.k, sum((u.n_convs - 1) * u.size) AS saved, count(*) FILTER (WHERE u.n_children = 0) AS leaves
  FROM g u JOIN q v ON v.conv_id = u.conv_id AND v.depth <= u.depth GROUP BY ALL)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, par.conv_id AS parent_conv_id, g.n_convs, CAST(g.n_children AS BIGINT) AS n_children,
       s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM g JOIN s ON s.k = g.k AND s.depth = g.depth LEFT JOIN g par ON par.k = g.pk AND par.depth = g.depth - 1
LEFT JOIN e ON e.k = g.k AND e.depth = g.depth"""
