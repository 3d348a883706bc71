"""Identity, reconciliation and sequence queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import identity, reconcile
from quire.plans.base import Query, table


def distinct_bodies(spark, folder):
    return identity.bodies(table(spark, folder, "documents"), "doc_id", "text")


BODIES_SQL = """SELECT sha256(text) AS sha256, CAST(strlen(text) AS INTEGER) AS size, min(doc_id) AS first_key, count(*) AS occurrences
FROM documents GROUP BY text"""


def body_occurrences(spark, folder):
    """Every document with the first one that has its bytes: attribution is kept."""
    docs = identity.fingerprint(table(spark, folder, "documents").select("doc_id", "source", "text"), "text").drop("text")
    first = docs.groupBy("sha256").agg(F.min("doc_id").alias("body_of"))
    return docs.join(first, "sha256").select("doc_id", "source", "body_of")


OCCURRENCES_SQL = "SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS body_of FROM documents"


def hash_collisions(spark, folder):
    return identity.collisions(table(spark, folder, "documents"), "text")


COLLISIONS_SQL = "SELECT sha256(text) AS sha256, count(*) AS rows, count(DISTINCT text) > 1 AS collides FROM documents GROUP BY sha256(text)"


def checksum_manifest(spark, folder):
    docs = identity.fingerprint(table(spark, folder, "documents"), "text")
    return docs.select(F.concat("sha256", F.lit("  doc-"), F.col("doc_id").cast("string")).alias("entry"))


MANIFEST_SQL = "SELECT sha256(text) || '  doc-' || doc_id AS entry FROM documents"


def snapshot_changes(spark, folder):
    """The orders' state at two moments: shipped lines before 1996 against all."""
    items = table(spark, folder, "lineitem").withColumn("state", F.concat("l_returnflag", "l_linestatus"))
    early = items.where("l_shipdate < timestamp '1996-01-01'").groupBy("l_orderkey").agg(F.max("state").alias("state"))
    late = items.where("l_shipdate >= timestamp '1994-01-01'").groupBy("l_orderkey").agg(F.max("state").alias("state"))
    return identity.snapshot_diff(early, late, "l_orderkey", "state")


CHANGES_SQL = """
WITH a AS (SELECT l_orderkey, max(l_returnflag || l_linestatus) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1),
b AS (SELECT l_orderkey, max(l_returnflag || l_linestatus) AS s FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' GROUP BY 1)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed'
  WHEN a.s = b.s THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey"""


def merged_revisions(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("state", F.concat("l_returnflag", "l_linestatus"))
    first = items.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.max("state").alias("state"))
    second = items.where("l_linenumber = 2").groupBy("l_orderkey").agg(F.max("state").alias("state"))
    return identity.merge_revisions(first, second, "l_orderkey", "state")


REVISIONS_SQL = """
WITH a AS (SELECT l_orderkey, max(l_returnflag || l_linestatus) AS s FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
b AS (SELECT l_orderkey, max(l_returnflag || l_linestatus) AS s FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.s, b.s) AS state, coalesce(a.s <> b.s, false) AS conflict
FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey"""


def name_collisions(spark, folder):
    part = table(spark, folder, "part")
    return identity.derived_collisions(part, "p_partkey", F.lower(F.concat_ws("-", "p_brand", "p_type", F.col("p_size").cast("string"))))


NAMES_SQL = """SELECT name, p_partkey, keys FROM (SELECT p_partkey, lower(p_brand || '-' || p_type || '-' || p_size) AS name,
  count(*) OVER (PARTITION BY lower(p_brand || '-' || p_type || '-' || p_size)) AS keys FROM part) WHERE keys > 1"""


def first_line_aliases(spark, folder):
    docs = table(spark, folder, "documents")
    return identity.derived_collisions(docs, "doc_id", F.lower(F.substring_index("text", "\n", 1)))


ALIASES_SQL = """SELECT name, doc_id, keys FROM (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS name,
  count(*) OVER (PARTITION BY lower(split_part(text, chr(10), 1))) AS keys FROM documents) WHERE keys > 1"""


def patched_turns(spark, folder):
    """A correction for every first turn, that expects the text to have no question mark."""
    units = table(spark, folder, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    patches = units.where("turn < 2").select(
        "conv_id", "turn", F.regexp_replace("text", r"\?", "").alias("expected"), F.concat("text", F.lit(" (seen)")).alias("text"))
    return identity.apply_patch(units, patches, ["turn"], "conv_id").select(
        "conv_id", "turn", F.md5("text").alias("md5"), "patched", "refused")


PATCH_SQL = """
WITH u AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL),
r AS (SELECT conv_id, bool_or(contains(text, '?')) AS refused FROM u WHERE turn < 2 GROUP BY conv_id)
SELECT u.conv_id, turn, md5(CASE WHEN turn < 2 AND NOT refused THEN text || ' (seen)' ELSE text END) AS md5,
       turn < 2 AND NOT coalesce(refused, false) AS patched, coalesce(refused, false) AS refused
FROM u LEFT JOIN r ON r.conv_id = u.conv_id"""


def reviewed_documents(spark, folder):
    """Long documents need a review; labels of quality 1 are reviews of the text before its copies."""
    docs = table(spark, folder, "documents")
    assets = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), (F.length("text") > 2000).alias("long"))
    reviews = table(spark, folder, "labels").where("quality = 1").join(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    return identity.review_gate(assets, reviews, "doc_id", F.col("long"))


REVIEWS_SQL = """
SELECT d.doc_id, CASE WHEN length(text) <= 2000 THEN 'clear' WHEN l.doc_id IS NULL THEN 'open' WHEN d.doc_id % 3 = 0 THEN 'stale' ELSE 'reviewed' END AS state
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id"""


def byte_budget(spark, folder):
    docs = table(spark, folder, "documents").select("source", "doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return identity.admit_budget(docs, ["source"], ["doc_id"], "size", 20_000, 4096).groupBy("source").agg(
        F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


BUDGET_SQL = """
WITH t AS (SELECT source, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM documents)
SELECT source, count(*) FILTER (WHERE total <= 20000) AS admitted, count(*) FILTER (WHERE total > 20000) AS refused FROM t GROUP BY source"""


def orders_without_lines(spark, folder):
    return reconcile.missing(table(spark, folder, "orders").select(F.col("o_orderkey").alias("key")),
                             table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])


MISSING_SQL = "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem"


def part_suppliers(spark, folder):
    items = table(spark, folder, "lineitem")
    return reconcile.set_equal(items.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"),
                               items.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


SETS_SQL = """
(SELECT l_partkey, l_suppkey, 'missing' AS status FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'))
UNION ALL (SELECT l_partkey, l_suppkey, 'unexpected' FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'))"""


def bad_first_lines(spark, folder):
    docs = table(spark, folder, "documents").select(F.substring_index("text", "\n", 1).alias("name"))
    return reconcile.bad_names(docs, "name", 400)


BAD_SQL = """
WITH c AS (SELECT split_part(text, chr(10), 1) AS name, count(*) AS rows FROM documents GROUP BY 1),
f AS (SELECT *, CASE WHEN trim(name) = '' THEN 'blank' WHEN strlen(name) > 400 THEN 'too-long'
  WHEN regexp_matches(name, '[\\x00-\\x1f\\x7f]') THEN 'control' WHEN rows > 1 THEN 'repeated' END AS fault FROM c)
SELECT * FROM f WHERE fault IS NOT NULL"""


def label_coverage(spark, folder):
    return reconcile.coverage(table(spark, folder, "documents"), table(spark, folder, "labels").where("quality = 1").unionByName(
        table(spark, folder, "labels").where("toxic = 1")), "doc_id")


COVERAGE_SQL = """
WITH c AS (SELECT doc_id, count(*) AS claims FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1)
SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, coalesce(claims, 0) AS claims, CASE WHEN d.doc_id IS NULL THEN 'unknown'
  WHEN claims IS NULL THEN 'missing' WHEN claims = 1 THEN 'covered' ELSE 'repeated' END AS status
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN c ON c.doc_id = d.doc_id"""


def mutual_supply(spark, folder):
    """Parts and suppliers by two lists of ids: what lines in the first half of an order say of a part's
    suppliers, against what the later lines say of a supplier's parts. Suppliers in debt aren't known."""
    items = table(spark, folder, "lineitem")
    ab = items.where("l_linenumber <= 3").groupBy("l_partkey").agg(F.collect_list("l_suppkey"))
    ba = items.where("l_linenumber > 3").groupBy("l_suppkey").agg(F.collect_list("l_partkey"))
    return reconcile.relations(ab, ba, "l_partkey", "l_suppkey", table(spark, folder, "part").select("p_partkey"),
                               table(spark, folder, "supplier").where("s_acctbal >= 0").select("s_suppkey"))


MUTUAL_SQL = """
WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
f AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
r AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL)
SELECT p.l_partkey, p.l_suppkey, coalesce(f.n, 0) AS forward, coalesce(r.n, 0) AS backward,
  CASE WHEN p.l_partkey NOT IN (SELECT p_partkey FROM part) OR p.l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) THEN 'dangling'
       WHEN f.n IS NULL OR r.n IS NULL THEN 'one-sided' WHEN f.n > 1 OR r.n > 1 THEN 'repeated' ELSE 'mutual' END AS state
FROM p LEFT JOIN f USING (l_partkey, l_suppkey) LEFT JOIN r USING (l_partkey, l_suppkey)"""


def nation_priority_matrix(spark, folder):
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = orders.select("c_nationkey", "o_orderpriority")
    dims = [table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey")),
            table(spark, folder, "orders").select("o_orderpriority").distinct()]
    return reconcile.scope_matrix(dims, cells, ["c_nationkey", "o_orderpriority"])


MATRIX_SQL = """
WITH r AS (SELECT n_nationkey, p FROM nation, (SELECT DISTINCT o_orderpriority AS p FROM orders)),
c AS (SELECT c_nationkey, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT coalesce(n_nationkey, c_nationkey) AS c_nationkey, coalesce(p, o_orderpriority) AS o_orderpriority, coalesce(n, 0) AS reports,
  CASE WHEN n_nationkey IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'once' ELSE 'repeated' END AS status
FROM r FULL JOIN c ON n_nationkey = c_nationkey AND p = o_orderpriority"""


def supply_matrix(spark, folder):
    """Every nation with a solvent supplier should supply every size of every brand."""
    sold = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).join(
        table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    dims = [table(spark, folder, "supplier").where("s_acctbal >= 0").select("s_nationkey").distinct(),
            table(spark, folder, "part").select("p_brand").distinct(), table(spark, folder, "part").select("p_size").distinct()]
    return reconcile.scope_matrix(dims, sold.select("s_nationkey", "p_brand", "p_size"), ["s_nationkey", "p_brand", "p_size"])


SUPPLY_SQL = """
WITH r AS (SELECT s_nationkey, p_brand, p_size FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal >= 0),
  (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_size FROM part)),
c AS (SELECT s_nationkey, p_brand, p_size, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT s_nationkey, p_brand, p_size, coalesce(n, 0) AS reports,
  CASE WHEN q IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'once' ELSE 'repeated' END AS status
FROM (SELECT *, 1 AS q FROM r) FULL JOIN c USING (s_nationkey, p_brand, p_size)"""


def line_contract(spark, folder):
    """Lines as events of an order: each follows the line before it, shipped earlier, and is not returned."""
    items = table(spark, folder, "lineitem")
    day = F.datediff("l_shipdate", F.lit("1970-01-01"))
    events = items.select(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("id"), F.when(
        F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).alias("parent"), F.col("l_linenumber").alias("sequence"), (F.col("l_returnflag") != "R").alias("passed"))
    shipped = items.select(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("id"), F.when(
        F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).alias("parent"), day.alias("sequence"), F.lit(True).alias("passed"))
    placed = reconcile.event_contract(events).select("scope", "id", F.array_join("faults", ",").alias("faults"))
    # by ship date only the parent's place is judged: days have gaps
    early = reconcile.event_contract(shipped).where(F.array_contains("faults", "early")).select(
        F.col("scope").alias("_s"), F.col("id").alias("_i"), F.lit(True).alias("early"))
    return placed.join(early, (F.col("scope") == F.col("_s")) & (F.col("id") == F.col("_i")), "left").select(
        F.col("scope").alias("l_orderkey"), F.col("id").alias("l_linenumber"), "faults", F.coalesce("early", F.lit(False)).alias("early"))


LINE_CONTRACT_SQL = """
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, bool_and(l_returnflag <> 'R') AS passed,
             min(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS shipped FROM lineitem GROUP BY ALL)
SELECT g.l_orderkey, g.l_linenumber, array_to_string(list_filter([CASE WHEN g.n > 1 THEN 'duplicate' END,
    CASE WHEN g.l_linenumber > 1 AND p.n IS NULL THEN 'gap' END, CASE WHEN g.l_linenumber > 1 AND p.n IS NULL THEN 'orphan' END,
    CASE WHEN NOT g.passed THEN 'failed' END], lambda x: x IS NOT NULL), ',') AS faults, coalesce(p.shipped >= g.shipped, false) AS early
FROM g LEFT JOIN g p ON p.l_orderkey = g.l_orderkey AND p.l_linenumber = g.l_linenumber - 1"""


def turn_sequences(spark, folder):
    return reconcile.sequence_contract(table(spark, folder, "conversations"), "conv_id", "turn")


SEQUENCE_SQL = """SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS ordered
FROM conversations GROUP BY conv_id"""


def latest_orders(spark, folder):
    """The last day a customer ordered; a day with two orders leaves its result open and is refused."""
    jobs = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "c_name", "o_orderdate", "o_orderkey", "o_orderstatus")
    state = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    return reconcile.latest_attempt(jobs, F.col("c_name"), ["o_orderdate"]).select(
        "key", "attempts", "refused", "o_orderkey", state.alias("state"))


LATEST_SQL = """
WITH j AS (SELECT lower(c_name) AS key, o_orderdate, o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY lower(c_name), o_orderdate) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT key, count(*) AS attempts, max(n) > 1 AS refused, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
  CASE max_by(o_orderstatus, (o_orderdate, o_orderkey)) WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'error' END AS state
FROM j GROUP BY key"""


def status_rollup(spark, folder):
    """Worst line state of each order over every line number up to its last; an absent one is an error."""
    items = table(spark, folder, "lineitem")
    required = items.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")).select(
        "l_orderkey", F.explode(F.sequence(F.lit(1), "n")).alias("l_linenumber"))
    state = F.when(F.col("l_linestatus") == "O", "pending").when(F.col("l_returnflag") == "R", "failure").otherwise("success")
    results = items.groupBy("l_orderkey", "l_linenumber").agg(F.max(state).alias("state"))
    return reconcile.worst_of(required, results, ["l_orderkey"], "l_linenumber", "state")


ROLLUP_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_linestatus = 'O' THEN 'pending' WHEN l_returnflag = 'R' THEN 'failure' ELSE 'success' END) AS state
      FROM lineitem GROUP BY ALL),
j AS (SELECT l_orderkey, count(*) < max(l_linenumber) AS absent, max(CASE state WHEN 'success' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END) AS k FROM s GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN absent THEN 'error' ELSE ['success', 'pending', 'failure'][k + 1] END AS worst FROM j"""


def stale_approvals(spark, folder):
    """Reviews bound to a text; documents of a multiple of seven were changed since."""
    docs = table(spark, folder, "documents")
    current = docs.select("doc_id", F.md5("text").alias("md5"))
    approvals = table(spark, folder, "labels").where("quality = 1").join(docs, "doc_id").select(
        (F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 10_000_000).otherwise(0)).alias("doc_id"),
        F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("md5"))
    return reconcile.stale(approvals, current, "doc_id", "md5")


STALE_SQL = """
SELECT doc_id + CASE WHEN doc_id % 11 = 0 THEN 10000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 11 = 0 THEN 'gone' ELSE 'changed' END AS reason
FROM labels WHERE quality = 1 AND (doc_id % 7 = 0 OR doc_id % 11 = 0) AND doc_id IN (SELECT doc_id FROM documents)"""


def summary_agreement(spark, folder):
    """Order totals recomputed from the lines against the stated status."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count("*").alias("n"))
    orders = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    found = F.when(F.col("n").isNull(), "none").when(F.col("done") == F.col("n"), "F").when(F.col("done") == 0, "O").otherwise("P")
    return orders.select("o_orderkey", "o_orderstatus", found.alias("found"), (found == F.col("o_orderstatus")).alias("agrees"))


SUMMARY_SQL = """
WITH l AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS done, count(*) AS n FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey, o_orderstatus, CASE WHEN n IS NULL THEN 'none' WHEN done = n THEN 'F' WHEN done = 0 THEN 'O' ELSE 'P' END AS found
      FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT *, found = o_orderstatus AS agrees FROM f"""


def document_crosswalk(spark, folder):
    labels = table(spark, folder, "labels")
    state = lambda c: F.when(F.col(c).isNull(), "inconclusive").when(F.col(c) == 1, "verified").otherwise("mismatch")
    benchmark = table(spark, folder, "benchmark").select(F.sha2("text", 256).alias("sha")).distinct()
    docs = table(spark, folder, "documents")
    held = docs.select("doc_id", F.sha2("text", 256).alias("sha")).join(benchmark, "sha").select("doc_id", F.lit("mismatch").alias("state"))
    return reconcile.crosswalk(docs, {"quality": labels.select("doc_id", state("quality").alias("state")),
                                      "toxic": labels.select("doc_id", state("toxic").alias("state")), "benchmark": held}, "doc_id")


CROSSWALK_SQL = """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not-performed' WHEN quality IS NULL THEN 'inconclusive' WHEN quality = 1 THEN 'verified' ELSE 'mismatch' END AS quality,
  CASE WHEN l.doc_id IS NULL THEN 'not-performed' WHEN toxic IS NULL THEN 'inconclusive' WHEN toxic = 1 THEN 'verified' ELSE 'mismatch' END AS toxic,
  CASE WHEN d.text IN (SELECT text FROM benchmark) THEN 'mismatch' ELSE 'not-performed' END AS benchmark
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def sampled_turns(spark, folder):
    """First, middle and last turn of each conversation."""
    rows = reconcile.placed(table(spark, folder, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn", "role"])
    return rows.where("ordinal = 1 or ordinal = ceil(n / 2) or ordinal = n").select("conv_id", "turn", "role", "ordinal")


SAMPLE_SQL = """
SELECT conv_id, turn, role, CAST(o AS INTEGER) AS ordinal FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS o,
  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE o = 1 OR o = (n + 1) // 2 OR o = n"""


def joined_sequences(spark, folder):
    """All conversations' turns as one sequence: each conversation follows the one before it.

    The offsets are running sums over one row per conversation, scanned in ranges of ids.
    """
    from quire.operators.scan import running

    turns = table(spark, folder, "conversations")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size")).withColumn("all", F.lit(0))
    offsets = running(sizes, ["all"], ["conv_id"], {"before": ("sum", F.col("size"))}, F.floor(F.col("conv_id") / 64), inclusive=False)
    rows = reconcile.placed(turns.select("conv_id", "turn", "role"), "conv_id", ["turn", "role"])
    return rows.join(offsets.select("conv_id", "before"), "conv_id").select(
        "conv_id", "turn", "role", (F.coalesce("before", F.lit(0)) + F.col("ordinal")).alias("position"))


JOINED_SQL = "SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn, role) AS position FROM conversations"


def sliced_turns(spark, folder):
    """Turns two to four of each conversation, renumbered; conversations with fewer are refused."""
    rows = reconcile.placed(table(spark, folder, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn", "role"])
    return rows.where("n >= 4 and ordinal between 2 and 4").select("conv_id", "turn", "role", (F.col("ordinal") - 1).alias("position"))


SLICED_SQL = """
SELECT conv_id, turn, role, CAST(o - 1 AS INTEGER) AS position FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS o,
  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n >= 4 AND o BETWEEN 2 AND 4"""

QUERIES = {
    "distinct_bodies": Query(distinct_bodies, BODIES_SQL, "IDN-1 IDN-2"),
    "body_occurrences": Query(body_occurrences, OCCURRENCES_SQL, "IDN-2"),
    "hash_collisions": Query(hash_collisions, COLLISIONS_SQL, "IDN-3"),
    "checksum_manifest": Query(checksum_manifest, MANIFEST_SQL, "IDN-4"),
    "snapshot_changes": Query(snapshot_changes, CHANGES_SQL, "IDN-5"),
    "name_collisions": Query(name_collisions, NAMES_SQL, "IDN-6"),
    "patched_turns": Query(patched_turns, PATCH_SQL, "IDN-7"),
    "reviewed_documents": Query(reviewed_documents, REVIEWS_SQL, "IDN-8"),
    "byte_budget": Query(byte_budget, BUDGET_SQL, "IDN-9"),
    "merged_revisions": Query(merged_revisions, REVISIONS_SQL, "IDN-10"),
    "first_line_aliases": Query(first_line_aliases, ALIASES_SQL, "IDN-11"),
    "orders_without_lines": Query(orders_without_lines, MISSING_SQL, "REC-1"),
    "part_suppliers": Query(part_suppliers, SETS_SQL, "REC-2"),
    "bad_first_lines": Query(bad_first_lines, BAD_SQL, "REC-3"),
    "label_coverage": Query(label_coverage, COVERAGE_SQL, "REC-8"),
    "mutual_supply": Query(mutual_supply, MUTUAL_SQL, "REC-6"),
    "nation_priority_matrix": Query(nation_priority_matrix, MATRIX_SQL, "REC-10"),
    "supply_matrix": Query(supply_matrix, SUPPLY_SQL, "REC-10"),
    "line_contract": Query(line_contract, LINE_CONTRACT_SQL, "REC-12 STR-5"),
    "turn_sequences": Query(turn_sequences, SEQUENCE_SQL, "REC-12"),
    "latest_orders": Query(latest_orders, LATEST_SQL, "REC-13 REC-14"),
    "summary_agreement": Query(summary_agreement, SUMMARY_SQL, "REC-16"),
    "document_crosswalk": Query(document_crosswalk, CROSSWALK_SQL, "REC-22"),
    "stale_approvals": Query(stale_approvals, STALE_SQL, "REC-23"),
    "status_rollup": Query(status_rollup, ROLLUP_SQL, "REC-28 REC-30"),
    "sliced_turns": Query(sliced_turns, SLICED_SQL, "GEO-6"),
    "joined_sequences": Query(joined_sequences, JOINED_SQL, "GEO-7"),
    "sampled_turns": Query(sampled_turns, SAMPLE_SQL, "GEO-8"),
}
