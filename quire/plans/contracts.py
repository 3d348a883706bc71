"""Evidence contracts over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import witness
from quire.plans.base import Query, table


def proven_orders(spark, folder):
    """Orders claimed by lines of their own status; a line proves when it stays and is large."""
    expected = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("scope"))
    claims = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("scope"),
                                                     (F.col("l_returnflag") != "R").alias("passed"), (F.col("l_quantity") >= 25).alias("clean"))
    return witness.proven(expected, claims)


PROVEN_SQL = """
WITH e AS (SELECT DISTINCT o_orderkey AS key, o_orderstatus AS scope FROM orders),
c AS (SELECT l_orderkey AS key, l_linestatus AS scope, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity >= 25) AS p FROM lineitem GROUP BY ALL)
SELECT coalesce(e.key, c.key) AS key, coalesce(e.scope, c.scope) AS scope, coalesce(n, 0) AS claims,
  CASE WHEN e.key IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN p = 0 THEN 'unproven' WHEN p > 1 THEN 'repeated' ELSE 'covered' END AS state
FROM e FULL JOIN c ON e.key = c.key AND e.scope = c.scope"""


def order_map(spark, folder):
    """Orders as units and their lines as the map: the flag is the target, none for ``N``, and large lines are kept as they are."""
    units = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("place"))
    mapped = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("target"), F.col("l_linestatus").alias("place"),
        (F.col("l_quantity") > 40).alias("retained"))
    return witness.coverage_map(units, mapped)


MAP_SQL = """
WITH m AS (SELECT l_orderkey AS id, count(*) AS n, max(l_linestatus) AS place, max(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS target, max(l_quantity) > 40 AS kept
  FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, id) AS id, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN n > 1 THEN 'repeated' WHEN n IS NULL THEN 'missing'
  WHEN o_orderstatus <> place THEN 'moved' WHEN kept THEN 'retained' WHEN target IS NULL THEN 'empty' ELSE 'covered' END AS state
FROM orders FULL JOIN m ON id = o_orderkey"""


def order_receipts(spark, folder):
    """Orders as runs bound to their status; each line is a receipt."""
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("nonce"), F.col("o_orderstatus").alias("arguments"))
    found = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("nonce"), F.col("l_linestatus").alias("arguments"), (F.col("l_returnflag") != "N").alias("completed"),
        F.when(F.col("l_quantity") > 30, 1).otherwise(0).alias("code"))
    return witness.receipts(runs, found)


RECEIPTS_SQL = """
WITH f AS (SELECT l_orderkey AS nonce, count(*) AS n, max(l_linestatus) AS told, max(l_returnflag) <> 'N' AS done, max(l_quantity) > 30 AS bad FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, nonce) AS nonce, CASE WHEN o_orderkey IS NULL THEN 'stray' WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several'
  WHEN o_orderstatus <> told THEN 'unbound' WHEN NOT done THEN 'unfinished' WHEN bad THEN 'failed' ELSE 'accepted' END AS state
FROM orders FULL JOIN f ON nonce = o_orderkey"""


def line_witnesses(spark, folder):
    """Returned lines name their parts as witnesses: parts of settled lines have passed, suppliers are the events."""
    items = table(spark, folder, "lineitem")
    checks = items.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("scope")).agg(F.collect_list("l_partkey").alias("witnesses"))
    passed = items.where("l_quantity < 12").select(F.col("l_orderkey").alias("scope"), F.col("l_partkey").alias("id"))
    return witness.membership(checks, passed, items.select(F.col("l_orderkey").alias("scope"), F.col("l_suppkey").alias("id")))


WITNESSES_SQL = """
WITH c AS (SELECT l_orderkey AS scope, l_partkey AS id, count(*) AS checks FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
h AS (SELECT l_orderkey AS scope, l_partkey AS id FROM lineitem WHERE l_quantity < 12 UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem),
n AS (SELECT scope, id, count(*) AS n FROM h GROUP BY ALL)
SELECT c.scope, c.id AS witness, checks, CASE WHEN n > 1 THEN 'twice' WHEN n = 1 THEN 'member' WHEN c.id IN (SELECT id FROM h) THEN 'foreign' ELSE 'absent' END AS state
FROM c LEFT JOIN n ON n.scope = c.scope AND n.id = c.id"""


def verdict_agreement(spark, folder):
    """Labels as reports, code 0 for quality, against the lines with runs of marks."""
    reports = table(spark, folder, "labels").select(F.col("doc_id").alias("report"), (1 - F.col("quality")).alias("code"))
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    found = lines.where(F.col("line").rlike(r"[#*$%&|]{3}")).select(F.col("doc_id").alias("report"), F.lit("marks").alias("rule"), (F.col("i") + 1).alias("line"))
    return witness.scanner_agreement(reports, found)


VERDICT_SQL = """
WITH f AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[#*$%&|]{3}'))) AS n FROM documents),
r AS (SELECT doc_id, min(1 - quality) AS lo, max(1 - quality) AS hi FROM labels GROUP BY 1)
SELECT coalesce(r.doc_id, f.doc_id) AS report, coalesce(n, 0) AS n, CASE WHEN r.doc_id IS NULL THEN 'unknown' WHEN n > 100000 THEN 'too-many'
  WHEN lo <> hi OR lo = 0 AND coalesce(n, 0) > 0 OR lo = 1 AND coalesce(n, 0) = 0 THEN 'contradiction' WHEN lo IS NULL THEN 'error' WHEN lo = 0 THEN 'clean' ELSE 'found' END AS state
FROM r FULL JOIN (SELECT * FROM f WHERE n > 0) f ON f.doc_id = r.doc_id"""


def census_audit(spark, folder):
    """Documents against labels whose target is the text and whose platform is the language."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("target"), F.array("lang").alias("platforms"))
    mapping = table(spark, folder, "labels").select("doc_id").join(docs, "doc_id", "left").withColumnRenamed("doc_id", "id")
    return witness.census(docs.select(F.col("doc_id").alias("id")), mapping, "en")


CENSUS_SQL = """
WITH m AS (SELECT l.doc_id, text, lang FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id),
s AS (SELECT text FROM m WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, count(*) AS n, max(text) AS text, max(lang) AS lang FROM m GROUP BY doc_id)
SELECT coalesce(d.doc_id, g.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN g.text IS NULL THEN 'pending'
  WHEN g.text IN (SELECT text FROM s) THEN 'shared' WHEN g.lang <> 'en' THEN 'unavailable' ELSE 'placed' END AS state
FROM documents d FULL JOIN g ON g.doc_id = d.doc_id"""

QUERIES = {
    "proven_orders": Query(proven_orders, PROVEN_SQL, "REC-8"),
    "order_map": Query(order_map, MAP_SQL, "REC-20"),
    "order_receipts": Query(order_receipts, RECEIPTS_SQL, "REC-29"),
    "line_witnesses": Query(line_witnesses, WITNESSES_SQL, "REC-26"),
    "verdict_agreement": Query(verdict_agreement, VERDICT_SQL, "REC-17"),
    "census_audit": Query(census_audit, CENSUS_SQL, "REC-4"),
}
