"""Audits: inventories, allow lists, receipts and witnesses over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import reconcile
from quire.plans.base import Query, table


def approved_terms(spark, folder):
    """Parts with a brand whose size is approved, and whether their brand has too many of them."""
    rows = table(spark, folder, "part").where("p_brand is not null and trim(p_brand) <> '' and p_size % 5 in (1, 2)")
    counts = rows.groupBy("p_brand").agg(F.count("*").alias("n"))
    return rows.join(counts, "p_brand").select("p_partkey", "p_brand", (F.col("n") > 30).alias("over_limit"))


APPROVED_SQL = """SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) > 30 AS over_limit FROM part WHERE trim(p_brand) <> '' AND p_size % 5 IN (1, 2)"""


def brief_sources(spark, folder):
    """Hash of each source document and whether its language id is well formed."""
    return table(spark, folder, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.col("lang").rlike("^[a-z]{2}(?:-[A-Za-z0-9]{2,8})*$").alias("valid"))


SOURCES_SQL = "SELECT doc_id, sha256(text) AS sha256, regexp_full_match(lang, '[a-z]{2}(?:-[A-Za-z0-9]{2,8})*') AS valid FROM documents"


def shared_bodies(spark, folder):
    """Texts that more than one source claims: inventories should share none."""
    return table(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.countDistinct("source").alias("sources"), F.count("*").alias("n")).where("sources > 1")


SHARED_SQL = "SELECT sha256(text) AS sha256, count(DISTINCT source) AS sources, count(*) AS n FROM documents GROUP BY text HAVING count(DISTINCT source) > 1"


def nation_scopes(spark, folder):
    """A customer's scope is its nation, or every nation of its region when its balance is negative; the
    nations of that scope that none of its suppliers is in."""
    nations = table(spark, folder, "nation")
    customers = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    peers = nations.groupBy("n_regionkey").agg(F.collect_set("n_nationkey").alias("all"))
    scopes = customers.join(peers, "n_regionkey").select("c_custkey", F.explode(
        F.when(F.col("c_acctbal") < 0, F.col("all")).otherwise(F.array("c_nationkey"))).alias("nation"))
    served = table(spark, folder, "orders").join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(
        table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("o_custkey").alias("c_custkey"), F.col("s_nationkey").alias("nation"))
    return reconcile.missing(scopes, served, ["c_custkey", "nation"])


SCOPES_SQL = """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN m.n_nationkey ELSE c_nationkey END AS nation FROM customer
  JOIN nation n ON c_nationkey = n.n_nationkey JOIN nation m ON m.n_regionkey = n.n_regionkey
EXCEPT SELECT o_custkey, s_nationkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey"""


def allowed_parents(spark, folder):
    """Lines whose supplier is in another region than the customer: parents outside the relation."""
    region = table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    sold = table(spark, folder, "supplier").join(region, F.col("s_nationkey") == F.col("k")).select("s_suppkey", F.col("r").alias("from_region"))
    bought = table(spark, folder, "customer").join(region, F.col("c_nationkey") == F.col("k")).select("c_custkey", F.col("r").alias("to_region"))
    return table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        sold, F.col("l_suppkey") == F.col("s_suppkey")).join(bought, F.col("o_custkey") == F.col("c_custkey")).where(
        "from_region <> to_region").groupBy("from_region", "to_region").agg(F.count("*").alias("lines"))


PARENTS_SQL = """
SELECT a.n_regionkey AS from_region, b.n_regionkey AS to_region, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey
JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL"""


def complete_pages(spark, folder):
    """Conversations as pages of turns: the stated last turn, the turns there are, and whether
    nothing is missing."""
    return table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.count("*").alias("held"), F.countDistinct("turn").alias("turns")).select(
        "conv_id", "last", "held", (F.col("turns") == F.col("last") + 1).alias("complete"))


PAGES_SQL = "SELECT conv_id, max(turn) AS last, count(*) AS held, count(DISTINCT turn) = max(turn) + 1 AS complete FROM conversations GROUP BY conv_id"


def role_audit(spark, folder):
    """Conversations in which a role speaks out of turn: users on even turns, assistants on odd."""
    rows = table(spark, folder, "conversations").select("conv_id", F.expr(
        "stack(2, 'user', role = 'user' and turn % 2 = 1, 'assistant', role = 'assistant' and turn % 2 = 0) as (who, wrong)"))
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("wrong"), F.col("who")))), ",").alias("failing"),
                                       F.count_if("wrong").alias("n"))


ROLE_SQL = """
WITH r AS (SELECT conv_id, CASE WHEN role = 'user' AND turn % 2 = 1 THEN 'user' WHEN role = 'assistant' AND turn % 2 = 0 THEN 'assistant' END AS w FROM conversations)
SELECT conv_id, coalesce(string_agg(DISTINCT w, ',' ORDER BY w), '') AS failing, count(w) AS n FROM r GROUP BY conv_id"""


def category_inventory(spark, folder):
    """Documents by size class and language, their bytes, and those above the limit of a class."""
    size = F.octet_length("text")
    kind = F.when(size < 500, "short").when(size < 5000, "medium").otherwise("long")
    return table(spark, folder, "documents").groupBy(kind.alias("kind"), "lang").agg(
        F.count("*").alias("n"), F.sum(size).alias("bytes"), F.count_if(size > 12_000).alias("over"))


INVENTORY_SQL = """SELECT CASE WHEN strlen(text) < 500 THEN 'short' WHEN strlen(text) < 5000 THEN 'medium' ELSE 'long' END AS kind, lang,
  count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (WHERE strlen(text) > 12000) AS over FROM documents GROUP BY ALL"""


def licence_audit(spark, folder):
    """Licence lines of documents: the identifiers they name, and whether each is admitted."""
    line = F.explode(F.filter(F.split("text", "\n", -1), lambda x: x.rlike("(?i)licen[sc]e")))
    named = table(spark, folder, "documents").select("doc_id", line.alias("line")).select(
        "doc_id", F.explode(F.regexp_extract_all("line", F.lit("(?:Apache|MIT|GNU|CC BY-NC|BSD|MPL)"), 0)).alias("id"))
    return named.groupBy("id").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("lines")).withColumn(
        "admitted", F.col("id").isin("Apache", "MIT", "BSD", "MPL"))


LICENCE_SQL = """
WITH l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)licen[sc]e'))) AS line FROM documents),
n AS (SELECT doc_id, unnest(regexp_extract_all(line, '(?:Apache|MIT|GNU|CC BY-NC|BSD|MPL)')) AS id FROM l)
SELECT id, count(DISTINCT doc_id) AS documents, count(*) AS lines, id IN ('Apache', 'MIT', 'BSD', 'MPL') AS admitted FROM n GROUP BY id"""


def witnessed_lines(spark, folder):
    """Lines returned by a customer who has no settled order: witnesses outside their scope."""
    orders = table(spark, folder, "orders")
    settled = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c")).distinct()
    return table(spark, folder, "lineitem").where("l_returnflag = 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        settled, F.col("o_custkey") == F.col("c"), "left_anti").groupBy("o_custkey").agg(F.count("*").alias("lines"))


WITNESS_SQL = """
SELECT o_custkey, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"""


def assembled_witnesses(spark, folder):
    """The part keys that each order proves, in order, for orders that are settled."""
    orders = table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")), ",").alias("parts"))


ASSEMBLED_SQL = """SELECT o_orderkey, string_agg(DISTINCT l_partkey, ',' ORDER BY l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F' GROUP BY 1"""


def single_receipts(spark, folder):
    """Orders with exactly one line, and whether that line is settled."""
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.max("l_linestatus").alias("state")).where("n = 1").select(
        "l_orderkey", (F.col("state") == "F").alias("accepted"))


RECEIPT_SQL = "SELECT l_orderkey, max(l_linestatus) = 'F' AS accepted FROM lineitem GROUP BY 1 HAVING count(*) = 1"

QUERIES = {
    "approved_terms": Query(approved_terms, APPROVED_SQL, "TRM-1"),
    "brief_sources": Query(brief_sources, SOURCES_SQL, "TRM-9"),
    "shared_bodies": Query(shared_bodies, SHARED_SQL, "REC-5"),
    "allowed_parents": Query(allowed_parents, PARENTS_SQL, "REC-9"),
    "nation_scopes": Query(nation_scopes, SCOPES_SQL, "REC-11"),
    "complete_pages": Query(complete_pages, PAGES_SQL, "REC-15"),
    "role_audit": Query(role_audit, ROLE_SQL, "REC-18"),
    "category_inventory": Query(category_inventory, INVENTORY_SQL, "REC-24"),
    "licence_audit": Query(licence_audit, LICENCE_SQL, "REC-25"),
    "witnessed_lines": Query(witnessed_lines, WITNESS_SQL, "REC-26"),
    "assembled_witnesses": Query(assembled_witnesses, ASSEMBLED_SQL, "REC-27"),
    "single_receipts": Query(single_receipts, RECEIPT_SQL, "REC-29"),
}
