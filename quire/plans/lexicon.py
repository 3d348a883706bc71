"""Dictionary queries: phrases of the benchmark met in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import terms
from quire.plans.base import Query, longs, table

# Words of nine letters, and phrases of two to six words.
LENGTHS = range(1, 7)
PATTERNS = {n: f"[A-Za-z]+(?: [A-Za-z]+){{{n - 1}}}" if n > 1 else "[A-Za-z]{9,}" for n in LENGTHS}


def _phrases(spark, folder, lengths=LENGTHS):
    """``words, phrase``: every phrase that the benchmark has at the places a pattern finds."""
    def sized(n: int):
        return F.transform(F.regexp_extract_all("text", F.lit(PATTERNS[n]), 0), lambda x: F.struct(F.lit(n).alias("words"), x.alias("phrase")))

    found = F.array(*[sized(n) for n in lengths])
    return table(spark, folder, "benchmark").select(F.explode(F.flatten(found)).alias("p")).select("p.*")


def _phrases_sql(lengths=LENGTHS):
    return " UNION ALL ".join(
        f"SELECT {n} AS words, unnest(regexp_extract_all(text, '{PATTERNS[n]}')) AS phrase FROM benchmark" for n in lengths)


def hits_of(keys: str) -> str:
    """SQL for the hits of lower-case keys: texts are split at a key, boundaries are tested afterwards."""
    return f"""
      SELECT doc_id, key, start, start + length(key) AS "end", text[start + 1:start + length(key)] AS token,
             1 + length(text[1:start]) - length(replace(text[1:start], chr(10), '')) AS line,
             1 + length(list_last(string_split(text[1:start], chr(10)))) AS col
      FROM (SELECT doc_id, text, key, length(array_to_string(p[1:i], '')) + length(key) * (i - 1) AS start
            FROM (SELECT doc_id, text, key, p, unnest(range(1, len(p))) AS i
                  FROM (SELECT doc_id, text, key, string_split(lower(text), key) AS p
                        FROM documents JOIN ({keys}) ON contains(lower(text), key))))
      WHERE NOT (start > 0 AND regexp_matches(text[start:start], '[\\p{{L}}\\p{{N}}_]'))
        AND NOT regexp_matches(text[start + length(key) + 1:start + length(key) + 1], '[\\p{{L}}\\p{{N}}_]')"""


def phrase_hits(spark, folder):
    return terms.phrases(table(spark, folder, "documents"), _phrases(spark, folder), "phrase")


PHRASE_SQL = hits_of(f"SELECT DISTINCT lower(phrase) AS key FROM ({_phrases_sql()})")


def banned_findings(spark, folder):
    """Phrases of two to four words as forbidden forms: where they overlap, the longest one stands."""
    forms = _phrases(spark, folder, (2, 3, 4)).select(F.col("words").cast("string").alias("source"), F.col("phrase").alias("form"))
    return terms.forbidden(table(spark, folder, "documents"), forms).select("doc_id", "source", "key", "start", "line", "col")


BANNED_FINDINGS_SQL = f"""
WITH f AS (SELECT DISTINCT CAST(words AS VARCHAR) AS source, lower(phrase) AS key FROM ({_phrases_sql((2, 3, 4))})),
h AS ({hits_of("SELECT DISTINCT key FROM f")}),
g AS (SELECT doc_id, list([{{'n': -length(key), 'key': key, 'a': start, 'b': "end", 'line': line, 'col': col}}] ORDER BY -length(key), key, start) AS hs FROM h GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(hs, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.a < x[1].b AND x[1].a < k.b)) > 0
        THEN kept ELSE list_concat(kept, x) END)) AS x FROM g)
SELECT doc_id, source, key, x.a AS start, x.line AS line, x.col AS col FROM k JOIN f ON f.key = k.x.key"""


def matched_ambiguity(spark, folder):
    """Benchmark phrases as terms whose output is the item they stand in: those met in a document
    that more than one item has."""
    found = F.array(*[F.regexp_extract_all("text", F.lit(PATTERNS[n]), 0) for n in (1, 2)])
    pairs = table(spark, folder, "benchmark").select("item_id", F.explode(F.flatten(found)).alias("source")).select(
        "source", F.col("item_id").cast("string").alias("output"), F.length("source").alias("concept"))
    return terms.ambiguous_matched(terms.phrases(table(spark, folder, "documents"), pairs, "source"), pairs)


_PAIRS = " UNION ALL ".join(f"SELECT item_id, unnest(regexp_extract_all(text, '{PATTERNS[n]}')) AS source FROM benchmark" for n in (1, 2))
AMBIGUITY_SQL = f"""
WITH p AS (SELECT DISTINCT lower(source) AS key, item_id, length(source) AS concept FROM ({_PAIRS})),
h AS (SELECT DISTINCT doc_id, key FROM ({hits_of("SELECT DISTINCT key FROM p")}))
SELECT doc_id, key, count(*) AS outputs FROM h JOIN p USING (key) GROUP BY ALL HAVING count(*) > 1"""

QUERIES = {
    "phrase_hits": Query(longs(phrase_hits, "start", "end", "line", "col"), PHRASE_SQL, "TRM-3"),
    "banned_findings": Query(longs(banned_findings, "start", "line", "col"), BANNED_FINDINGS_SQL, "RUL-6"),
    "matched_ambiguity": Query(matched_ambiguity, AMBIGUITY_SQL, "TRM-6"),
}
