"""Located matches, intervals and reports over documents and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions.text import plural_stem, strip_bidi
from quire.operators import locate, report, spans
from quire.plans.base import Query, hits_sql, longs, table

NUMBER = r"[0-9]+(?:[.:/-][0-9]+)*"
CAPITALS = "[A-Z]{2,}"
# Check, level and pattern of each rule; patterns hold no line break.
RULES = (
    ("number-cluster", "warn", NUMBER),
    ("capital-run", "warn", CAPITALS),
    ("symbol-run", "error", r"[#*$%&|]{3,}"),
    ("doubled-mark", "error", r"[!?]{2,}"),
    ("mail-address", "error", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"),
)


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def number_cluster_findings(spark, folder):
    hits = locate.find_all(docs(spark, folder), NUMBER)
    return hits.select("doc_id", "start", "end", "token", "line", "col", "excerpt")


NUMBERS_SQL = f"""
SELECT doc_id, start, "end", token, line, col,
       regexp_replace(replace(substr(hit_text, greatest(1, start - 19), 60), chr(10), ' '),
                      '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') AS excerpt
FROM ({hits_sql("documents", "doc_id", "text", NUMBER)})"""


def bounded_capitals(spark, folder):
    return locate.find_bounded(docs(spark, folder), CAPITALS, before="a-z", after="a-z!").select(
        "doc_id", "start", "token")


BOUNDED_SQL = f"""
SELECT doc_id, start, token FROM ({hits_sql("documents", "doc_id", "text", CAPITALS)})
WHERE NOT regexp_matches(substr(hit_text, start, 1), '[a-z]') AND NOT regexp_matches(substr(hit_text, "end" + 1, 1), '[a-z!]')
   OR start = 0 AND NOT regexp_matches(substr(hit_text, "end" + 1, 1), '[a-z!]')"""


def line_lengths(spark, folder):
    return locate.line_index(docs(spark, folder)).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.max(F.col("end") - F.col("start")).alias("longest"),
        F.max("end").alias("chars"))


LINES_SQL = """
SELECT doc_id, len(ls) AS lines, list_max(list_transform(ls, lambda x: length(x))) AS longest, length(text) AS chars
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)"""


def located_marks(spark, folder):
    frame = docs(spark, folder)
    return locate.locate(locate.find_spans(frame, "[!?]{2,}"), locate.line_index(frame)).groupBy("doc_id", "line").agg(
        F.count("*").alias("hits"), F.max("col").alias("last_col"))


MARKS_SQL = f"""
SELECT doc_id, line, count(*) AS hits, max(col) AS last_col
FROM ({hits_sql("documents", "doc_id", "text", "[!?]{2,}")}) GROUP BY doc_id, line"""


def turn_provenance(spark, folder):
    """Words in capitals found in whole conversations, traced back to the turn that holds them."""
    turns = table(spark, folder, "conversations")
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    whole = parts.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
    segments = parts.select("conv_id", F.explode(F.transform("t", lambda x, i: F.struct(
        F.aggregate(F.slice("t", F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y["text"]) + 1).alias("start"),
        x["turn"].cast("string").alias("src_path"), F.lit(0).alias("src_offset")))).alias("s")).select("conv_id", "s.*")
    hits = locate.find_spans(whole, "[A-Z][a-z]+", "conv_id")
    return locate.provenance(hits, segments, "conv_id").groupBy("conv_id", F.col("src_path").cast("bigint").alias("turn")).agg(
        F.count("*").alias("hits"), F.sum("src_start").alias("offsets"))


PROVENANCE_SQL = f"""
SELECT conv_id, turn, count(*) AS hits, CAST(sum(start) AS BIGINT) AS offsets
FROM (SELECT conv_id, turn, start FROM (
  SELECT key // 1000000 AS conv_id, key % 1000000 AS turn, start
  FROM ({hits_sql("(SELECT conv_id * 1000000 + turn AS key, text FROM conversations)", "key", "text", "[A-Z][a-z]+")})))
GROUP BY conv_id, turn"""


def folded_offsets(spark, folder):
    """Number clusters of texts whose runs of blanks were folded, moved back to the raw text."""
    frame = docs(spark, folder)
    runs = locate.find_spans(frame, "(?:\\*{3}|%{3}|&{3}|\\${3}|#{3})").select(
        "doc_id", F.col("start").alias("from_start"), F.col("end").alias("from_end"))
    order = Window.partitionBy("doc_id").orderBy("from_start").rowsBetween(Window.unboundedPreceding, -1)
    mapped = runs.withColumn("to_start", F.col("from_start") - 2 * F.count("*").over(order)).select(
        "doc_id", "from_start", "from_end", "to_start", (F.col("to_start") + 1).alias("to_end"))
    hits = locate.find_spans(frame, CAPITALS).select("doc_id", "start", "token")
    there = locate.translate_offsets(hits, mapped).select("doc_id", F.col("translated").alias("start"), "token", F.col("start").alias("raw"))
    return locate.translate_offsets(there, mapped, back=True).select("doc_id", "token", "raw", F.col("start").alias("folded"), F.col("translated").alias("back"))


FOLDED_SQL = f"""
SELECT doc_id, token, start AS raw, start - 2 * len(regexp_extract_all(substr(hit_text, 1, start), '(?:\\*{{3}}|%{{3}}|&{{3}}|\\${{3}}|#{{3}})')) AS folded,
       start AS back FROM ({hits_sql("documents", "doc_id", "text", CAPITALS)})"""


MARKS = "(?:\\*{3}|%{3}|&{3}|\\${3}|#{3})"
BLANKS = "[ ,]{2,}"


def composed_offsets(spark, folder):
    """Two normalisations in a row: marks go, then runs of blanks and commas shrink to one blank. Line breaks
    of the raw text are moved to the final one by the composed map, and those of the final text back."""
    frame = docs(spark, folder).select("doc_id", "text")
    stripped = frame.withColumn("text", F.regexp_replace("text", MARKS, ""))
    final = stripped.withColumn("text", F.regexp_replace("text", BLANKS, " "))
    both = locate.compose_maps(locate.replacement_map(frame, MARKS, 0), locate.replacement_map(stripped, BLANKS, 1))
    breaks = lambda f: f.select("doc_id", F.explode(locate.hit_places(F.col("text"), "\n")["start"]).alias("start"))
    there = locate.translate_offsets(breaks(frame), both).withColumn("way", F.lit("there"))
    back = locate.translate_offsets(breaks(final), both, back=True).withColumn("way", F.lit("back"))
    return there.unionByName(back).select("doc_id", "way", "start", "translated")


COMPOSED_SQL = f"""
WITH d AS (SELECT doc_id, text AS a, regexp_replace(regexp_replace(text, '{MARKS}', '', 'g'), '{BLANKS}', ' ', 'g') AS b FROM documents),
l AS (SELECT doc_id, string_split(a, chr(10)) AS x, string_split(b, chr(10)) AS y FROM d),
k AS (SELECT doc_id, unnest(range(1, len(x))) AS i, x, y FROM l),
p AS (SELECT doc_id, CAST(list_sum(list_transform(x[1:i], lambda s: length(s))) AS BIGINT) + i - 1 AS raw,
             CAST(list_sum(list_transform(y[1:i], lambda s: length(s))) AS BIGINT) + i - 1 AS final FROM k)
SELECT doc_id, 'there' AS way, raw AS start, final AS translated FROM p UNION ALL SELECT doc_id, 'back', final, raw FROM p"""


def stay(items: DataFrame) -> DataFrame:
    day = F.datediff(F.col("l_shipdate"), F.lit("1970-01-01"))
    return items.select("l_suppkey", day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"))


def merged_spans(spark, folder):
    """Days in which a supplier has goods under way, overlapping stays merged."""
    return spans.merge_spans(stay(table(spark, folder, "lineitem")), ["l_suppkey"], width=365)


STAY_SQL = """SELECT l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s,
       date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(floor(l_quantity) AS BIGINT) AS e FROM lineitem"""
MERGED_SQL = f"""
WITH x AS ({STAY_SQL}), m AS (
  SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM x WHERE s < e),
i AS (SELECT *, count(*) FILTER (WHERE r IS NULL OR s > r) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT l_suppkey, min(s) AS start, max(e) AS "end", count(*) AS pieces FROM i GROUP BY l_suppkey, k"""


def orders_inside(spark, folder):
    """Line items of small quantity shipped while a supplier has a large one under way, and not."""
    items = table(spark, folder, "lineitem")
    large = spans.merge_spans(stay(items.where("l_quantity >= 48")), ["l_suppkey"])
    small = items.where("l_quantity < 5").select("l_suppkey", "l_orderkey", "l_linenumber",
                                                 F.datediff("l_shipdate", F.lit("1970-01-01")).alias("start"))
    found = spans.with_membership(small, large, ["l_suppkey"], width=365)
    return found.groupBy("l_suppkey").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"))


INSIDE_SQL = f"""
WITH x AS ({STAY_SQL} WHERE l_quantity >= 48),
p AS (SELECT l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_quantity < 5),
f AS (SELECT p.l_suppkey, EXISTS (SELECT 1 FROM x WHERE x.l_suppkey = p.l_suppkey AND s <= d AND d < e) AS inside FROM p)
SELECT l_suppkey, count(*) FILTER (WHERE inside) AS inside, count(*) FILTER (WHERE NOT inside) AS outside FROM f GROUP BY l_suppkey"""


def rule_hits(frame: DataFrame) -> DataFrame:
    """All rules over each text, in one pass over the rows and one explode of the hits."""
    def found(check: str, level: str, pattern: str):
        return F.transform(locate.hit_array(F.col("text"), pattern, context=False), lambda h: F.struct(
            F.lit(check).alias("check"), F.lit(level).alias("level"), h["start"].alias("start"), h["end"].alias("end"),
            h["line"].alias("line"), h["col"].alias("col"), h["token"].alias("token")))

    return frame.select("doc_id", F.explode(F.flatten(F.array(*[found(*r) for r in RULES]))).alias("h")).select(
        "doc_id", "h.*")


RULES_SQL = " UNION ALL ".join(
    f"""SELECT doc_id, '{check}' AS "check", '{level}' AS level, start, "end", line, col, token FROM ({hits_sql("documents", "doc_id", "text", pattern)})"""
    for check, level, pattern in RULES)


def rule_findings(spark, folder):
    """Findings that no waiver covers: a line in capitals only waives the marks of itself and the next."""
    frame = docs(spark, folder)
    lines = locate.line_index(frame)
    starts = locate.find_all(frame, "(?m)^[A-Z!., ]{12,}$").select("doc_id", "line", F.lit("doubled-mark").alias("check"))
    return spans.apply_waivers(rule_hits(frame), starts.join(lines.select("doc_id", "line"), ["doc_id", "line"])).select(
        "doc_id", "check", "level", "start", "end", "line", "col", "token")


WAIVED_SQL = f"""
WITH f AS ({RULES_SQL}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
w AS (SELECT doc_id, line FROM l WHERE regexp_full_match(piece, '[A-Z!., ]{{12,}}'))
SELECT * FROM f WHERE "check" <> 'doubled-mark' OR NOT EXISTS (
  SELECT 1 FROM w WHERE w.doc_id = f.doc_id AND (w.line = f.line OR w.line + 1 = f.line))"""


def rule_counts(frame: DataFrame) -> DataFrame:
    """``check, level, findings`` of every rule that a text breaks: matches are counted where a text is read."""
    sums = frame.agg(*[F.sum(F.regexp_count("text", F.lit(pattern))).alias(check) for check, _, pattern in RULES])
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(v).alias("level"), F.col(f"`{c}`").cast("bigint").alias("findings")) for c, v, _ in RULES])
    return sums.select(F.explode(rows).alias("r")).select("r.*").where("findings > 0")


def findings_report(spark, folder):
    return report.group_counts(rule_counts(docs(spark, folder)))


REPORT_SQL = f"""
SELECT "check", level, count(*) AS findings,
       CAST(row_number() OVER (ORDER BY level <> 'error', "check", level) AS INTEGER) AS place
FROM ({RULES_SQL}) GROUP BY "check", level"""


def findings_top(spark, folder):
    frame = docs(spark, folder)
    totals = rule_counts(frame).select("check", F.col("findings").alias("total"))
    return report.top_per_group(rule_hits(frame).select("doc_id", "check", "start", "token"), ["check"], ["doc_id", "start"], 25, totals)


TOP_SQL = f"""
WITH f AS (SELECT doc_id, "check", start, token, row_number() OVER (PARTITION BY "check" ORDER BY doc_id, start) AS place,
                  count(*) OVER (PARTITION BY "check") AS total FROM ({RULES_SQL}))
SELECT *, greatest(total - 25, 0) AS more FROM f WHERE place <= 25"""


def findings_gate(spark, folder):
    return report.gate_counts(rule_counts(docs(spark, folder)), strict=True)


GATE_SQL = f"""
SELECT count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warn') AS warnings,
       count(*) > 0 AS failed FROM ({RULES_SQL}) WHERE level IN ('error', 'warn')"""


LETTER_MARK = "[À-ɏ][ \\t]?[,;?]|[,;][ \\t]?[À-ɏ]"


def script_punctuation(spark, folder):
    """Latin marks next to letters of another script."""
    return locate.find_all(docs(spark, folder), LETTER_MARK).groupBy("doc_id", "line").agg(
        F.count("*").alias("findings"), F.min("col").alias("first_col"))


_LETTER_MARK = "[\\x{c0}-\\x{24f}][ \\t]?[,;?]|[,;][ \\t]?[\\x{c0}-\\x{24f}]"
PUNCTUATION_SQL = f"""
SELECT doc_id, line, count(*) AS findings, min(col) AS first_col FROM ({hits_sql("documents", "doc_id", "text", _LETTER_MARK)}) GROUP BY doc_id, line"""


def findings_rendered(spark, folder):
    rows = rule_hits(docs(spark, folder)).where("check in ('symbol-run', 'mail-address')")
    return report.render_locations(rows, ["check", "line", "token"], ["doc_id", "start", "check"], 200)


RENDERED_SQL = f"""
WITH f AS (SELECT *, row_number() OVER (ORDER BY doc_id, start, "check") AS place FROM ({RULES_SQL})
           WHERE "check" IN ('symbol-run', 'mail-address'))
SELECT CAST(place AS INTEGER) AS place, '| <code>' || "check" || '</code> | ' || line || ' | <code>' ||
       replace(replace(token, '&', '&amp;'), '|', '&#124;') || '</code> |' AS line_text FROM f WHERE place <= 200
UNION ALL SELECT 201, CAST((SELECT greatest(count(*) - 200, 0) FROM f) AS VARCHAR) || ' more'"""


def adjacent_capitals(spark, folder):
    frame = docs(spark, folder)
    hits = locate.find_spans(frame, CAPITALS)
    return spans.adjacent_gap(hits, frame, "^ +$", cleaning={"!": "", ",": "", ".": ""})


ADJACENT_SQL = f"""
WITH h AS ({hits_sql("documents", "doc_id", "text", CAPITALS)}),
n AS (SELECT doc_id, hit_text, "end" AS start, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM h)
SELECT doc_id, start, stop AS "end", substr(hit_text, start + 1, stop - start) AS gap FROM n
WHERE stop > start AND regexp_full_match(replace(replace(replace(substr(hit_text, start + 1, stop - start), '!', ''), ',', ''), '.', ''), ' +')"""


def masked_numbers(spark, folder):
    frame = docs(spark, folder).select("doc_id", "text")
    hits = locate.find_spans(frame, "[0-9]+")
    done = spans.mask_spans(frame, hits)
    return done.select("doc_id", F.sha2(F.col("text"), 256).alias("sha"), F.length("text").alias("chars"))


MASKED_SQL = """
SELECT doc_id, sha256(regexp_replace(text, '[0-9]', ' ', 'g')) AS sha, length(text) AS chars FROM documents"""


def stemmed_tokens(spark, folder):
    words = docs(spark, folder).where("lang = 'en'").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).select("w", "n", plural_stem(F.col("w")).alias("stem")).where(
        "stem is not null").groupBy("stem").agg(F.sum("n").alias("uses"), F.count("*").alias("forms"))


_NOT = ", ".join(f"'{w}'" for w in K.PLURAL_EXCEPTIONS)
STEM_SQL = f"""
WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents WHERE lang = 'en'),
c AS (SELECT w, count(*) AS n FROM w GROUP BY w),
s AS (SELECT n, CASE
  WHEN regexp_full_match(w, '[A-Z]{{2,}}s') THEN w[:-2]
  WHEN length(w) < 4 OR NOT regexp_matches(w, '[a-z]') OR lower(w) IN ({_NOT}) THEN NULL
  WHEN lower(w) LIKE '%ies' AND length(w) > 4 THEN w[:-4] || CASE WHEN regexp_matches(w[-4:-4], '[A-Z]') THEN 'Y' ELSE 'y' END
  WHEN length(w) > 4 AND regexp_matches(lower(w), '(ches|shes|[sxz]es)$') THEN w[:-3]
  WHEN lower(w) LIKE '%s' AND NOT regexp_matches(lower(w), '[suioa]s$') THEN w[:-2] END AS stem FROM c)
SELECT stem, CAST(sum(n) AS BIGINT) AS uses, count(*) AS forms FROM s WHERE stem IS NOT NULL GROUP BY stem"""


def script_letters(spark, folder):
    runs = locate.script_runs(docs(spark, folder).withColumn("text", strip_bidi(F.col("text"))), r"À-ɏ")
    return runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.length("token")).alias("letters"))


SCRIPT_SQL = """
SELECT doc_id, len(r) AS runs, CAST(list_sum(list_transform(r, lambda x: length(x))) AS BIGINT) AS letters
FROM (SELECT doc_id, regexp_extract_all(text, '[\\x{c0}-\\x{24f}]+') AS r FROM documents) WHERE len(r) > 0"""


def case_drift(spark, folder):
    """Spellings of a word that differ from the one its document uses first."""
    hits = locate.find_spans(docs(spark, folder).where("lang = 'en'"), "[A-Za-z]+").where("length(token) > 4")
    key = F.regexp_replace(F.lower("token"), "s$", "")
    first = F.first("token").over(Window.partitionBy("doc_id", "key").orderBy("start"))
    return hits.withColumn("key", key).withColumn("first_form", first).where("token <> first_form").select(
        "doc_id", "start", "token", "first_form")


DRIFT_SQL = f"""
WITH h AS (SELECT doc_id, start, token, regexp_replace(lower(token), 's$', '') AS key
           FROM ({hits_sql("documents", "doc_id", "text", "[A-Za-z]+", "lang = 'en'")}) WHERE length(token) > 4)
SELECT doc_id, start, token, first_form FROM (
  SELECT *, first(token) OVER (PARTITION BY doc_id, key ORDER BY start) AS first_form FROM h) WHERE token <> first_form"""


def regions(spark, folder):
    """Table rows and quoted marks, whichever opens first."""
    found = spans.find_regions(docs(spark, folder), {"row": r"\|[^\n|]*\|", "emphasis": r"\*{3}[^*\n]*\*{3}"})
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


REGIONS_SQL = """
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\|[^\\n|]*\\||\\*{3}[^*\\n]*\\*{3}')) AS t FROM documents)
SELECT doc_id, CASE WHEN t LIKE '|%' THEN 'row' ELSE 'emphasis' END AS kind, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars
FROM r GROUP BY ALL"""

def longest_forms(spark, folder):
    """Capital runs and capital runs with their mark: the longer form takes the place."""
    frame = docs(spark, folder)
    forms = None
    for order, pattern in enumerate((CAPITALS, CAPITALS + "[,.]?!!")):
        hits = locate.find_spans(frame, pattern).select(
            "doc_id", "start", "end", (F.col("end") - F.col("start")).alias("form_length"), F.lit(order).alias("ord"))
        forms = hits if forms is None else forms.unionByName(hits)
    return spans.resolve_overlaps(forms).groupBy("doc_id", "ord").agg(F.count("*").alias("kept"), F.sum("start").alias("places"))


LONGEST_SQL = f"""
WITH a AS ({hits_sql("documents", "doc_id", "text", CAPITALS)}), b AS ({hits_sql("documents", "doc_id", "text", CAPITALS + "[,.]?!!")}),
k AS (SELECT doc_id, 1 AS ord, start FROM b UNION ALL SELECT doc_id, 0, start FROM a WHERE NOT EXISTS (
  SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.start = a.start))
SELECT doc_id, ord, count(*) AS kept, CAST(sum(start) AS BIGINT) AS places FROM k GROUP BY ALL"""

QUERIES = {
    "number_cluster_findings": Query(longs(number_cluster_findings, "start", "end", "line", "col"), NUMBERS_SQL, "LOC-1 LOC-4 TXT-14 RUL-12"),
    "bounded_capitals": Query(longs(bounded_capitals, "start"), BOUNDED_SQL, "LOC-2"),
    "line_lengths": Query(longs(line_lengths, "chars", "longest"), LINES_SQL, "LOC-3"),
    "located_marks": Query(longs(located_marks, "line", "last_col"), MARKS_SQL, "LOC-4"),
    "turn_provenance": Query(turn_provenance, PROVENANCE_SQL, "LOC-5"),
    "folded_offsets": Query(longs(folded_offsets, "raw"), FOLDED_SQL, "LOC-6"),
    "composed_offsets": Query(longs(composed_offsets, "start", "translated"), COMPOSED_SQL, "LOC-6"),
    "script_punctuation": Query(longs(script_punctuation, "line", "first_col"), PUNCTUATION_SQL, "RUL-5"),
    "merged_spans": Query(longs(merged_spans, "start", "end"), MERGED_SQL, "IVL-1"),
    "orders_inside": Query(orders_inside, INSIDE_SQL, "IVL-2"),
    "longest_forms": Query(longest_forms, LONGEST_SQL, "IVL-5"),
    "rule_findings": Query(longs(rule_findings, "start", "end", "line", "col"), WAIVED_SQL, "RUL-22 IVL-7"),
    "findings_report": Query(findings_report, REPORT_SQL, "REP-1"),
    "findings_top": Query(longs(findings_top, "place", "start"), TOP_SQL, "REP-2"),
    "findings_gate": Query(findings_gate, GATE_SQL, "REP-3"),
    "findings_rendered": Query(findings_rendered, RENDERED_SQL, "SNK-2"),
    "adjacent_capitals": Query(longs(adjacent_capitals, "start", "end"), ADJACENT_SQL, "IVL-6 RUL-10"),
    "masked_numbers": Query(longs(masked_numbers, "chars"), MASKED_SQL, "TXT-9"),
    "stemmed_tokens": Query(stemmed_tokens, STEM_SQL, "TXT-12"),
    "script_letters": Query(script_letters, SCRIPT_SQL, "TXT-7 TXT-11"),
    "case_drift": Query(longs(case_drift, "start"), DRIFT_SQL, "RUL-13"),
    "text_regions": Query(regions, REGIONS_SQL, "TXT-10"),
}
