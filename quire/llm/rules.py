"""Quality rules: a table of thresholds compiled into one projection.

Every statistic and every rule is a built-in column expression over the whole text, evaluated
where the row is scanned: no user function, no shuffle. A null text has no words and fails the
base rules; so does an empty one. Other columns are ignored, repeated rows give repeated results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.arrays import let
from quire.llm.shared import read_table

# fixed values: the contract's word and symbol classes
SPACES = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# fixed values: frequent function words of the four languages
STOP_WORDS = (
    "the be to of and that have with a in is it for was as on are by this from or an at "
    "le la les de des et un une du en que qui est pour dans par sur il elle "
    "der die das und in zu den mit von ist nicht ein eine auf für im dem es sich "
    "el los las y con por una se su para del al como más no lo"
).split()


class Rule(NamedTuple):
    """A text passes when ``low <= value <= high``; None leaves a side open."""

    name: str
    value: str
    low: float | None
    high: float | None


RULES = (
    Rule("length", "n_words", 50, 1_000_000),
    Rule("mean_word_chars", "mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", "symbols_per_word", None, 0.5),
    Rule("stop_word_share", "stop_share", 0.02, None),
    Rule("repeated_line_share", "dup_line_share", None, 0.6),
)

BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the array.

    Windows are sorted with their positions, so equal ones are neighbours; the positions of
    repeated windows, in order, then cover up to three words each.
    """
    def covered(places: Column) -> Column:
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, at: F.struct(
                (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")),
            lambda acc: acc["n"])

    def repeats(windows: Column) -> Column:
        marked = F.transform(windows, lambda x, i: F.when(
            (x["w"] == F.get(windows, i - 1)["w"]) | (x["w"] == F.get(windows, i + 1)["w"]), x["at"]))
        return F.sort_array(F.array_compact(marked))

    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(
            F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("at")))
    return let(F.sort_array(windows), lambda s: covered(repeats(s)))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of each text; ``doc_id`` and the counts only."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, f"[{SPACES}]+", -1), lambda w: w != "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = docs.select(
        "doc_id",
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.length(F.translate(body, BLANKS, "")).cast("bigint").alias("word_chars"),
        let(lines, lambda x: F.struct(
            F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        let(words, lambda w: F.struct(
            F.size(w).cast("bigint").alias("n"),
            repeated_words(w).cast("bigint").alias("repeat"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("stop"))).alias("words"))
    n = F.greatest(F.col("words.n"), F.lit(1))
    return counted.select(
        "doc_id", F.col("words.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.dup").cast("bigint").alias("n_dup_lines"),
        F.col("words.repeat").alias("n_repeat_words"),
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("words.stop") / n).alias("stop_share"),
        (F.col("lines.dup") / F.greatest(F.col("lines.n"), F.lit(1))).alias("dup_line_share"))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of ``statistics`` breaks."""
    def broken(rule: Rule) -> Column:
        value = F.col(rule.value)
        low = value < rule.low if rule.low is not None else F.lit(False)
        return low | (value > rule.high) if rule.high is not None else low

    return F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Statistics, the base verdict, the broken rules and whether the document is kept."""
    failed = (F.col("n_words") < BASE_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    return (
        statistics(docs)
        .withColumn("base_failed", failed)
        .withColumn("broken", compiled(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)))


def op10_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(read_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS w3 FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w3) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM r WHERE n > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS stop, len(ls) AS n_lines
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 50 AND 1000000
       AND word_chars / n_words BETWEEN 2.0 AND 20.0 AND n_symbols / n_words <= 0.5
       AND stop / n_words >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.6 AS kept
FROM b"""
