"""Report tables over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_findings(findings: DataFrame) -> DataFrame:
    """Findings per check and level, errors before warnings, then by check."""
    return group_counts(findings.groupBy("check", "level").agg(F.count("*").alias("findings")))


def group_counts(counts: DataFrame) -> DataFrame:
    """The same from ``check, level, findings``, one row for each check and level, a few."""
    place = Window.orderBy(F.col("level") != "error", "check", "level")
    return counts.withColumn("place", F.row_number().over(place))


def top_per_group(findings: DataFrame, group: list[str], order: list[str], limit: int, totals: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` rows of each group, null groups included, with how many more there are.

    The rank filter is applied before the shuffle as well as after it, so a group that holds most
    of the rows sends ``limit`` of them from each task. ``order`` should be total. Without ``totals`` of
    each group, one row ``*group, total``, the input is read twice; hand a dear one over as a written table.
    """
    final = Window.partitionBy(*group).orderBy(*order)
    kept = findings.withColumn("place", F.row_number().over(final)).where(F.col("place") <= limit)
    if totals is None:
        totals = findings.groupBy(*group).agg(F.count("*").alias("total"))
    totals = totals.withColumnsRenamed({g: f"_g_{g}" for g in group})
    same = [kept[g].eqNullSafe(totals[f"_g_{g}"]) for g in group]
    return kept.join(totals, same).drop(*[f"_g_{g}" for g in group]).withColumn(
        "more", F.greatest(F.col("total") - limit, F.lit(0)))


def gate(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row of totals; fails on errors, or on warnings too when strict."""
    return gate_counts(findings.select("level", F.lit(1).cast("bigint").alias("findings")), strict)


def gate_counts(counts: DataFrame, strict: bool = False) -> DataFrame:
    """The same from ``level, findings``."""
    of = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("findings"))), F.lit(0).cast("bigint"))
    totals = counts.agg(of("error").alias("errors"), of("warn").alias("warnings"))
    bad = (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0))
    return totals.withColumn("failed", bad)


def escape_cell(value: Column) -> Column:
    """Text made safe for a markdown table cell."""
    # fixed values: the escaped characters and their replacements
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                      ("'", "&#x27;"), ("|", "&#124;"), ("\n", " "), ("\r", " ")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def render_locations(findings: DataFrame, columns: list[str], order: list[str], limit: int,
                     plain: tuple[str, ...] = ("line",)) -> DataFrame:
    """The first ``limit`` findings as escaped table lines, then one line that says how many are
    not shown. Null cells are empty; ``plain`` columns stand without code marks."""
    cells = [F.coalesce(escape_cell(F.col(c).cast("string")), F.lit("")) for c in columns]
    marked = [cell if c in plain else F.concat(F.lit("<code>"), cell, F.lit("</code>"))
              for c, cell in zip(columns, cells)]
    # at most ``limit`` rows meet in the numbering
    shown = findings.orderBy(*order).limit(limit).withColumn(
        "place", F.row_number().over(Window.orderBy(*order))).select(
        "place", F.concat(F.lit("| "), F.concat_ws(" | ", *marked), F.lit(" |")).alias("line_text"))
    rest = findings.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("n")).select(
        F.lit(limit + 1).alias("place"), F.concat(F.col("n").cast("string"), F.lit(" more")).alias("line_text"))
    return shown.unionByName(rest)
