"""Interval operators over half-open spans of a text or of any ordered axis."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import let
from quire.operators.scan import asof, running


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end",
                width: int | None = None) -> DataFrame:
    """Union of overlapping or touching spans; empty spans are dropped.

    A span opens a new island when it starts after every earlier end. The island is named by
    its opening start, which a second running maximum spreads over the rows, so no sequence
    number is needed. Spans with one start are first reduced to the longest. ``width`` scans positions in ranges for keys too large for one task.
    """
    live = spans.where(F.col(start) < F.col(end)).groupBy(*keys, start).agg(
        F.max(end).alias(end), F.count("*").alias("pieces"))
    bucket = F.floor(F.col(start) / width) if width else None
    reached = running(live, keys, [start], {"_reach": ("max", F.col(end))}, bucket, inclusive=False)
    opened = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start))
    islands = running(reached, keys, [start], {"_island": ("max", opened)}, bucket)
    return (
        islands.groupBy(*keys, "_island").agg(F.max(end).alias(end), F.sum("pieces").alias("pieces"))
        .withColumnRenamed("_island", start)
    )


def with_membership(hits: DataFrame, merged: DataFrame, keys: list[str], at: str = "start",
                    width: int | None = None) -> DataFrame:
    """Add ``inside``: whether a position lies in one of the already merged spans."""
    spans = merged.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    found = asof(hits, spans, keys, at, "_s", ["_s", "_e"], width)
    return found.withColumn(
        "inside", F.coalesce(F.col(at) < F.col("_e"), F.lit(False))).drop("_s", "_e")


def inside_spans(hits, merged, keys, at="start", width=None) -> DataFrame:
    """Positions covered by merged spans."""
    return with_membership(hits, merged, keys, at, width).where("inside").drop("inside")


def outside_spans(hits, merged, keys, at="start", width=None) -> DataFrame:
    """Positions covered by no merged span."""
    return with_membership(hits, merged, keys, at, width).where("not inside").drop("inside")


def in_scope(hits: DataFrame, scopes: DataFrame, names: list[str], key: str = "doc_id",
             keep: bool = True) -> DataFrame:
    """Positions inside any scope of the given names, however deeply nested."""
    named = merge_spans(scopes.where(F.col("name").isin(names)), [key])
    return (inside_spans if keep else outside_spans)(hits, named, [key])


def pair_scopes(markers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pair openers and closers with one stack a key, whatever their names.

    Input rows are ``name, open, start, end`` of each marker. An opener is pushed; a closer takes
    the top of the stack if that has its name and is ignored otherwise, so a crossing closes
    nothing and surplus closers do no harm. An opener that is never closed gives no scope and
    stays in the way of those below it. ``start, end`` is what lies between the two markers, ``depth`` the
    number of scopes open around it. Markers are sorted by their place and streamed through the stack:
    a text's markers cost one step each and no more memory than its open scopes. Markers with
    a null name or place are left out; of equal places the shorter marker comes first; a null key is a key.
    """
    kind = markers.schema[key].dataType
    shape = f"`{key}` {kind.simpleString()}, name string, start long, end long, depth int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, stack, begun = None, [], False
        for batch in batches:
            rows = []
            for owner, name, opens, start, end in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if owner != of or not begun:
                    of, stack, begun = owner, [], True
                if opens:
                    stack.append((name, end))
                elif stack and stack[-1][0] == name:
                    rows.append((owner, name, stack.pop()[1], start, len(stack)))
            if rows:
                owners, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(owners, batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(
                        rest, (pa.string(), pa.int64(), pa.int64(), pa.int32()))]], names=[key, "name", "start", "end", "depth"])

    placed = markers.where("name is not null and start is not null").select(
        key, "name", "open", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    return placed.repartition(key).sortWithinPartitions(key, "start", "end", "open", "name").mapInArrow(run, shape)


def overlap_islands(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``island``: hits that overlap directly or through others share one."""
    order = ["start", "end", *sorted(c for c in hits.columns if c not in (key, "start", "end"))]
    reached = running(hits, [key], order, {"_reach": ("max", F.col("end"))}, inclusive=False)
    opened = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.col("start"))
    return running(reached, [key], order, {"island": ("max", opened)}).drop("_reach")


def resolve_overlaps(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Longest form first, then rule order, then position; a kept hit excludes every hit that
    overlaps it.

    ``form_length`` and ``ord`` carry the precedence. Hits are cut into overlap islands first;
    the greedy choice then runs inside each island, where a hit standing alone is kept as it is.
    """
    islands = overlap_islands(hits, key)
    columns = [c for c in islands.columns if c not in (key, "island")]
    ranked = F.struct(
        (-F.col("form_length")).alias("_rank"), F.col("ord").alias("_o"),
        F.col("start").alias("_s"), *columns)
    grouped = islands.groupBy(key, "island").agg(F.array_sort(F.collect_list(ranked)).alias("_h"))

    def free(kept: Column, h: Column) -> Column:
        return ~F.exists(kept, lambda k: (k["start"] < h["end"]) & (h["start"] < k["end"]))

    chosen = F.when(F.size("_h") == 1, F.col("_h")).otherwise(F.aggregate(
        "_h", F.slice("_h", F.lit(1), F.lit(1)),
        lambda kept, h: F.when(free(kept, h), F.concat(kept, F.array(h))).otherwise(kept)))
    return grouped.select(key, F.explode(chosen).alias("_k")).select(
        key, *[F.col(f"_k.{c}").alias(c) for c in columns])


def adjacent_gap(spans: DataFrame, docs: DataFrame, pattern: str, key: str = "doc_id",
                 text: str = "text", cleaning: dict[str, str] | None = None) -> DataFrame:
    """Neighbouring spans whose gap, cleaned by literal replacements, matches a pattern; ``start``
    is where the gap begins.

    The spans of a text are gathered to the text instead of repeating the text per span.
    """
    ordered = spans.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    gaps = F.filter(
        F.transform("_s", lambda s, i: F.struct(
            s["end"].alias("start"), F.get("_s", i + 1)["start"].alias("end"))),
        lambda g: g["end"] > g["start"])
    rows = docs.select(key, text).join(ordered, key).select(
        key, F.explode(F.transform(gaps, lambda g: F.struct(
            g["start"].alias("start"), g["end"].alias("end"),
            F.substr(F.col(text), g["start"] + 1, g["end"] - g["start"]).alias("gap")))
        ).alias("g")).select(key, "g.*")
    cleaned = F.col("gap")
    for raw, plain in (cleaning or {}).items():
        cleaned = F.replace(cleaned, F.lit(raw), F.lit(plain))
    return rows.where(cleaned.rlike(pattern))


def apply_waivers(findings: DataFrame, waivers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drop findings waived on their own or the previous line, by check or by ``all``. Waivers that
    stand inside a protected span (``protected``, where the column exists) are ignored."""
    live = waivers.where("not protected") if "protected" in waivers.columns else waivers
    reach = live.select(
        key, F.explode(F.array("line", F.col("line") + 1)).alias("line"),
        F.col("check").alias("_w")).distinct()
    named = reach.withColumnRenamed("_w", "check")
    every = reach.where("_w = 'all'").select(key, "line")
    return findings.join(named, [key, "line", "check"], "left_anti").join(
        every, [key, "line"], "left_anti")


def nested_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Pairs of different paths where one is an ancestor of the other, or equal but for case and
    closing slashes; ``/`` is an ancestor of every rooted path.

    Each path is exploded into itself and its ancestors and joined by equality. Of two equal paths
    the smaller one is the outer.
    """
    folded = lambda c: F.lower(F.rtrim(F.col(c), F.lit("/")))
    named = paths.select(F.col(column).alias("inner_path")).where("inner_path is not null").distinct()
    ancestors = named.select("inner_path", folded("inner_path").alias("_own"), F.explode(
        let(F.split(folded("inner_path"), "/"), lambda p: F.transform(
            p, lambda _, i: F.array_join(F.slice(p, F.lit(1), i + 1), "/")))).alias("_k"))
    outer = named.select(F.col("inner_path").alias("outer_path"), folded("inner_path").alias("_k"))
    return ancestors.join(outer, "_k").where(
        (F.col("_k") != F.col("_own")) | (F.col("outer_path") < F.col("inner_path"))).select(
        "outer_path", "inner_path")


def mask_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Replace the text of spans with spaces; length and line breaks stay as they were."""
    merged = merge_spans(spans, [key]).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    joined = docs.join(merged, key, "left")

    def cut(t: Column) -> Column:
        pieces = F.transform("_s", lambda s, i: F.concat(
            F.substr(t, F.coalesce(F.get("_s", i - 1)["end"], F.lit(0)) + 1,
                     s["start"] - F.coalesce(F.get("_s", i - 1)["end"], F.lit(0))),
            F.regexp_replace(F.substr(t, s["start"] + 1, s["end"] - s["start"]), r"[^\r\n]", " ")))
        rest = F.substr(t, F.element_at("_s", -1)["end"] + 1, F.length(t))
        return F.concat(F.array_join(pieces, ""), rest)

    masked = F.when(F.col("_s").isNull(), F.col(text)).otherwise(let(F.col(text), cut))
    return joined.withColumn(text, masked).drop("_s")


def find_regions(docs: DataFrame, rules: dict[str, str], key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Regions declared by paired-delimiter patterns. Whichever region opens first wins: all kinds
    are branches of one alternation, and a mark inside another region opens nothing."""
    from quire.operators.locate import hit_offsets

    either = "|".join(f"(?:{p})" for p in rules.values())
    hits = docs.select(key, F.explode(hit_offsets(F.col(text), either)).alias("h")).select(key, "h.*")
    kind = F.coalesce(*[F.when(F.col("token").rlike(f"^(?:{p})$"), F.lit(k)) for k, p in rules.items()])
    return hits.select(key, kind.alias("kind"), "start", "end", "token")
