"""Located matches: every hit of a pattern with its offset, line, column and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrays import let, running_max, running_sum
from quire.functions.text import trimmed
from quire.operators.scan import asof
from quire.session import ensure_checkpoint_dir

BACK = 20
SHOWN = 60


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _last_newline(text: Column) -> Column:
    """One-based position of the last newline, 0 when there is none."""
    return F.when(
        F.contains(text, F.lit("\n")),
        F.length(text) - F.length(F.substring_index(text, "\n", -1)),
    ).otherwise(0)


def hit_offsets(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of ``start, end, token, before, after`` for every match, with no further context."""
    return _split_hits(text, pattern, group, located=False)


def hit_places(text: Column, pattern: str) -> Column:
    """Array of ``start, end`` for every match."""
    return _split_hits(text, pattern, 0, located=False, near=False)


def hit_array(text: Column, pattern: str, group: int = 0, context: bool = True) -> Column:
    """Array of located matches: start, end, token, line, col, before, after and, with ``context``,
    the excerpt, which costs more than all the rest.

    Two passes of the pattern give the matches and the gaps between them; running sums over
    those pieces give offsets and lines, and neighbouring pieces give the context, so the work
    grows with the text and not with hits times text. The pattern must not match the empty
    string. ``group`` selects what ``token`` holds; offsets always cover the whole match.
    """
    return _split_hits(text, pattern, group, located=True, context=context)


def _split_hits(text: Column, pattern: str, group: int, located: bool, context: bool = False, near: bool = True) -> Column:
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    tokens = F.regexp_extract_all(text, F.lit(pattern), group) if group else matches
    gaps = F.split(text, pattern, -1)
    pieces = F.struct(matches.alias("m"), gaps.alias("g"), tokens.alias("t"))

    def located_hits(p: Column) -> Column:
        lengths = F.zip_with(
            p["m"], F.slice(p["g"], F.lit(1), F.size(p["m"])), lambda m, g: F.length(m) + F.length(g)
        )

        def offsets(start_at: Column) -> Column:
            if not located:
                return F.transform(p["m"], lambda m, i: let(
                    F.get(start_at, i) + F.length(F.get(p["g"], i)),
                    lambda start: F.struct(
                        start.alias("start"),
                        (start + F.length(m)).alias("end"),
                        *([F.get(p["t"], i).alias("token"), _previous(p, i).alias("before"), _following(p, i).alias("after")] if near else []),
                    ),
                ))
            lines = running_sum(F.zip_with(
                p["m"], F.slice(p["g"], F.lit(1), F.size(p["m"])),
                lambda m, g: _newlines(m) + _newlines(g),
            ))
            # absolute one-based position of the last newline inside each piece
            breaks = running_max(F.transform(p["m"], lambda m, i: let(
                F.get(p["g"], i),
                lambda g: F.when(
                    F.contains(m, F.lit("\n")),
                    F.get(start_at, i) + F.length(g) + _last_newline(m),
                ).when(
                    F.contains(g, F.lit("\n")), F.get(start_at, i) + _last_newline(g)
                ).otherwise(0),
            )))
            tails = F.transform(p["m"], lambda m, i: F.right(
                F.concat(F.right(F.get(p["g"], i), F.lit(BACK)), m), F.lit(BACK)))
            heads = F.transform(p["m"], lambda m, i: F.left(
                F.concat(m, F.left(F.get(p["g"], i + 1), F.lit(SHOWN))), F.lit(SHOWN)))
            state = F.struct(lines.alias("nl"), breaks.alias("br"),
                             *([tails.alias("tail"), heads.alias("head")] if context else []))

            def fields(s: Column, m: Column, i: Column, h: Column) -> list[Column]:
                found = [
                    h["start"].alias("start"),
                    (h["start"] + F.length(m)).alias("end"),
                    F.get(p["t"], i).alias("token"),
                    (1 + F.get(s["nl"], i) + _newlines(h["gap"])).alias("line"),
                    (1 + h["start"] - F.when(
                        F.contains(h["gap"], F.lit("\n")),
                        F.get(start_at, i) + _last_newline(h["gap"]),
                    ).otherwise(F.get(s["br"], i))).alias("col"),
                    _previous(p, i).alias("before"),
                    _following(p, i).alias("after"),
                ]
                if context:
                    shown = F.substr(F.concat(_before(s, h, i), _after(s, i)), F.lit(1), F.lit(SHOWN))
                    found.append(trimmed(F.replace(shown, F.lit("\n"), F.lit(" "))).alias("excerpt"))
                return found

            return let(state, lambda s: F.transform(p["m"], lambda m, i: let(
                F.struct(
                    F.get(p["g"], i).alias("gap"),
                    (F.get(start_at, i) + F.length(F.get(p["g"], i))).alias("start"),
                ),
                lambda h: F.struct(*fields(s, m, i, h)),
            )))

        return let(running_sum(lengths), offsets)

    return let(pieces, located_hits)


def _previous(p: Column, i: Column) -> Column:
    """The character before match ``i``: the gap's last, or the last of the match it touches."""
    gap = F.right(F.get(p["g"], i), F.lit(1))
    return F.when(gap != "", gap).otherwise(F.coalesce(F.right(F.get(p["m"], i - 1), F.lit(1)), F.lit("")))


def _following(p: Column, i: Column) -> Column:
    """The character after match ``i``: the next gap's first, or the first of the match it touches."""
    gap = F.left(F.get(p["g"], i + 1), F.lit(1))
    return F.when(gap != "", gap).otherwise(F.coalesce(F.left(F.get(p["m"], i + 1), F.lit(1)), F.lit("")))


def _before(s: Column, h: Column, i: Column) -> Column:
    """The twenty characters before a hit."""
    near = F.right(h["gap"], F.lit(BACK))
    back = F.least(i, F.lit(BACK))
    return F.when(F.length(near) == BACK, near).otherwise(F.right(
        F.concat(F.array_join(F.slice(s["tail"], i - back + 1, back), ""), near), F.lit(BACK)))


def _after(s: Column, i: Column) -> Column:
    """A hit and what follows it, enough for the excerpt."""
    near = F.get(s["head"], i)
    return F.when(F.length(near) == SHOWN, near).otherwise(
        F.array_join(F.slice(s["head"], i + 1, F.lit(SHOWN)), ""))


def find_all(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text",
             group: int = 0) -> DataFrame:
    """Every match of ``pattern`` with offsets, line, column, neighbours and excerpt."""
    return docs.select(key, F.explode(hit_array(F.col(text), pattern, group)).alias("h")).select(
        key, "h.*")


def find_spans(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text",
               group: int = 0) -> DataFrame:
    """Every match with offsets and its neighbouring characters."""
    return docs.select(key, F.explode(hit_offsets(F.col(text), pattern, group)).alias("h")).select(
        key, "h.*")


def find_bounded(docs: DataFrame, pattern: str, before: str | None = None,
                 after: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Matches whose neighbouring characters are outside the given classes.

    The neighbours are tested after matching: a look-around inside the pattern would let the
    search resume at other places and find other candidates.
    """
    hits = find_spans(docs, pattern, key, text)
    if before:
        hits = hits.where(~F.col("before").rlike(f"[{before}]"))
    if after:
        hits = hits.where(~F.col("after").rlike(f"[{after}]"))
    return hits


def script_runs(docs: DataFrame, char_class: str, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Maximal runs of one character class."""
    return find_spans(docs, f"[{char_class}]+", key, text)


def line_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with its half-open offsets, the newline itself excluded."""
    lines = let(F.split(F.col(text), "\n", -1), lambda parts: let(
        running_sum(F.transform(parts, lambda p: F.length(p) + 1)),
        lambda at: F.transform(parts, lambda p, i: F.struct(
            (i + 1).alias("line"),
            F.get(at, i).alias("start"),
            (F.get(at, i) + F.length(p)).alias("end"),
        )),
    ))
    return docs.select(key, F.explode(lines).alias("l")).select(key, "l.*")


def locate(hits: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """Line and column of offsets found earlier, against a stored line index."""
    starts = index.select(key, F.col("start").alias("line_start"), "line")
    return (
        asof(hits.drop("line", "col"), starts, [key], "start", "line_start", ["line", "line_start"])
        .withColumn("col", F.col("start") - F.col("line_start") + 1)
        .drop("line_start")
    )


def provenance(hits: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Map offsets of an assembled text to the original source and offset."""
    placed = segments.select(key, F.col("start").alias("seg_start"), "src_path", "src_offset")
    return (
        asof(hits, placed, [key], "start", "seg_start", ["seg_start", "src_path", "src_offset"])
        .withColumn("src_start", F.col("src_offset") + F.col("start") - F.col("seg_start"))
        .drop("seg_start", "src_offset")
    )


def translate_offsets(hits: DataFrame, offset_map: DataFrame, key: str = "doc_id",
                      back: bool = False) -> DataFrame:
    """Move offsets across a piecewise map; inside a mapped piece they clamp to its start."""
    return _across(hits, offset_map, key, back).drop("a0", "a1", "b0", "b1")


def _across(hits: DataFrame, offset_map: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``translated`` and the piece at or before each offset."""
    a, b = ("to", "from") if back else ("from", "to")
    pieces = offset_map.select(
        key,
        F.col(f"{a}_start").alias("a0"), F.col(f"{a}_end").alias("a1"),
        F.col(f"{b}_start").alias("b0"), F.col(f"{b}_end").alias("b1"),
    )
    return (
        asof(hits, pieces, [key], "start", "a0", ["a0", "a1", "b0", "b1"])
        .withColumn(
            "translated",
            F.when(F.col("a0").isNull(), F.col("start"))
            .when(F.col("start") < F.col("a1"), F.col("b0"))
            .otherwise(F.col("start") - F.col("a1") + F.col("b1")),
        )
    )


def replacement_map(docs: DataFrame, pattern: str, kept: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The offset map of replacing every match of ``pattern`` by ``kept`` characters; matches must not be empty."""
    def pieces(hits: Column) -> Column:
        lost = running_sum(F.transform(hits, lambda h: h["end"] - h["start"] - kept))
        return let(lost, lambda gone: F.transform(hits, lambda h, i: F.struct(
            h["start"].alias("from_start"), h["end"].alias("from_end"), (h["start"] - F.get(gone, i)).alias("to_start"),
            (h["start"] - F.get(gone, i) + kept).alias("to_end"))))

    return docs.select(key, F.explode(let(hit_places(F.col(text), pattern), pieces)).alias("p")).select(key, "p.*")


def compose_maps(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """One piecewise map for two that follow each other: offsets of the raw text to those of the last one.

    A sweep over the breakpoints of both: those of ``second`` are moved back across ``first``, all are moved there across
    both, and between two neighbours the way is either a shift or stands still, inside a piece of either map. Where it stands
    still, and where a shift jumps, the new map has a piece. Pieces are ``from_start, from_end, to_start, to_end``,
    half-open and in order, and must not overlap within a map; a text with no piece in either has none. Null keys are keys.
    Both maps and the breakpoints are met several times, so they are written once: texts are searched once for each map.
    """
    ensure_checkpoint_dir(first.sparkSession)
    shape = [key, "from_start", "from_end", "to_start", "to_end"]
    first, second = first.select(*shape).checkpoint(), second.select(*shape).checkpoint()
    ends = lambda m: m.select(key, F.explode(F.array("from_start", "from_end")).alias("start"))
    back = translate_offsets(ends(second), first, key, back=True).select(key, F.col("translated").alias("start"))
    points = ends(first).unionByName(back).distinct()

    def moved(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
        held = _across(rows, table, key)
        inside = F.coalesce(F.col("start") < F.col("a1"), F.lit(False))
        return held.withColumns({name: inside, f"{name}_empty": inside & (F.col("b1") == F.col("b0"))}).drop("a0", "a1", "b0", "b1")

    once = moved(points, first, "still_a").withColumnsRenamed({"start": "raw", "translated": "start"})
    twice = moved(once, second, "still_b").select(
        key, "raw", F.col("translated").alias("to"), (F.col("still_a") | F.col("still_b")).alias("still"), F.coalesce("still_a_empty", F.lit(False)).alias("gone")).checkpoint()
    order = Window.partitionBy(key).orderBy("raw")
    near = twice.select("*", F.lead(F.struct("raw", "to")).over(order).alias("n"), F.lag(F.struct("raw", "to", "still")).over(order).alias("b"))
    # where a shift would have led to, from the breakpoint before or from the start of the text
    due = F.when(F.col("b").isNull(), F.col("raw")).when(F.col("b.still"), F.col("to")).otherwise(F.col("b.to") + F.col("raw") - F.col("b.raw"))
    piece = lambda a, b, c, d: [a.alias("from_start"), b.alias("from_end"), c.alias("to_start"), d.alias("to_end")]
    jumps = near.where(~F.col("still") & (due != F.col("to"))).select(key, *piece(F.col("raw"), F.col("raw"), due, F.col("to")))
    # stretches that stand still at one place are one piece, but for leading ones of which the first map leaves nothing
    opens = F.when(F.coalesce(~F.col("b.still") | (F.col("b.to") != F.col("to")), F.lit(True)), F.col("raw"))
    runs = near.where("still").withColumn("_run", F.max(opens).over(order))
    whole = runs.withColumn("_first", F.min(F.when(~F.col("gone"), F.col("raw"))).over(Window.partitionBy(key, "_run"))).withColumn(
        "_own", F.when(F.col("raw") >= F.col("_first"), F.col("_first")).otherwise(F.col("raw")))
    last = F.struct("raw", F.coalesce("n.raw", "raw").alias("f"), F.coalesce("n.to", "to").alias("t"))
    still = whole.groupBy(key, "_own", "to").agg(F.max(last).alias("l")).select(key, *piece(F.col("_own"), F.col("l.f"), F.col("to"), F.col("l.t")))
    return jumps.unionByName(still).checkpoint()
