"""Terminology, survival, page and graph queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.operators import graphs, locate, references, survival, terms
from quire.plans.base import Query, hits_sql, longs, table

WORD = "[A-Za-z]+"


def _terms(spark, folder):
    words = table(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("term"))
    return words.where("length(term) > 8")


def _hits(spark, folder):
    return terms.occurrences(table(spark, folder, "documents"), _terms(spark, folder))


T = "(SELECT DISTINCT lower(t) AS key FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM benchmark) WHERE length(t) > 8)"
H = f"(SELECT doc_id, start, line, col, token, lower(token) AS key FROM ({hits_sql('documents', 'doc_id', 'text', WORD)}) WHERE lower(token) IN (SELECT key FROM {T}))"


def term_hits(spark, folder):
    return _hits(spark, folder).select("doc_id", "key", "start", "line", "col")


def term_locations(spark, folder):
    return terms.first_locations(_hits(spark, folder), 2).select("doc_id", "key", "start", "place", "more_matches")


LOCATIONS_SQL = f"""SELECT doc_id, key, start, CAST(place AS INTEGER) AS place, more_matches FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY start) AS place, count(*) OVER (PARTITION BY doc_id, key) > 2 AS more_matches FROM {H}) WHERE place <= 2"""


def term_brief(spark, folder):
    return terms.brief(terms.first_locations(_hits(spark, folder), 64))


BRIEF_SQL = f"""SELECT doc_id, key, string_agg(line || ':' || col, ' ' ORDER BY line, col) AS locations, max(n) > 64 AS more_matches FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY start) AS place, count(*) OVER (PARTITION BY doc_id, key) AS n FROM {H})
WHERE place <= 64 GROUP BY ALL"""


def _pairs(spark, folder):
    words = F.split("p_type", " ")
    return table(spark, folder, "part").select(F.get(words, F.lit(0)).alias("source"), F.get(words, F.lit(1)).alias("output"), "p_size", "p_brand", "p_type")


def term_ambiguity(spark, folder):
    return terms.ambiguous(table(spark, folder, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("output")))


def layered_pairs(spark, folder):
    pairs = table(spark, folder, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("output"), "p_size")
    return terms.layered(pairs.where("p_size < 10"), pairs.where("p_size between 10 and 20"), pairs.where("p_size > 20"))


LAYERED_SQL = """SELECT p_brand AS source, p_type AS output, min(CASE WHEN p_size < 10 THEN 0 WHEN p_size <= 20 THEN 1 ELSE 2 END) AS layer FROM part GROUP BY ALL"""


def banned_forms(spark, folder):
    part = table(spark, folder, "part")
    return terms.expanded(part.select(F.col("p_brand").alias("source"), F.col("p_type").alias("form"),
                                      F.regexp_replace("p_name", " ", "| ").alias("deprecated")))


BANNED_SQL = """SELECT DISTINCT source, form FROM (SELECT p_brand AS source, p_type AS form FROM part
  UNION ALL SELECT p_brand, unnest(string_split(p_name, ' ')) FROM part) WHERE form <> ''"""


def corpus_drift(spark, folder):
    return terms.drift(_hits(spark, folder))


CORPUS_DRIFT_SQL = f"""SELECT key, count(*) AS forms, CAST(sum(n) AS BIGINT) AS uses, max_by(token, (n, token)) AS usual
FROM (SELECT key, token, count(*) AS n FROM {H} GROUP BY ALL) GROUP BY key"""


def term_usage(spark, folder):
    stated = _terms(spark, folder).groupBy(F.lower("term").alias("key")).agg(F.count("*").alias("n"))
    return terms.usage_gap(stated, _hits(spark, folder).groupBy("key").agg(F.count("*").alias("n")))


USAGE_SQL = f"""
WITH s AS (SELECT lower(t) AS key, count(*) AS stated FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM benchmark) WHERE length(t) > 8 GROUP BY 1),
f AS (SELECT key, count(*) AS found FROM {H} GROUP BY key)
SELECT s.key, stated, coalesce(found, 0) AS found, coalesce(found, 0) - stated AS gap FROM s LEFT JOIN f ON f.key = s.key"""

P = """SELECT {k} AS k, i - 1 AS place, array_to_string(ts[i:j], ' ') AS probe FROM (
  SELECT a.{k}, a.i, min(b.i) AS j, any_value(a.ts) AS ts FROM {t}_tok a JOIN {t}_tok b ON b.{k} = a.{k} AND b.i BETWEEN a.i AND a.i + 39
    AND b.c - a.c + length(a.w) >= 40 GROUP BY a.{k}, a.i)"""
TOK = """{t}_tok AS (SELECT {k}, ts, w, i, sum(length(w)) OVER (PARTITION BY {k} ORDER BY i) AS c
  FROM (SELECT {k}, ts, unnest(ts) AS w, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT {k}, regexp_extract_all(text, '[A-Za-z\\x{{c0}}-\\x{{24f}}]+') AS ts FROM {t})))"""


def benchmark_probes(spark, folder):
    windows = survival.probe_windows(table(spark, folder, "benchmark"), "item_id", "text", 40)
    return survival.distinct_probes(windows, "item_id").select("item_id", "place", F.md5("probe").alias("md5"))


PROBES_SQL = f"WITH {TOK.format(t='benchmark', k='item_id')} SELECT k AS item_id, CAST(min(place) AS INTEGER) AS place, md5(probe) AS md5 FROM ({P.format(t='benchmark', k='item_id')}) GROUP BY k, probe"


def passage_survival(spark, folder):
    return survival.surviving(table(spark, folder, "benchmark"), "item_id", table(spark, folder, "documents"), "doc_id", "text", 40)


SURVIVAL_SQL = f"""WITH {TOK.format(t='benchmark', k='item_id')}, {TOK.format(t='documents', k='doc_id')},
a AS (SELECT DISTINCT k AS item_id, probe FROM ({P.format(t='benchmark', k='item_id')})),
b AS (SELECT DISTINCT k AS doc_id, probe FROM ({P.format(t='documents', k='doc_id')}))
SELECT item_id, doc_id, count(*) AS found FROM a JOIN b USING (probe) GROUP BY ALL"""


def order_verdicts(spark, folder):
    """Benchmark probes against all documents: found as they are, or with characters or words reversed."""
    windows = survival.probe_windows(table(spark, folder, "benchmark"), "item_id", "text", 40)
    probes = survival.distinct_probes(windows, "item_id")
    return survival.verdict(survival.order_votes(probes, "item_id", table(spark, folder, "documents"), "doc_id", "text"))


VERDICTS_SQL = f"""WITH {TOK.format(t='benchmark', k='item_id')},
p AS (SELECT DISTINCT k AS item_id, probe FROM ({P.format(t='benchmark', k='item_id')})),
n AS (SELECT item_id, count(*) AS probes FROM p GROUP BY 1),
f AS (SELECT item_id, probe, replace(probe, ' ', '') AS a, reverse(replace(probe, ' ', '')) AS b, array_to_string(list_reverse(string_split(probe, ' ')), '') AS c FROM p),
d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\\x{{200e}}\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}]', '', 'g'), '\\s+', '', 'g') AS hay FROM documents),
v AS (SELECT item_id, doc_id, contains(hay, a) AS x, b <> a AND contains(hay, b) OR c <> a AND contains(hay, c) AS y FROM f, d
      WHERE contains(hay, a) OR contains(hay, b) OR contains(hay, c)),
g AS (SELECT item_id, doc_id, count(*) FILTER (WHERE x AND NOT y) AS forward, count(*) FILTER (WHERE y AND NOT x) AS backward FROM v GROUP BY ALL)
SELECT g.item_id, doc_id, probes, forward, backward, CASE WHEN backward > forward THEN 'visual' WHEN forward > backward THEN 'logical' ELSE 'inconclusive' END AS verdict,
  CASE WHEN backward > forward THEN 'failed' WHEN forward > backward THEN 'passed' ELSE 'inconclusive' END AS gate FROM g JOIN n ON n.item_id = g.item_id"""


def probe_budget(spark, folder):
    """What the windows of each document would cost, and whether that is within the stated limit."""
    return survival.probe_cost(table(spark, folder, "documents"), "doc_id", "text", 40)


PROBE_BUDGET_SQL = f"""WITH {TOK.format(t='documents', k='doc_id')},
w AS (SELECT a.doc_id, a.i, min(b.i) - a.i + 1 AS n FROM documents_tok a JOIN documents_tok b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 39
  AND b.c - a.c + length(a.w) >= 40 GROUP BY a.doc_id, a.i),
c AS (SELECT doc_id, sum(n) AS entries FROM w GROUP BY doc_id)
SELECT d.doc_id, len(ts) AS tokens, CAST(len(ts) + coalesce(entries, 0) AS BIGINT) AS steps, len(ts) + coalesce(entries, 0) <= 2000000 AS admitted
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z\\x{{c0}}-\\x{{24f}}]+') AS ts FROM documents) d LEFT JOIN c ON c.doc_id = d.doc_id"""


HIDDEN = "".join(f"<{t}(?:[ \t\n/][^>]*)?>.*?</{t}>|" for t in K.TEXT_EXCLUDED_TAGS) + "<!--.*?-->"
BREAKS = f"</?(?:{'|'.join(K.BREAK_TAGS)})(?:[ />][^>]*)?>"


def page_text(spark, folder):
    """Visible text of flat markup: hidden elements out, block tags give a space, blanks collapsed."""
    text = F.regexp_replace("html", f"(?is){HIDDEN}", "")
    text = F.regexp_replace(F.regexp_replace(text, f"(?i){BREAKS}", " "), "<[^>]*>", "")
    return table(spark, folder, "pages").select("page_id", F.trim(F.regexp_replace(text, "[ \t\n\r]+", " ")).alias("t")).select(
        "page_id", F.length("t").alias("chars"), F.md5("t").alias("md5"))


PAGE_SQL = f"""SELECT page_id, length(t) AS chars, md5(t) AS md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(html, '(?is){HIDDEN}', '', 'g'), '(?i){BREAKS}', ' ', 'g'), '<[^>]*>', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM pages)"""
KINDS = ("p", "a", "li", "h1", "div", "b")


def structure_census(spark, folder):
    return table(spark, folder, "pages").select("page_id", *[F.regexp_count("html", F.lit(f"(?i)<{k}[ >]")).alias(f"n_{k}") for k in KINDS])


CENSUS_SQL = "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '(?i)<{k}[ >]')) AS n_{k}" for k in KINDS) + " FROM pages"


def _references(spark, folder):
    found = F.regexp_extract_all("html", F.lit("""(?i)(?:href|src)="([^"]*)\""""), 1)
    return table(spark, folder, "pages").select("page_id", F.posexplode(found).alias("place", "ref"))


def page_references(spark, folder):
    return _references(spark, folder).groupBy("page_id", "ref").agg(F.count("*").alias("n"), F.min("place").alias("place"))


R = """(SELECT page_id, unnest(r) AS ref, unnest(range(0, len(r))) AS place FROM (SELECT page_id, regexp_extract_all(html, '(?i)(?:href|src)="([^"]*)"', 1) AS r FROM pages))"""


EXTENSIONS = [".html", ".htm", ".txt"]


def _files(spark, folder):
    """Pages as files: the first word of the title, with an extension by the form of the address."""
    word = F.regexp_extract("html", "<title>([^ <]+)", 1)
    kind = F.when(F.contains("url", F.lit("?")), ".html").when(F.contains("url", F.lit("#")), ".htm").when(F.col("url").endswith("/"), ".txt").otherwise("")
    return table(spark, folder, "pages").select(references.normal_path(F.concat(word, kind)).alias("path"))


def _resolved(spark, folder):
    base = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)?/", 1)
    pages = table(spark, folder, "pages").select("page_id", base.alias("base"))
    return references.resolve(_references(spark, folder).select("page_id", "ref").distinct().join(pages, "page_id"), _files(spark, folder), EXTENSIONS, "base")


def admitted_references(spark, folder):
    """References of pages, decoded and cleaned of dot segments, against pages as files with candidate extensions."""
    return _resolved(spark, folder).select("page_id", "ref", "path", "state", "file")


def reference_gaps(spark, folder):
    """References that no single file answers, and files that nothing refers to."""
    found = _resolved(spark, folder)
    bad = found.where("state <> 'resolved'").groupBy("ref", "state").agg(F.count("*").alias("pages"))
    return bad.unionByName(references.unreferenced(_files(spark, folder), found).select(
        F.col("file").alias("ref"), F.lit("unreferenced").alias("state"), F.lit(0).cast("bigint").alias("pages")))


_NORMAL = """list_reduce(list_concat([['/']], list_transform(list_filter(string_split({}, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x])),
  lambda acc, x: CASE WHEN x[1] <> '..' THEN list_concat(acc, x) WHEN len(acc) > 1 THEN acc[1:len(acc) - 1] ELSE ['out', 'out'] END)"""
A = f"""
r AS (SELECT DISTINCT x.page_id, ref, coalesce(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?/', 1), '') AS base FROM {R} x JOIN pages p ON p.page_id = x.page_id),
c AS (SELECT *, regexp_replace(ref, '[?#].*$', '') AS bare FROM r),
n AS (SELECT page_id, ref, CASE WHEN NOT regexp_matches(ref, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)') AND regexp_full_match(bare, '(?:[^%]|%[0-9A-Fa-f]{{2}})*') THEN
    {_NORMAL.format("CASE WHEN starts_with(bare, '/') THEN url_decode(bare) ELSE base || '/' || url_decode(bare) END")} END AS parts FROM c),
m AS (SELECT page_id, ref, CASE WHEN parts[1] = '/' THEN '/' || array_to_string(parts[2:], '/') END AS path FROM n),
f AS (SELECT DISTINCT '/' || array_to_string(parts[2:], '/') AS file FROM (SELECT {_NORMAL.format("regexp_extract(html, '<title>([^ <]+)', 1) || CASE WHEN contains(url, '?') THEN '.html' WHEN contains(url, '#') THEN '.htm' WHEN ends_with(url, '/') THEN '.txt' ELSE '' END")} AS parts FROM pages)),
h AS (SELECT path, count(*) AS n, min_by(file, length(file)) AS file FROM (SELECT DISTINCT path FROM m) JOIN f ON file = path
    OR NOT regexp_matches(path, '[^/][.][^./]+$') AND file IN (path || '.html', path || '.htm', path || '.txt') GROUP BY path),
s AS (SELECT page_id, ref, m.path, CASE WHEN m.path IS NULL THEN 'refused' WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state,
    CASE WHEN n = 1 THEN file END AS file FROM m LEFT JOIN h ON h.path = m.path)"""
ADMITTED_SQL = f"WITH {A} SELECT * FROM s"
GAPS_SQL = f"""WITH {A} SELECT ref, state, count(*) AS pages FROM s WHERE state <> 'resolved' GROUP BY ALL
UNION ALL SELECT file, 'unreferenced', 0 FROM f WHERE file NOT IN (SELECT file FROM s WHERE file IS NOT NULL)"""


def page_rules(spark, folder):
    """Root, print style, flipped artwork, bookmark and image rules of each page, by flat patterns.

    The bookmark rule: marks in a heading while nothing in the page turns bookmarks off.
    """
    html = F.col("html")
    found = {
        "html-root": F.regexp_count(html, F.lit("""(?i)<html[^>]*lang="[a-z]+\"""")) != 1,
        "print-css": F.contains(html, F.lit("<style")) & ~F.contains(html, F.lit("@media print")),
        "mirrored-image": html.rlike(r"scaleX\(\s*-1\s*\)"),
        "bookmark-guard": html.rlike("(?i)<h[1-6][^>]*>[^<]*[#*$%&|]{3}") & ~html.rlike("(?i)<meta[^>]*name=\"bookmark"),
        "missing-image": html.rlike("(?i)<img") & ~html.rlike("(?i)<img[^>]*src="),
        "code-direction": html.rlike("(?i)<(?:pre|code)") & ~html.rlike("(?i)<(?:pre|code)[^>]*dir=")}
    checks = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]))
    return table(spark, folder, "pages").select("page_id", F.explode(checks).alias("check"))


PAGE_RULES_SQL = """
SELECT page_id, unnest(list_filter([
  CASE WHEN len(regexp_extract_all(html, '(?i)<html[^>]*lang="[a-z]+"')) <> 1 THEN 'html-root' END,
  CASE WHEN contains(html, '<style') AND NOT contains(html, '@media print') THEN 'print-css' END,
  CASE WHEN regexp_matches(html, 'scaleX\\(\\s*-1\\s*\\)') THEN 'mirrored-image' END,
  CASE WHEN regexp_matches(html, '(?i)<h[1-6][^>]*>[^<]*[#*$%&|]{3}') AND NOT regexp_matches(html, '(?i)<meta[^>]*name="bookmark') THEN 'bookmark-guard' END,
  CASE WHEN regexp_matches(html, '(?i)<img') AND NOT regexp_matches(html, '(?i)<img[^>]*src=') THEN 'missing-image' END,
  CASE WHEN regexp_matches(html, '(?i)<(?:pre|code)') AND NOT regexp_matches(html, '(?i)<(?:pre|code)[^>]*dir=') THEN 'code-direction' END],
  lambda x: x IS NOT NULL)) AS "check" FROM pages"""


# fixed values: elements that have no end tag
VOID = "area base br col embed hr img input link meta source track wbr".split()
TAG = "</?[A-Za-z][A-Za-z0-9]*(?:[ \\t\\n/][^>]*)?>"


def _tags(spark, folder):
    """Every start and end tag of a page as a marker of its name; elements without an end tag open nothing."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    marks = locate.find_spans(pages, TAG).withColumn("name", F.lower(F.regexp_extract("token", "[A-Za-z][A-Za-z0-9]*", 0)))
    return marks.where(~F.col("name").isin(VOID) & ~F.col("token").endswith("/>")).select(
        "doc_id", "name", (~F.col("token").startswith("</")).alias("open"), "start", "end")


def paragraph_scopes(spark, folder):
    """Elements of all names, paired by one stack a page."""
    from quire.operators.spans import pair_scopes

    return pair_scopes(_tags(spark, folder)).groupBy("doc_id", "name").agg(
        F.count("*").alias("scopes"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.max("depth").alias("deepest"))


SCOPES_SQL = f"""
WITH RECURSIVE p AS (SELECT page_id, regexp_extract_all(html, '{TAG}') AS ms, string_split_regex(html, '{TAG}') AS gs FROM pages),
t AS (SELECT page_id, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM p),
a AS (SELECT page_id, i, ms[i] AS tag, length(array_to_string(gs[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) AS start FROM t),
m AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i, lower(regexp_extract(tag, '[A-Za-z][A-Za-z0-9]*')) AS name,
        NOT starts_with(tag, '</') AS opens, start, start + length(tag) AS stop FROM a
      WHERE NOT ends_with(tag, '/>') AND lower(regexp_extract(tag, '[A-Za-z][A-Za-z0-9]*')) NOT IN ({", ".join(f"'{v}'" for v in VOID)})),
r AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(n VARCHAR, e BIGINT)[]) AS stack, CAST(NULL AS VARCHAR) AS name,
        CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS depth FROM m
  UNION ALL
  SELECT m.page_id, m.i, CASE WHEN opens THEN list_append(stack, {{'n': m.name, 'e': m.stop}}) WHEN stack[-1].n = m.name THEN stack[1:len(stack) - 1] ELSE stack END,
    CASE WHEN NOT opens AND stack[-1].n = m.name THEN m.name END, stack[-1].e, m.start, len(stack) - 1
  FROM r JOIN m ON m.page_id = r.page_id AND m.i = r.i + 1)
SELECT page_id AS doc_id, name, count(*) AS scopes, CAST(sum(b - a) AS BIGINT) AS chars, max(depth) AS deepest FROM r WHERE name IS NOT NULL GROUP BY ALL"""


def scoped_marks(spark, folder):
    """Runs of stars inside the article of a page, however deep."""
    from quire.operators.spans import in_scope, pair_scopes

    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    marks = locate.find_spans(pages, "</?article>").select(
        "doc_id", F.lit("article").alias("name"), (~F.col("token").startswith("</")).alias("open"), "start", "end")
    hits = locate.find_spans(pages, r"[*]{3}").select("doc_id", "start")
    return in_scope(hits, pair_scopes(marks), ["article"]).groupBy("doc_id").agg(F.count("*").alias("hits"))


SCOPED_SQL = """
SELECT page_id AS doc_id, len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '[*]{3}')) AS hits FROM pages
WHERE regexp_matches(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '[*]{3}')"""


def nested_addresses(spark, folder):
    """Paths of pages and of their folders: which lies in which."""
    from quire.operators.spans import nested_paths

    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    both = table(spark, folder, "pages").select(F.explode(F.array(path, F.regexp_replace(path, "/[^/]*$", ""))).alias("path"))
    return nested_paths(both.where("path <> ''"))


NESTED_SQL = """
WITH u AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS p FROM pages),
p AS (SELECT DISTINCT path FROM (SELECT unnest([p, regexp_replace(p, '/[^/]*$', '')]) AS path FROM u) WHERE path <> ''),
k AS (SELECT path, rtrim(lower(path), '/') AS f FROM p)
SELECT a.path AS outer_path, b.path AS inner_path FROM k a JOIN k b ON a.path <> b.path
  AND (starts_with(b.f, a.f || '/') OR a.f = b.f AND a.path < b.path)"""


def _part_edges(spark, folder):
    """Parts on neighbouring lines of an order, all of them."""
    items = table(spark, folder, "lineitem")
    nxt = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src")).join(nxt, ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


E = """e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  AND b.l_linenumber = a.l_linenumber + 1)"""


def cyclic_parts(spark, folder):
    """Parts on a cycle of neighbouring lines, with the least part of their component."""
    return graphs.components(_part_edges(spark, folder))


C = f"""{E}, w AS (SELECT src AS a, dst AS b FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON w.b = e.src),
c AS (SELECT x.a AS node, min(x.b) AS component FROM w x JOIN w y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""
CYCLIC_SQL = f"WITH RECURSIVE {C} SELECT node, component FROM c"


def part_cycles(spark, folder):
    """A shortest cycle through the least part of each component."""
    edges = graphs.plain(_part_edges(spark, folder))
    found = graphs.cycles(edges, graphs.components(edges, written=True), written=True)
    return found.select("component", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


PART_CYCLES_SQL = f"""
WITH RECURSIVE {C}, i AS (SELECT src, dst, a.component FROM e JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.component = b.component),
d(component, node, depth) USING KEY (component, node) AS (SELECT DISTINCT component, component, 0 FROM c
  UNION SELECT i.component, i.dst, min(d.depth) + 1 FROM d JOIN i ON i.component = d.component AND i.src = d.node
    LEFT JOIN recurring.d o ON o.component = i.component AND o.node = i.dst WHERE o.node IS NULL GROUP BY i.component, i.dst),
p AS (SELECT i.component, i.dst, min(i.src) AS src FROM i JOIN d x ON x.component = i.component AND x.node = i.src
  JOIN d y ON y.component = i.component AND y.node = i.dst AND x.depth = y.depth - 1 GROUP BY ALL),
l AS (SELECT i.component, min((d.depth, i.src)) AS e FROM i JOIN d ON d.component = i.component AND d.node = i.src WHERE i.dst = i.component GROUP BY i.component),
k AS (SELECT component, e[2] AS here, CAST(e[2] AS VARCHAR) AS cycle FROM l
  UNION ALL SELECT k.component, p.src, p.src || ',' || k.cycle FROM k JOIN p ON p.component = k.component AND p.dst = k.here WHERE k.here <> k.component)
SELECT component, cycle FROM k WHERE here = component"""


def reachable_parts(spark, folder):
    """Parts reached from the least part of each brand, with the fewest steps."""
    return graphs.closure(_part_edges(spark, folder), table(spark, folder, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("node")))


REACH_SQL = f"""
WITH RECURSIVE {E}, r(node, depth) USING KEY (node) AS (SELECT DISTINCT min(p_partkey), 0 FROM part GROUP BY p_brand
  UNION SELECT e.dst, min(r.depth) + 1 FROM r JOIN e ON r.node = e.src LEFT JOIN recurring.r o ON o.node = e.dst WHERE o.node IS NULL GROUP BY e.dst)
SELECT node, depth FROM r"""


def _contents(spark, folder):
    """What a region holds: its nations, their customers, their orders, the parts of these, in order."""
    name = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    rows = [("nation", name("r", "n_regionkey"), name("n", "n_nationkey"), F.col("n_nationkey")),
            ("customer", name("n", "c_nationkey"), name("c", "c_custkey"), F.col("c_custkey")),
            ("orders", name("c", "o_custkey"), name("o", "o_orderkey"), F.col("o_orderkey")),
            ("lineitem", name("o", "l_orderkey"), name("p", "l_partkey"), F.col("l_linenumber") * F.lit(1 << 40) + F.col("l_partkey"))]
    out = None
    for source, src, dst, order in rows:
        part = table(spark, folder, source).select(src.alias("src"), dst.alias("dst"), order.cast("bigint").alias("ord"))
        out = part if out is None else out.unionByName(part)
    return graphs.ordered_closure(out, table(spark, folder, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node")))


def region_contents(spark, folder):
    """Everything below a region in the order of first visits, with the ways that lead there."""
    way = F.array_join(F.transform("first", lambda x: x.cast("string")), "/")
    return _contents(spark, folder)[0].select("root", "node", way.alias("first"), F.col("visits").cast("bigint").alias("visits"), "depth")


def region_closures(spark, folder):
    """The gate of each region's closure: 32 levels and 128 visits are stated, and nothing is cut."""
    return graphs.closure_gate(_contents(spark, folder)[1], 32, 128).select(
        "root", "cyclic", "sources", F.col("visits").cast("bigint").alias("visits"), "deepest", "state")


W = """s AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, CAST(n_nationkey AS BIGINT) AS ord FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, l_linenumber * 1099511627776 + l_partkey FROM lineitem),
w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, CAST([] AS BIGINT[]) AS way FROM region
  UNION ALL SELECT w.root, s.dst, list_append(w.way, s.ord) FROM w JOIN s ON s.src = w.node)"""
CONTENTS_SQL = f"""WITH RECURSIVE {W}
SELECT root, node, array_to_string(min(way), '/') AS first, count(*) AS visits, CAST(min(len(way)) AS INTEGER) AS depth FROM w GROUP BY ALL"""
CLOSURES_SQL = f"""WITH RECURSIVE {W}
SELECT root, false AS cyclic, count(DISTINCT node) AS sources, count(*) AS visits, CAST(max(len(way)) AS INTEGER) AS deepest,
  CASE WHEN max(len(way)) + 1 > 32 THEN 'too-deep' WHEN count(*) > 128 THEN 'too-many' ELSE 'ok' END AS state FROM w GROUP BY root"""

QUERIES = {
    "term_hits": Query(longs(term_hits, "start", "line", "col"), f"SELECT doc_id, key, start, line, col FROM {H}", "TRM-3"),
    "term_locations": Query(longs(term_locations, "start"), LOCATIONS_SQL, "TRM-4"),
    "term_brief": Query(term_brief, BRIEF_SQL, "TRM-5"),
    "term_ambiguity": Query(term_ambiguity, "SELECT lower(p_brand) AS key, count(DISTINCT p_type) AS outputs FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1", "TRM-6"),
    "layered_pairs": Query(layered_pairs, LAYERED_SQL, "TRM-7 TRM-8"),
    "banned_forms": Query(banned_forms, BANNED_SQL, "TRM-2"),
    "corpus_drift": Query(corpus_drift, CORPUS_DRIFT_SQL, "TRM-10"),
    "term_usage": Query(term_usage, USAGE_SQL, "TRM-11"),
    "benchmark_probes": Query(benchmark_probes, PROBES_SQL, "ORD-1 ORD-2"),
    "probe_budget": Query(probe_budget, PROBE_BUDGET_SQL, "ORD-3"),
    "order_verdicts": Query(order_verdicts, VERDICTS_SQL, "ORD-4 ORD-5 ORD-6"),
    "passage_survival": Query(passage_survival, SURVIVAL_SQL, "ORD-7"),
    "page_text": Query(longs(page_text, "chars"), PAGE_SQL, "TXT-1"),
    "structure_census": Query(longs(structure_census, "n_p", "n_a", "n_li", "n_h1", "n_div", "n_b"), CENSUS_SQL, "TXT-3"),
    "page_references": Query(page_references, f"SELECT page_id, ref, count(*) AS n, CAST(min(place) AS INTEGER) AS place FROM {R} GROUP BY ALL", "TXT-4"),
    "admitted_references": Query(admitted_references, ADMITTED_SQL, "TXT-5"),
    "reference_gaps": Query(reference_gaps, GAPS_SQL, "RUL-20"),
    "page_rules": Query(page_rules, PAGE_RULES_SQL, "RUL-14 RUL-15 RUL-16 RUL-17 RUL-19"),
    "paragraph_scopes": Query(longs(paragraph_scopes, "deepest"), SCOPES_SQL, "IVL-4"),
    "scoped_marks": Query(scoped_marks, SCOPED_SQL, "IVL-3"),
    "nested_addresses": Query(nested_addresses, NESTED_SQL, "IVL-8"),
    "cyclic_parts": Query(cyclic_parts, CYCLIC_SQL, "REC-7"),
    "part_cycles": Query(part_cycles, PART_CYCLES_SQL, "REC-7"),
    "reachable_parts": Query(reachable_parts, REACH_SQL, "REC-21"),
    "region_contents": Query(region_contents, CONTENTS_SQL, "REC-21"),
    "region_closures": Query(region_closures, CLOSURES_SQL, "REC-21"),
}
