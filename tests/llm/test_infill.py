"""Outputs and restored texts against a plain reading of the rules."""

import hashlib
import random
import re

import pytest

from quire.llm import infill
from tests.oracle import compare


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), sha(f"7:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_docs():
    rng = random.Random(11)
    signs = ["a", "é", "字", "\n", " ", "<", "P>", "<S", ">", "\r", "😀"]
    docs = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "\n"), (203, "\n\n\nx"), (204, "a<M>b\nc"), (205, "<P"), (None, "no\nid\n"), (-7, "minus\nid")]
    docs += [(300, "one long line " * 900), (301, "line\n" * 5000), (302, "ü" * 9001 + "\n" + "z" * 9001)]
    return docs + [(3, "other text\nof id 3\n"), docs[5], docs[5], (None, "no\nid\n")]


def test_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", infill.op11_infill, infill.OP11_SQL) == 1000


@pytest.mark.parametrize(("parts", "piece"), [(1, 8192), (6, 16)])
def test_every_form_and_restored(spark, parts, piece):
    docs = some_docs()
    frame = spark.createDataFrame([(d, t, d, "x", 1) for d, t in docs], "doc_id long, text string, tag long, form string, src int").repartition(parts)
    pieces = infill.cut(frame, piece=piece)
    assert all(len(r.piece) <= piece + 3 for r in pieces.collect())
    got = sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256)
                           for r in infill.digests(pieces).collect())))
    want = [brute(d, t) for d, t in docs]
    assert got == sorted(str((*w[:5], sha(w[5]), sha(t or ""))) for w, (_, t) in zip(want, docs))
    assert sorted(map(str, ((r.doc_id, r.form, r.output) for r in infill.outputs(pieces).collect()))) == sorted(
        str((w[0], w[2], w[5])) for w in want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_rates(spark):
    docs = some_docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.form, r.output) for r in infill.outputs(infill.cut(frame, rate=40, spm=10)).collect())))
    assert got == sorted(str((w[0], w[2], w[5])) for w in (brute(d, t, 40, 10) for d, t in docs))


def test_empty_table(spark):
    assert infill.digests(infill.cut(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
