"""Nodes against a trie built turn by turn."""

import hashlib
import random
import zlib

import pytest

from quire.llm import trie
from tests.oracle import compare


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, mark(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], set()).add(c)
    out = []
    for node, held in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in held if built[c] == node)))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def test_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", trie.op13_trie, trie.OP13_SQL) > 300


def conversations(seed, n=70):
    rng = random.Random(seed)
    said = ["", None, "a", "bb", "é\n字", "<x>", "bb"]
    rows = []
    for c in rng.sample(range(-150, 420), n):
        rows += [(c, t, rng.choice(["user", "bot", None, ""]), rng.choice(said)) for t in range(rng.choice([0, 1, 2, 3, 4, 7, 9]))]
    for c in (0, 100, 200):
        rows = [r for r in rows if r[0] != c] + [(c, t, "user", "bb") for t in range(c // 100 + 2)]
    rows += [(c, t, "user", "bb") for c in range(1, 40) for t in range(5)]  # many equal conversations
    rows += [(55, None, "user", "first"), (55, None, "user", "first"), (55, 3, "bot", "x"), (55, 3, "bot", "w")]  # ties and repeats
    rows += [(333, t, "user", f"long {t % 3}") for t in range(200)] + [(None, 0, "user", "nobody")]
    rng.shuffle(rows)
    return rows


def nodes(df):
    return sorted(str((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)) for r in df.collect())


@pytest.mark.parametrize(("seed", "parts", "chunk"), [(1, 1, 20_000), (2, 6, 3)])
def test_random_conversations(spark, ranges, monkeypatch, seed, parts, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, depth int, a string").repartition(parts)
    assert nodes(trie.trie(frame)) == brute(rows)


def test_turnless_and_empty(spark):
    shape = "conv_id long, turn int, role string, text string"
    few = [(c, 0, "user", "hi") for c in range(1, 30)]  # no donor: those that lose their only turn are turnless
    assert nodes(trie.trie(spark.createDataFrame(few, shape))) == brute(few)
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    assert nodes(trie.trie(spark.createDataFrame([(lone, 0, "user", "hi")], shape))) == brute([(lone, 0, "user", "hi")])
    assert trie.trie(spark.createDataFrame([(None, 0, "u", "t")], shape)).count() == 0
    assert trie.trie(spark.createDataFrame([], shape)).count() == 0
