"""Evidence contracts: a case for every state, null keys and empty sides."""

import pytest

from quire.operators import witness


@pytest.fixture()
def frame(spark):
    return lambda rows, shape: spark.createDataFrame(rows, shape).repartition(3)


def states(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.state for r in df.collect()}


def test_proven(frame):
    expected = frame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("a", "y"), (None, None)], "key string, scope string")
    claims = frame([("a", "x", True, True), ("a", "x", True, False), ("b", "x", False, True), ("b", "x", None, True), ("c", "x", True, True), ("c", "x", True, True),
                    ("z", "x", True, True), ("d", "y", True, True), (None, None, True, True)], "key string, scope string, passed boolean, clean boolean")
    assert states(witness.proven(expected, claims), "key", "scope") == {
        ("a", "x"): "covered", ("b", "x"): "unproven", ("c", "x"): "repeated", ("d", "x"): "missing", ("a", "y"): "missing", ("z", "x"): "unknown", ("d", "y"): "unknown",
        (None, None): "covered"}
    assert set(states(witness.proven(expected, claims.limit(0)), "key", "scope").values()) == {"missing"}


def test_coverage_map(frame):
    units = frame([(i, "p") for i in range(7)] + [(None, None)], "id int, place string")
    mapped = frame([(0, "t", "p", False), (1, "t", "q", True), (2, "", "p", None), (3, None, "p", True), (4, "t", "p", False), (4, "u", "p", False), (9, "t", "p", False),
                    (None, "t", None, False)], "id int, target string, place string, retained boolean")
    assert states(witness.coverage_map(units, mapped), "id") == {
        0: "covered", 1: "moved", 2: "empty", 3: "retained", 4: "repeated", 5: "missing", 6: "missing", 9: "unknown", None: "covered"}


def test_receipts(frame):
    runs = frame([(i, f"--n {i}") for i in range(7)] + [(20, "a"), (20, "b")], "nonce int, arguments string")
    found = frame([(0, "--n 0", True, 0), (1, "--n 1", True, 2), (2, "--n 2", False, 0), (3, "--n", True, 0), (4, "--n 4", True, 0), (4, "--n 4", True, 0), (9, "x", True, 0),
                   (6, "--n 6", True, None), (20, "a", True, 0)], "nonce int, arguments string, completed boolean, code int")
    assert states(witness.receipts(runs, found), "nonce") == {
        0: "accepted", 1: "failed", 2: "unfinished", 3: "unbound", 4: "several", 5: "none", 6: "failed", 9: "stray", 20: "several"}


def test_membership(frame):
    checks = frame([("x", ["a", "b"]), ("x", ["a", "f", "n", "t"]), ("y", None), ("y", []), (None, ["k"])], "scope string, witnesses array<string>")
    passed = frame([("x", "a"), ("y", "f"), ("x", "t"), ("x", "idle")], "scope string, id string")
    events = frame([("x", "b"), ("x", "t"), (None, "k")], "scope string, id string")
    got = witness.membership(checks, passed, events)
    assert states(got, "scope", "witness") == {
        ("x", "a"): "member", ("x", "b"): "member", ("x", "f"): "foreign", ("x", "n"): "absent", ("x", "t"): "twice", (None, "k"): "member"}
    assert {r.witness: r.checks for r in got.collect()}["a"] == 2


def test_scanner_agreement(frame):
    reports = frame([("a", 0), ("b", 1), ("c", 0), ("d", 1), ("e", 2), ("f", 0), ("f", 1), ("g", 1), ("h", 1), ("i", None)], "report string, code int")
    findings = frame([("b", "r", 1), ("c", "r", 1), ("g", None, 3), ("h", "r", 1), ("h", "r", 2), ("h", "r", 3), ("q", "r", 1), ("b", "s", 9)], "report string, rule string, line int")
    assert states(witness.scanner_agreement(reports, findings, 2), "report") == {
        "a": "clean", "b": "found", "c": "contradiction", "d": "contradiction", "e": "error", "f": "contradiction", "g": "malformed", "h": "too-many", "i": "error", "q": "unknown"}


def test_census(frame):
    baseline = frame([(i,) for i in range(6)] + [(None,)], "id int")
    mapping = frame([(0, "t0", None), (1, "s", []), (2, "s", ["linux"]), (3, "t3", ["windows"]), (4, "t4", ["linux", "windows"]), (4, "t5", None), (9, "t9", None),
                     (5, None, None)], "id int, target string, platforms array<string>")
    assert states(witness.census(baseline, mapping, "linux"), "id") == {
        0: "placed", 1: "shared", 2: "shared", 3: "unavailable", 4: "duplicate", 5: "pending", 9: "unknown", None: "pending"}
    assert set(states(witness.census(baseline, mapping.limit(0), "linux"), "id").values()) == {"pending"}
