"""References against files: encodings, dot segments, candidates and every state."""

from pyspark.sql import functions as F

from quire.operators import references


def test_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("/a/b.png", "/a/c.png", "/a/c.jpg", "/é x.png", "/d", "/d.png", "/a+b.png", "/one.png", "/one.png", "/.hid.png", "/never.png", None)], "path string")
    wanted = {
        "a/b.png": "resolved", "/a/b": "resolved", "/a/c": "ambiguous", "/a/c.png": "resolved", "%C3%A9%20x": "resolved", "/d": "ambiguous", "a+b": "resolved",
        "/x/../a/./b.png": "resolved", "../a/b.png": "refused", "/a/../../a/b.png": "refused", "/a/%2e%2e/%2E%2E/b": "refused", "%": "refused", "%4": "refused", "%zz": "refused",
        "%ff": "refused", "a%00": "refused", "http://h/a/b.png": "refused", "//h/a": "refused", "mailto:x": "refused", "one?x=/../..#y": "resolved", "one#?": "resolved",
        "": "missing", "/none": "missing", "/one.png.gif": "missing", "/.hid": "resolved", "a//b.png": "resolved", "%2561": "missing"}
    refs = spark.createDataFrame([(i, r) for i, r in enumerate([*wanted, None, "a/b.png"])], "id int, ref string").repartition(4)
    got = references.resolve(refs, files, [".png", ".jpg"]).collect()
    assert len(got) == len(wanted) + 2
    states = {r.ref: r.state for r in got}
    assert states.pop(None) == "refused" and states == wanted
    assert {r.ref: r.file for r in got}["/a/b"] == "/a/b.png" and {r.file for r in got if r.state != "resolved"} == {None}
    left = references.unreferenced(files, references.resolve(refs, files, [".png", ".jpg"]))
    assert {r.file for r in left.collect()} == {"/a/c.jpg", "/d", "/d.png", "/never.png"}


def test_base_and_empty(spark):
    files = spark.createDataFrame([("/p/q/x",)], "path string")
    refs = spark.createDataFrame([("x", "/p/q"), ("../q/x", "/p/q"), ("../../../x", "/p/q"), ("/x", "/p/q"), ("p/q/x", None)], "ref string, folder string")
    assert [r.state for r in references.resolve(refs, files, [], "folder").orderBy(F.col("folder").isNull(), "ref").collect()] == [
        "refused", "resolved", "missing", "resolved", "resolved"]
    assert references.resolve(refs.limit(0), files, []).count() == 0
    assert {r.state for r in references.resolve(refs, files.limit(0), [], "folder").collect()} == {"refused", "missing"}
