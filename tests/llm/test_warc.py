import gzip
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import warc
from tests.oracle import compare


def test_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", warc.op6_warc, warc.OP6_SQL) == 250


@pytest.fixture()
def archive():
    """Records, their bytes compressed and plain, and where each starts."""
    records = [warc.record(i, f"http://h/{i}", body, warc.digest(body), None, len(body)) for i, body in enumerate(
        [b"alpha" * 50, b"", "ünïcode WARC/1.1\r\n inside".encode(), random.Random(1).randbytes(5000), b"omega"])]
    return records


def run(data):
    found = list(warc.salvage(data))
    at = 0
    for _, a, b, _, _ in found:  # every byte once
        assert a == at and b > a
        at = b
    assert at == len(data)
    return [f[3]["warc-record-id"] for f in found if f[0] == "record"], [(f[1], f[2]) for f in found if f[0] == "gap"]


@pytest.mark.parametrize("packed", [False, True])
def test_whole_and_damaged(archive, packed):
    parts = [b"".join(warc.members(r)) if packed else r for r in archive]
    everything = [f"<urn:page:{i}>" for i in range(5)]
    assert run(b"".join(parts)) == (everything, [])
    for broken in range(5):  # a flipped byte costs its record only
        hurt = bytearray(parts[broken])
        hurt[len(hurt) // 2 if packed else 2] ^= 0x55  # plain headers have no checksum; their version line does as well
        ids, gaps = run(b"".join([*parts[:broken], bytes(hurt), *parts[broken + 1:]]))
        assert ids == [x for i, x in enumerate(everything) if i != broken]
        assert gaps == [(sum(map(len, parts[:broken])), sum(map(len, parts[:broken + 1])))]
    ids, gaps = run(b"junk" + parts[0] + b"\x1f\x8b\x08noise WARC/1.1\r\n" + parts[1] + parts[2][:-7])
    assert ids == everything[:2] and len(gaps) == 3
    assert run(b"") == ([], []) and run(b"nothing here")[0] == []
    mixed = parts[0] + (archive if packed else [b"".join(warc.members(r)) for r in archive])[1] + parts[3]
    assert run(mixed) == ([everything[0], everything[1], everything[3]], [])


def test_record_longer_than_a_member(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    body = random.Random(2).randbytes(4321)
    parts = warc.members(warc.record(7, None, body, warc.digest(body), None, len(body)))
    assert len(parts) > 4
    after = b"".join(warc.members(warc.record(8, "", b"x", warc.digest(b"x"), None, 1)))
    found = list(warc.salvage(b"".join(parts) + after))
    assert [f[4] for f in found] == [body, b"x"]
    lost = list(warc.salvage(b"".join(parts[:2] + parts[3:]) + after))
    assert [f[0] for f in lost] == ["gap", "record"]


def test_tables_nulls_and_damage_on_disk(spark, tmp_path):
    rows = [(5, "u", None, 1), (3, None, "", 2), (9, "u\r\nv", "same", 3), (8, "u", "same", 4), (8, "u", "same", 4), (1, "x", "big " * 10000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int")
    path = str(tmp_path / "a")
    warc.write_archives(pages, path)
    got = sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_archives(spark, path).collect())
    assert got == [(1, "response", 40000, None), (3, "response", 0, None), (5, "revisit", 0, 3), (8, "response", 4, None), (8, "response", 4, None), (9, "revisit", 4, 8)]
    files = sorted((tmp_path / "a").glob("part-*"), key=lambda p: -p.stat().st_size)
    assert gzip.decompress(files[0].read_bytes()).startswith(b"WARC/1.1")  # plain gzip reads it
    data = bytearray(files[0].read_bytes())
    data[40] ^= 1
    (tmp_path / "a" / ".crc").unlink(missing_ok=True)
    for crc in (tmp_path / "a").glob(".*.crc"):
        crc.unlink()
    files[0].write_bytes(bytes(data))
    kinds = warc.read_archives(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("to_byte") - F.col("from_byte")).alias("b")).collect()
    found = {r.kind: (r.n, r.b) for r in kinds}
    assert found["gap"][0] == 1 and found["record"][0] == 5
    assert sum(b for _, b in found.values()) == sum(f.stat().st_size for f in files)
    empty = str(tmp_path / "b")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).where("kind = 'record'").count() == 0
