import os
import zlib

import pytest

from matchloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, path string"


def expected(rows):
    import hashlib

    holders = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000 and i is not None:
            holders[p] = max(holders.get(p, i), i)
    out = []
    for i, url, html in rows:
        p = (html or "").encode()
        h = holders.get(p)
        revisit = h is not None and h != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", h if revisit else None, url))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [1, 700, 1 << 20])
def test_round_trip(spark, split):
    big = "é<p>" * 400
    rows = [(1, "http://a", big), (2, None, big), (3, "c", None), (4, "d", ""), (5, "e", "x" * 999), (6, "f", "x" * 999),
            (None, "g", big), (7, "h", "y" * 1000), (7, "h", "y" * 1000), (8, "i", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 90)]
    pages = spark.createDataFrame([r + ("clash", "clash") for r in rows], SCHEMA).repartition(3)
    back = warc.round_trip(pages, 1000, split=max(split, 64)).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) for r in back], key=str)
    assert got == expected(rows)
    assert {bytes(r.payload).decode() for r in back if r.record_type == "response"} == {h or "" for _, _, h in rows}


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_cut_gives_each_record_once(tmp_path):
    payloads = [os.urandom(n) + warc.MAGIC + os.urandom(n) for n in (0, 10, 500, 3000)] + [zlib.compress(b"z" * 999, wbits=31)]
    members = []
    for k, p in enumerate(payloads):
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        import hashlib

        members.append(packer.compress(warc.record(f"urn:page:{k}", None, p, hashlib.sha1(p).hexdigest(), None)) + packer.flush())
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    size = path.stat().st_size
    for step in (7, 100, 1001, size):
        found = [warc.parsed(raw) for a in range(0, size, step) for raw in warc.members(f"file://{path}", a, min(a + step, size), chunk=128)]
        assert [f["record_id"] for f in found] == [f"urn:page:{k}" for k in range(len(payloads))]
        assert [f["payload"] for f in found] == payloads


def test_ranges_are_read_in_many_tasks(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://', id) AS url", "repeat(concat(id, sha2(cast(id AS string), 512)), 20) AS html")
    back = warc.round_trip(pages.repartition(3), 1000, split=4096)
    assert back.count() == 400 and back.selectExpr("spark_partition_id() AS task").distinct().count() > 8
