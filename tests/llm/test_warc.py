import base64
import hashlib
import io
import os

from metaloom.llm import warc
from metaloom.llm.common import new_dir


def rows():
    out = [(i, f"http://x/{i}", f"<p>{i % 9} é</p>" * (i % 5)) for i in range(200)]
    out += [(300, None, None), (301, "u", ""), (302, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "<p>only</p>"), (3, "again", "<p>3 é</p>" * 3), (3, "http://x/3", "<p>3 é</p>" * 3), (10**12, "far", "<b>")]
    return out


def brute(data):
    first, seen, out = {}, set(), []
    for i, _, h in data:
        h = h or ""
        if i is not None:
            first[h] = min(first.get(h, i), i)
    for i, u, h in sorted(data, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        h = h or ""
        is_first = i is not None and first.get(h) == i and (i, h) not in seen
        seen.add((i, h))
        alone = sum((x or "") == h for _, _, x in data) == 1
        response = is_first or alone
        out.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if response else "revisit", None if response else first.get(h)))
    return sorted(out, key=str)


def test_round_trip_and_determinism(spark):
    data = rows()
    pages = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, shard int")
    s = warc.Settings(file_bytes=1500, shard_bytes=3000)
    folders = [new_dir(spark, "warc"), new_dir(spark, "warc")]
    manifests = [warc.write(p, f, s) for p, f in zip((pages.repartition(5), pages.repartition(2)), folders, strict=True)]
    listed = [sorted(map(tuple, m.collect())) for m in manifests]
    assert listed[0] == listed[1] and len(listed[0]) > 3
    here = folders[0].removeprefix("file://")
    assert sorted(x for x in os.listdir(here) if x.endswith("warc.gz")) == [r[0] for r in listed[0]]
    got = warc.read(manifests[0], folders[0])
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()], key=str) == brute(data)
    texts = {r.payload for r in got.collect() if r.payload is not None}
    assert texts == {h or "" for _, _, h in data}


def test_small_payloads_and_empty_table(spark):
    data = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark, pages, warc.Settings(revisit_from=5)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_a_second_reader_agrees():
    s = warc.Settings()
    one = warc.record_of(7, "http://x y", b"abc", warc.base32(b"abc"), None, False, s)
    two = warc.record_of(None, "", b"abc", warc.base32(b"abc"), 7, True, s)
    found = list(warc.records_of(io.BytesIO(one + two)))
    assert [h["WARC-Type"] for h, _ in found] == ["response", "revisit"]
    assert found[0][1].endswith(b"\r\n\r\nabc") and found[0][0]["WARC-Target-URI"] == "http://xy"


def test_hot_and_distant_ids(spark):
    """A far id, null ids and an id of many rows are cut into shards of their own; ids over 2 ** 53 stay what they are."""
    data = [(i, "u", f"<p>{i}</p>" * 20) for i in range(300)] + [(2**62 + 1, "u", "<i>far</i>"), (-(2**63), "u", "<i>low</i>")]
    data += [(None, "u", f"<b>{i}</b>" * 20) for i in range(200)] + [(7, f"u{i}", f"<u>{i}</u>" * 20) for i in range(200)]
    data += [(None, "a", "<i>twice</i>"), (None, "b", "<i>twice</i>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    s, folder = warc.Settings(file_bytes=400, shard_bytes=2000, intervals=64), new_dir(spark, "warc")
    manifest = warc.write(pages, folder, s)
    most = manifest.groupBy("shard").count().agg({"count": "max"}).first()[0]
    assert manifest.select("shard").distinct().count() > 20 and most > 1
    got = warc.read(manifest, folder)
    want = [r for r in brute(data) if r[4] is not None or r[0] is not None or "twice" not in str(r)]
    twice = base64.b32encode(hashlib.sha1(b"<i>twice</i>").digest()).decode()
    rows_ = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()]
    assert sorted((r for r in rows_ if r[2] != twice), key=str) == [r for r in want if r[2] != twice]
    assert sorted(r[3] for r in rows_ if r[2] == twice) == ["response", "revisit"]
    assert max(r.records for r in manifest.collect()) < 100
