import base64
import gzip
import hashlib
import io

import pytest

from quillon.llm import scratch, warc


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, record_type string")


ROWS = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/\r\n5", "x" * 300_000), (6, "http://é", "WARC/1.1\r\n\r\nHTTP/1.1\r\n\r\n"), (9, "http://a/9", "<p>é</p>"), (9, "http://a/9", "<p>é</p>"), (None, "http://n", "<p>é</p>"), (None, "http://m", "alone")]


def expected(rows, least=0):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", -1), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = top.get(h or "") if len(raw) >= least else None
        revisit = refers is not None and refers != i
        out.append((i if i is not None else -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", refers if revisit else -1))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, least):
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to if r.refers_to is not None else -1) for r in warc.round_trip(frame(spark, ROWS).repartition(3), least).collect())
    assert got == expected(ROWS, least)
    assert warc.round_trip(frame(spark, ROWS).limit(0)).count() == 0


def test_payloads_come_back(spark):
    archives = scratch.stash(warc.write_archives(frame(spark, ROWS), scratch.new_path(spark, "t")), "t")
    rows = {(r.page_id, r.record_type): r for r in warc.read_archives(archives).collect()}
    assert bytes(rows[5, "response"].payload) == b"x" * 300_000 and rows[1, "revisit"].payload is None
    assert rows[5, "response"].url == "http://a/%0D%0A5" and rows[3, "revisit"].url is None
    assert archives.groupBy().sum("records").collect()[0][0] == len(ROWS)


class Trickle(io.BytesIO):
    def read(self, n=-1):
        return super().read(min(n, 7))


def data():
    return b"".join(warc.member(warc.record(i, f"http://a/{i}", bytes([65 + i]) * i * 50_000)) for i in range(4))


def test_reader_is_incremental():
    got = list(warc.read_records(Trickle(data())))
    assert [len(p) for _, p in got] == [0, 50_000, 100_000, 150_000]
    assert len(list(warc.read_records(io.BytesIO(b"")))) == 0
    assert gzip.decompress(data()).startswith(b"WARC/1.1\r\n")  # any gzip reader can read it


def test_damage_is_noticed():
    raw = warc.record(1, "http://a", b"payload")
    cases = [data()[:-5], warc.member(raw.replace(b"payload", b"Payload")), warc.member(raw[:-1]), warc.member(raw + b"x"), b"no gzip at all", warc.member(b"HTTP/1.1\r\n\r\n\r\n\r\n"), warc.member(raw.replace(b"WARC-Type: response\r\n", b"junk\r\n"))]
    for bad in cases:
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))
    assert list(warc.read_records(io.BytesIO(cases[1]), verify=False))[0][1] == b"Payload"


def test_long_ids_beside_nulls(spark):
    rows = [(2**53 + 1, "http://a", "same"), (2**53 + 3, "http://b", "same"), (None, "http://c", "other"), (2**62 + 3, "http://d", "alone")]
    got = warc.round_trip(frame(spark, rows).coalesce(1)).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(2**53 + 1, 2**53 + 3), (2**53 + 3, None), (None, None), (2**62 + 3, None)}


def other(kind, block, *more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0>", *more, f"Content-Length: {len(block)}"]
    return warc.member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_records_of_every_type_are_read(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 3\r\n\r\n<p>other writer</p>"
    raw = [
        other("warcinfo", b"software: some crawler\r\n", "Content-Type: application/warc-fields"), other("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        other("response", body, "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=response", "WARC-Block-Digest: md5:abc"), other("metadata", b"", "Content-Type: application/warc-fields"),
        other("resource", b"\x00\xff", "WARC-Payload-Digest: sha1:" + warc.digest_of(b"\x00\xff").lower()), other("x-dns", b"a 1.2.3.4"), data(),
    ]
    path = tmp_path / "mixed.warc.gz"
    path.write_bytes(b"".join(raw))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
    assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "metadata", "resource", "x-dns", *["response"] * 4]
    assert bytes(rows[2].payload) == b"<p>other writer</p>" and rows[2].payload_digest == warc.digest_of(b"<p>other writer</p>") and rows[2].page_id is None
    assert bytes(rows[0].payload).startswith(b"software") and rows[3].payload_bytes == 0
    bad = other("resource", b"x", "WARC-Block-Digest: sha1:" + warc.digest_of(b"y"))
    with pytest.raises(warc.WarcError, match="block digest"):
        list(warc.read_records(io.BytesIO(bad)))


def test_urls_of_any_length(spark):
    url = "http://a/" + "".join(chr(33 + (k * k * 7919 + k) % 90) for k in range(1_500_000))
    got = warc.round_trip(frame(spark, [(1, url, "x"), (2, "http://b", "x")])).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(1, 2), (2, None)}


def test_revisits_are_held_against_their_responses(spark):
    archives = scratch.stash(warc.write_archives(frame(spark, ROWS), scratch.new_path(spark, "t")), "t")
    records = scratch.stash(warc.read_archives(archives, payloads=False), "r")
    assert warc.broken_revisits(records).count() == 0
    top = records.filter("refers_to is not null").first().refers_to
    assert warc.broken_revisits(records.filter(f"record_type = 'revisit' or page_id <> {top}")).first().refers_to == top
