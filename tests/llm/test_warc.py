"""WARC files: exact round trips at any size of byte range."""

import base64
import glob
import gzip
import hashlib
import random

import pytest
from siteoverlap.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest int")


def rows():
    draw = random.Random(5)
    out = [(k, f"http://e.example/{k}?q=é x", "".join(draw.choice("abc <>é\n") for _ in range(draw.choice([0, 3, 999, 1000, 5000]))), "", 0) for k in range(120)]
    out += [(200 + k, None, "same é " * 400, "", 0) for k in range(30)] + [(400 + k, "u\r\nX: y", "short", "", 0) for k in range(3)]
    return out + [(500, "u", None, "", 0), (500, "u", None, "", 0), (None, "u", "same é " * 400, "", 0)]


@pytest.mark.parametrize("limit", ["700b", "5000b", "128m"])
def test_round_trip(spark, tmp_path, limit):
    path = f"file://{tmp_path}/w"
    spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    try:
        warc.write_archives(pages(spark, rows()).repartition(3), path)
        got = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows())
    text = {(i, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h, _, _ in rows()}
    assert {(r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in got} == text
    for r in got:
        same = r["payload_digest"] == hashlib.sha1(("same é " * 400).encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 229) if same and r["page_id"] != 229 else ("response", None))
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"]


def test_plain_gzip_reads_the_files(spark, tmp_path):
    warc.write_archives(pages(spark, rows()).coalesce(1), f"file://{tmp_path}/w")
    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/w/part-*"))
    assert data.count(b"WARC/1.1\r\n") == len(rows()) and data.count(b"WARC-Type: revisit") == 30


def test_long_record_ends_in_a_zero_byte():
    out = warc.member(b"x" * (1 << 24))
    assert out[-1] == 0 and gzip.decompress(out) == b"x" * (1 << 24)


@pytest.mark.parametrize("limit", [64, 200, 333, 1000, 1 << 20])
def test_magic_inside_members(spark, tmp_path, limit):
    import zlib

    want = []
    with open(f"{tmp_path}/a.warc", "wb") as out:
        for k in range(40):
            payload = random.Random(k).choice([b"", b"ab", warc.MAGIC]) + (warc.MAGIC + b"noise" * (k % 7)) * (k % 9)
            pack = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so the magic stands in the file
            out.write(pack.compress(warc.record(k, "u", payload, hashlib.sha1(payload).hexdigest(), None, "2020-01-01T00:00:00Z")) + pack.flush())
            want.append((k, payload))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(limit))
    try:
        got = warc.read_archives(spark, f"file://{tmp_path}/a.warc").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == want


def test_damage_is_counted_and_empty_is_empty(spark, tmp_path):
    warc.write_archives(pages(spark, rows()).where("false"), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").collect() == []
    one = lambda k, text, digest=None: warc.record(k, "u", text, digest or hashlib.sha1(text).hexdigest(), None, "2020-01-01T00:00:00Z")
    good, bad = warc.member(one(1, b"x" * 900)), warc.member(one(2, b"y" * 90, "0" * 40))
    cut = random.Random(1).randbytes(2000)
    with open(f"{tmp_path}/b.warc", "wb") as out:
        out.write(good[:-9] + good + bad + warc.member(one(3, cut)) + warc.member(one(4, cut))[:-900])
    for limit in ("128m", "300b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        got = warc.read_archives(spark, f"file://{tmp_path}/b.warc").collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r["page_id"] or 0, r["record_type"], r["error"] is None) for r in got) == [(0, "damaged", False), (0, "damaged", False), (1, "response", True), (2, "response", False), (3, "response", True)]


def test_archives_of_others(spark, tmp_path):
    def block(kind, body, more=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:5f1c6f5e-0000-4000-8000-00000000000a>\r\n{more}Content-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    html = b"<p>text</p>"
    b32 = base64.b32encode(hashlib.sha1(html).digest()).decode()
    info, http = b"software: x\r\n", b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\n" + html
    with open(f"{tmp_path}/c.warc", "wb") as out:
        out.write(gzip.compress(block("warcinfo", info)) + gzip.compress(block("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request\r\n")))
        out.write(gzip.compress(block("response", http, f"Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{b32}\r\nWARC-Target-URI: http://e.x/\r\n") + block("metadata", b"a: b")))
        out.write(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n"))
    got = {r["record_type"]: r for r in warc.read_archives(spark, f"file://{tmp_path}/c.warc").collect()}
    assert set(got) == {"warcinfo", "request", "response", "metadata", "damaged"}
    assert bytes(got["response"]["payload"]) == html and got["response"]["error"] is None and got["response"]["payload_digest"] == hashlib.sha1(html).hexdigest()
    assert bytes(got["warcinfo"]["payload"]) == info and got["metadata"]["payload_bytes"] == 4 and all(r["page_id"] is None for r in got.values())
