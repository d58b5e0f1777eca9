import hashlib
import time

import numpy as np

from papyra.llm import warc


def test_magic_in_payloads_is_not_a_record(spark, tmp_path):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/ b\n", inner * 3), (2, None, "x" * 1200), (3, "u", "x" * 1200), (None, "u", "x" * 1200), (4, "u", None), (5, "u", ""), (6, "u", "é" * 600), (7, "u", "é" * 600), (7, "u", "é" * 600), (8, "u", "y" * 999), (9, "u", "y" * 999), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (10, "u", "\r\n\r\n" + inner + "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n", "3 as keep").repartition(3)
    warc.write_archives(pages, f"{tmp_path}/a")
    got = sorted(map(tuple, warc.read_archives(spark, f"{tmp_path}/a").collect()), key=str)
    payload = [(k, (t or "").encode()) for k, _, t in rows]
    want = []
    for k, b in payload:
        same = [i for i, c in payload if c == b and i is not None]
        again = len(b) >= 1000 and same and (k is None or k < max(same))
        want.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert got == sorted(want, key=str)


def test_records_behind_damage_are_left_out():
    record = lambda n: warc.MAGIC.encode() + f"WARC-Record-ID: <urn:page:{n}>\r\nContent-Length: 4\r\n\r\n\r\n\r\n".encode() + b"\r\n\r\n"
    data = record(1) + record(2) + b"torn" + record(3)
    at, begin, to = warc.candidates(data)
    assert len(at) == 3 and warc.reachable(at, to).tolist() == [True, True, False]
    assert [r["page_id"] for r in warc.records(data)] == [1, 2]
    assert list(warc.records(data[: len(record(1)) - 3])) == [] and len(warc.reachable(np.zeros(0, int), np.zeros(0, int))) == 0
    bare = lambda length: warc.MAGIC.encode() + b"Content-Length: " + length + b"\r\n\r\n"
    assert list(warc.records(bare(b"abc") + b"\r\n\r\n")) == list(warc.records(bare(b"9" * 5000) + b"\r\n\r\n")) == []
    assert len(list(warc.records(bare(b"0") + b"\r\n\r\n"))) == 1
    assert [warc._id(v) for v in (b"<urn:page:->", b"<urn:page:>", b"<urn:page:99999999999999999999>", b"<urn:page:9999999999999999999>", b"<urn:page:-7>")] == [None] * 4 + [-7]


def test_hostile_payloads_and_large_pages(spark, tmp_path):
    fake = lambda kind, n, length: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {length}\r\n\r\nContent-Length: abc\r\n\r\n\r\n\r\n"
    html = [fake("revisit", 1, "abc"), fake("revisit", 2, "23"), fake("response", 3, "9" * 5000), fake("revisit", "-", "23"), fake("revisit", "9" * 30, "23"), warc.MAGIC * 100_000, "\r\n" * 300_000, "x" * 3_000_000]
    pages = spark.createDataFrame([(i, "http://a/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/h")
    begun = time.time()
    got = sorted(map(tuple, warc.read_archives(spark, f"{tmp_path}/h").collect()))
    assert got == [(i, len(h), hashlib.sha1(h.encode()).hexdigest(), "response", None) for i, h in enumerate(html)]
    assert time.time() - begun < 30


def test_long_chains():
    at = np.arange(0, 10_000, 2)
    assert warc.reachable(at, at + 2).all()
    assert warc.reachable(at, np.where(at == 5000, 5001, at + 2)).sum() == 2501


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/e")
    assert warc.read_archives(spark, f"{tmp_path}/e").count() == 0
