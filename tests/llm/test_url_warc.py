import base64
import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from crossloom.llm import url_filter as u
from crossloom.llm import warc

URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?b=2&a=1#f", "https://example.net/en/", "https://example.net", "http://notexample.com/de/", "http://x.example.com/de/y", "http://example.com/DE/", "ftp://a.org/fr/", "http://org/fr/q", "http://a.org/de/1?x", "http://a.org/de/1?x", "http://a.org/de/1/?x#z", "http://h.com?q=1", "http://h.com#x"]


def test_rules_and_list(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    listed = spark.createDataFrame([("https://a.org/de/1?x",), (None,), ("https://a.org/de/1?x",), ("junk",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.url_filter(pages, listed).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5] == ("example.net", "", None, "allow")
    assert got[6] == ("notexample.com", "/de/", None, "allow")
    assert got[7][2:] == ("example.com/de/", "block") and got[8][2:] == (None, "allow")
    assert got[9][2:] == got[10][2:] == ("org/fr/", "allow")
    assert [got[k][3] for k in (11, 12, 13)] == ["block"] * 3
    assert got[14][:2] == ("h.com", "") and got[15][:2] == ("h.com", "")
    assert u.url_filter(pages.where("false"), listed).count() == 0
    assert u.url_filter(pages, listed.where("false")).where("listed").count() == 0


def test_bloom_has_no_false_negatives_and_join_removes_false_positives(spark, monkeypatch):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    probe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    for bound in (10**6, 0):
        monkeypatch.setattr(u, "BROADCAST_BLOCKS", bound)
        got = u.listed_hits(probe, keys)
        assert got.count() == 6000 and got.where("listed <> (id < 3000)").count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "", None, "<p>é</p>", "x\r\n\r\ny\r\n", "x\r\n\r\ny\r\n", "long " * 20000, "WARC/1.1\r\n"]
    pages = spark.createDataFrame([(k, h, "u", "payload") for k, h in enumerate(html * 2)] + [(None, "<p>é</p>", None, None), (15, "WARC/1.1\r\n", None, None)], "page_id long, html string, url string, payload string")
    where = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(pages), where)
    got = warc.read_resolved(spark, where).collect()
    assert len(got) == pages.count()
    groups = defaultdict(list)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    for i, h in rows:
        groups[h].append(i)
    want = sorted(str((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), *(("response", None) if i == (m := max(x for x in groups[h] if x is not None)) else ("revisit", m)))) for i, h in rows)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == want
    back = {r.page_id: r.payload for r in warc.read_archives(spark, where).where("record_type = 'response'").collect()}
    assert set(back.values()) == {h or "" for h in html}


def test_large_payloads_get_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    pages = spark.createDataFrame([(k, f"{k} " * (2500 if k % 3 == 0 else 5)) for k in range(30)], "page_id long, html string").coalesce(1)
    where = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(pages), where)
    got = {r.page_id: r.payload for r in warc.read_archives(spark, where).collect()}
    assert got == {r.page_id: r.html for r in pages.collect()}
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 10


def test_parsing_piece_by_piece():
    import gzip

    record = lambda k: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:{k}>\r\nWARC-Payload-Digest: sha1:A\r\nContent-Length: {len(warc._HTTP) + 5 + k}\r\n\r\n{warc._HTTP}{k}\r\n\r\n{'x' * k}\r\n\r\n".encode()
    blob = b"".join(gzip.compress(record(k)) for k in range(6, 10))  # a member for each record
    for piece in (1, 7, 10**6):
        rows = list(warc._parse(warc._inflated(blob, piece), True))
        assert [(r[0], r[5], r[6]) for r in rows] == [(k, k, "x" * k) for k in range(6, 10)]


def test_warc_least_size_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abcd"), (4, "abcd")], "page_id long, html string")
    kinds = {r.page_id: r.record_type for r in warc.resolve_revisits(pages, min_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    where = str(tmp_path / "e")
    warc.write_archives(warc.resolve_revisits(pages.where("false")), where)
    assert warc.read_resolved(spark, where).count() == 0
