import gzip
import hashlib
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recallgrid.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    big = "é<p>" * 60
    rows = [(5, "http://a/5", big, 1), (3, "http://a/3\r\nX: y", big, 1), (9, None, big, 1), (1, "u", "small", 1), (2, "u", "small", 1), (4, "u", None, 1), (6, "u", "\r\n\r\nWARC/1.1\r\n" * 30, 1), (None, "u", big, 1)]
    rows += [(100 + i, "u", "x" * (50 * i), 1) for i in range(40)]
    warc.archived(pages(spark, rows), str(tmp_path / "w"))
    files = os.listdir(tmp_path / "w")
    assert len(files) > 1 and all(f.endswith(".warc") for f in files)
    back = spark.read.format("warc").load(str(tmp_path / "w"))
    got = {r["page_id"]: r for r in back.collect()}
    for i, url, html, _ in rows:
        body = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if i in (5, 9) else ("response", None))
        assert r["payload"] == (None if i in (5, 9) else body)
        assert r["target_uri"] == (None if url is None else " ".join(url.split()))
    some = back.where((F.col("record_type") == "revisit") & F.col("page_id").isin(5, 6)).select("page_id", "payload")
    assert [tuple(r) for r in some.collect()] == [(5, None)]


def test_filters_skip_payloads():
    row = {"page_id": 1, "record_type": "response", "target_uri": None, "payload_digest": "d", "payload_bytes": 10_000_000, "refers_to": None}

    class File:
        """An archive of one record, whose payload must not be read."""

        def __init__(self):
            self.raw, self.at = warc.head(row, 10_000_000, datetime.now()), 0

        def seekable(self):
            return True

        def seek(self, at):
            self.at = at

        def read(self, n):
            assert self.at <= len(self.raw) or self.at == len(self.raw) + 10_000_004
            self.at += n
            return self.raw[self.at - n : self.at]

    assert [v["page_id"] for v, _, _ in warc.records(File())] == [1]
    reader = warc.WarcReader(["page_id"], "x")
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [f.attribute for f in reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 3)])] == [("page_id",)]


def test_headers_of_responses_and_revisits(spark, tmp_path):
    body = "z" * 150
    warc.archived(pages(spark, [(1, "http://a/1", body, 0), (2, "http://a/2", body, 0)]), str(tmp_path / "w"))
    raw = "".join((tmp_path / "w" / f).read_bytes().decode() for f in os.listdir(tmp_path / "w"))
    first, second = sorted(raw.split("WARC/1.1\r\n")[1:], key=lambda r: "revisit" in r)
    assert "WARC-Record-ID: <urn:page:1>" in first and f"{body}\r\n\r\n" in first and "WARC-Profile" not in first
    assert f"WARC-Profile: {warc.PROFILE}" in second and "WARC-Refers-To: <urn:page:1>" in second and body not in second
    assert raw.count("WARC-Date: ") == 2 and raw.count("HTTP/1.1 200 OK\r\n") == 2


def test_compressed_and_foreign_archives(spark, tmp_path):
    record = lambda kind, block, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\n{more}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()
    parts = [record("warcinfo", "software: x"), record("response", "HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", "Content-Type: application/http\r\nWARC-Target-URI: http://x/\r\n"), record("resource", "y" * 5000), record("metadata", "")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "b.warc").write_bytes(b"".join(parts))
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    want = [("warcinfo", None, b"software: x"), ("response", "http://x/", b"body"), ("resource", None, b"y" * 5000), ("metadata", None, b"")]
    assert sorted((r["record_type"], r["target_uri"], bytes(r["payload"])) for r in got) == sorted(want * 2, key=lambda x: (x[0], x[1] or ""))
    skipped = spark.read.format("warc").schema(warc.HEADER_SCHEMA).load(str(tmp_path)).where("record_type = 'metadata'")
    assert [r["payload_bytes"] for r in skipped.collect()] == [0, 0]


def test_a_broken_payload_shows(spark, tmp_path, monkeypatch):
    write = warc.archived

    def broken(rows, path):
        write(rows, path)
        for f in os.listdir(path):
            raw = open(f"{path}/{f}", "rb").read()
            open(f"{path}/{f}", "wb").write(raw.replace(b"zzz", b"zyz", 1))

    monkeypatch.setattr(warc, "archived", broken)
    (row,) = warc.report(pages(spark, [(1, "u", "z" * 50, 0)])).collect()
    assert row["payload_bytes"] == 50 and row["payload_digest"] == hashlib.sha256(b"zyz" + b"z" * 47).hexdigest()


def test_repeated_rows_and_empty_tables(spark):
    body = "y" * 200
    rows = warc.report(pages(spark, [(7, "u", body, 1), (7, "u", body, 1), (8, "u", body, 1)])).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in rows) == [(7, "response", None), (7, "response", None), (8, "revisit", 7)]
    assert warc.report(pages(spark, [])).count() == 0


def test_lengths_of_foreign_payloads(spark, tmp_path):
    record = lambda kind, block, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Type: application/http\r\n{more}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()
    parts = [record("response", "HTTP/1.1 200 OK\r\n\r\nbody", "WARC-Target-URI: a\r\n"), record("revisit", "HTTP/1.1 200 OK\r\n\r\n", "WARC-Target-URI: b\r\n"), record("response", "HTTP/1.1 204 none", "WARC-Target-URI: c\r\n"), record("response", "HTTP/1.1 200 OK\r\n\r\n" + "x" * 3000, "WARC-Target-URI: d\r\n")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    back = spark.read.format("warc").load(str(tmp_path))
    want = {"a": 4, "b": None, "c": 0, "d": 3000}
    assert {r["target_uri"]: r["payload_bytes"] for r in back.select("target_uri", "payload_bytes").collect()} == want
    assert {r["target_uri"]: r["payload"] and len(r["payload"]) for r in back.select("target_uri", "payload").collect()} == want | {"c": b""}
    assert [tuple(r) for r in back.where("payload_bytes = 3000").select("target_uri").collect()] == [("d",)]
    assert sorted(r[0] for r in back.where("payload_bytes in (0, 4)").select("target_uri").collect()) == ["a", "c"]


@pytest.mark.parametrize(("raw", "say"), [(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx\r\n\r\n", "a record without a length: None at byte 53"), (b"WARC/1.0\r\nContent-Length: ten\r\n\r\n", "a record without a length: 'ten' at byte 53"), (b"WARC/1.0\nContent-Length: 1\n\nx\n\n", "a record without an end of headers at byte 53"), (b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc", "cut off, at byte 84")])
def test_broken_records_are_named(tmp_path, raw, say):
    whole = b"WARC/1.0\r\nWARC-Type: info\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    assert len(whole) == 53
    (tmp_path / "a.warc").write_bytes(whole + raw)
    reader = warc.WarcReader(["record_type", "payload"], str(tmp_path))
    with pytest.raises(ValueError, match=r"a\.warc: .*" + say):
        list(reader.read(reader.partitions()[0]))
