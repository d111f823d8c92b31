from __future__ import annotations

import hashlib
import io
import zipfile

import pytest

from tremolo.llm import common, warc_zip

from .conftest import ODD


def opened(data: bytes) -> warc_zip.Archive:
    return warc_zip.Archive(io.BytesIO(data), len(data))


def test_records_round_trip():
    payload = "<p>Ünïcode</p>\r\n\r\nWARC/1.1\r\n\r\nx".encode()
    digest = hashlib.sha1(payload).hexdigest()
    got = warc_zip.parse_record(warc_zip.record_bytes(5, "http://x/\r\n y", payload, digest, None, "0-1"))
    assert (got["page_id"], got["payload"], got["record_type"], got["refers_to"]) == (5, payload, "response", None) and got["url"] == "http://x/%0D%0A%20y"
    got = warc_zip.parse_record(warc_zip.record_bytes(None, None, payload, digest, 9, "0-2", None))
    assert (got["page_id"], got["payload_bytes"], got["payload_digest"], got["record_type"], got["refers_to"]) == (None, len(payload), digest, "revisit", 9)
    with pytest.raises(ValueError):
        warc_zip.parse_record(warc_zip.record_bytes(5, "u", payload, "0" * 40, None, "0-3"))


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first", b"1" * 100)
        z.writestr("ünï", b"2" * 80)
        z.comment = b"PK\x05\x06 a comment"
    data = out.getvalue()
    assert warc_zip.END64 in data
    file = warc_zip.RangeFile(io.BytesIO(data), len(data), ahead=16)
    members = warc_zip.directory(file)
    for name, body in (("first", b"1" * 100), ("ünï", b"2" * 80)):
        m = members[name]
        assert m.size == m.packed == len(body) and file.read(warc_zip.data_at(file, m), m.size) == body


def test_compressed_members_and_broken_files_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.INDEX, "x" * 1000)
    with pytest.raises(ValueError):
        opened(out.getvalue()).index()
    with pytest.raises(ValueError):
        opened(b"no archive")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    long, other = "ä" * 600, "b" * 1000
    rows = [(i, f"http://x/{i}", t) for i, t in enumerate(ODD)] + [(20, "u", long), (22, None, long), (21, "u", long), (30, "u", "s"), (31, "u", "s"), (40, "u", other), (40, "u", other), (None, "u", other), (None, "u", "c" * 2000)]
    where = common.work_dir(spark, "test")
    warc_zip.write_archives(pages(spark, rows).selectExpr("*", "1 as first", "2 as digest", "3 as same"), where, archive_bytes=300)
    got = warc_zip.read_archives(spark, where).collect()
    assert len({r.archive for r in got}) > 1
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        refers = max(ids) if len(body) >= 1000 and ids and max(ids) != i else None
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_single_records_by_range(spark):
    where = common.work_dir(spark, "test")
    warc_zip.write_archives(pages(spark, [(i, "u", f"page {i}") for i in range(50)]).coalesce(1), where)
    name = spark.read.parquet(f"{where}/manifest").first().archive
    fs, folder = common.file_system(where)
    with fs.open_input_file(f"{folder}/{name}") as file:
        archive = warc_zip.Archive(file, file.size())
        entry = next(e for e in archive.index() if e["key"] == "urn:page:33")
        assert archive.record(entry)["payload"] == b"page 33"


def test_no_pages(spark):
    where = common.work_dir(spark, "test")
    warc_zip.write_archives(pages(spark, []), where)
    assert warc_zip.read_archives(spark, where).count() == 0


def test_records_have_ids_of_their_own(spark, tmp_path, monkeypatch):
    schema = "page_id long, url string, html string"
    page = "x" * 2000
    rows = [(1, "http://a", page), (1, "http://a", page), (2, "http://b", page), (None, None, page), (None, None, "short"), (None, "u", "short"), (3, "http://c", "y" * 1500), (4, None, "y" * 1500), (5, "http://d", "z" * 1200)]
    pages = spark.createDataFrame(rows, schema).repartition(3)
    seen = []
    for k, most in enumerate((200_000, 0, 1)):
        monkeypatch.setattr(warc_zip, "BROADCAST_GROUPS", most)
        warc_zip.write_archives(pages, f"{tmp_path}/{k}")
        got = warc_zip.read_archives(spark, f"{tmp_path}/{k}").collect()
        assert len({r.record_id for r in got}) == len(rows)
        seen.append(sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in got))
    assert seen[0] == seen[1] == seen[2]
    assert [r for r in seen[0] if r[2] == "revisit"] == [("1", 2000, "revisit", "2"), ("1", 2000, "revisit", "2"), ("3", 1500, "revisit", "4"), ("None", 2000, "revisit", "2")]
