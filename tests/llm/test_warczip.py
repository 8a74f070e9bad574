import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from encore.llm import warczip
from encore.llm.frames import shared_folder

LONG = "payload é " * 30
PAGES = [
    (5, "http://a/é b\r\nX: y", LONG, "x"), (2, None, LONG, "x"), (9, "http://c", LONG, "x"), (1, "http://d", "short", "x"), (3, "http://e", "short", "x"),
    (4, "", None, "x"), (6, "http://f", "", "x"), (7, "http://g", "x" * 100, "x"), (8, "http://h", "y" * 99 + "\r\n\r\n" + LONG, "x"), (None, "http://i", LONG, "x"),
    (2, None, LONG, "x"),
]


@pytest.fixture(scope="module")
def found(spark):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload_digest string")
    return warczip.archive(table, with_payload=True).collect()


def test_every_page_comes_back(found):
    assert sorted((r["page_id"] or -1) for r in found) == sorted((p[0] or -1) for p in PAGES)
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in found:
        payload = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r["payload"] == (payload if r["record_type"] == "response" else b"")


def test_revisits(found):
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in found}
    assert {(5, "revisit", 2), (9, "revisit", 2), (2, "response", None), (None, "revisit", 2)} <= kinds
    assert all(kind == "response" for page, kind, _ in kinds if page in (1, 3, 4, 6, 7, 8))


def test_small_packages_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warczip, "RANGE_BYTES", 200)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = shared_folder(spark, "test-packages")
    packages = warczip.write_packages(warczip.with_revisits(pages, "page_id", "url", "html"), folder, most_bytes=3000)
    listed = packages.collect()
    assert len(listed) > 3 and sum(r["records"] for r in listed) == pages.count()
    table = spark.createDataFrame(listed, packages.schema)
    got = warczip.read_records(warczip.record_places(table, folder), folder).collect()
    assert {(r["page"], r["url"], bytes(r["payload"]).decode()) for r in got} == {(str(p["page_id"]), p["url"], p["html"]) for p in pages.collect()}


def test_zip64_directories(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("first", b"a" * 50)
        with z.open("second", "w", force_zip64=True) as m:
            m.write(b"b" * 70)
        z.comment = b"PK\x05\x06 in a comment"
    assert b"PK\x06\x06" in raw.getvalue()
    source = pa.BufferReader(raw.getvalue())
    members = {m.name: m for m in warczip.directory(source, len(raw.getvalue()))}
    assert set(members) == {"first", "second"}
    for name, data in (("first", b"a" * 50), ("second", b"b" * 70)):
        at = warczip.data_start(source, members[name])
        assert source.read_at(members[name].size, at) == data


def test_compressed_members_and_other_files_are_refused():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", b"a" * 500)
    source = pa.BufferReader(raw.getvalue())
    (member,) = warczip.directory(source, len(raw.getvalue()))
    with pytest.raises(ValueError):
        warczip.data_start(source, member)
    with pytest.raises(ValueError):
        warczip.directory(pa.BufferReader(b"no zip at all"), 13)


def test_packages_are_plain_zip_files():
    package = warczip.Package()
    package.add("1", "response", warczip.record("1", "http://a", b"hello", "0" * 64, None))
    with zipfile.ZipFile(io.BytesIO(package.to_bytes())) as z:
        assert set(z.namelist()) == {warczip.ARCHIVE, warczip.INDEX} and z.testzip() is None


def test_empty_table(spark):
    assert warczip.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
