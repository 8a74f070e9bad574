"""WARC records in ZIP packages: writer, and a reader that never extracts a package.

A package is a ZIP file whose members are stored: ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdxj`` with the place of every record. The reader finds the end record, the ZIP64 end record where there
is one, the central directory and the local headers; it reads the index member, then single records by byte range.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .frames import BINARY, LONG, TEXT, column, field, map_batches, open_store, shared_folder, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are always stored.
LEAST_BYTES = 100
#: Compressed bytes after which a task begins its next package.
PACKAGE_BYTES = 48 << 20
#: Compressed bytes of neighbouring records that one row of work reads.
RANGE_BYTES = 4 << 20
#: Compressed bytes that one task reads.
TASK_BYTES = 16 << 20


# Records ------------------------------------------------------------------------------------------------------------


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC record: a response with its payload, or a revisit that names the response with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{url}')}>")
    if page is not None:
        head.append(f"WARC-Page-ID: {quote(page, safe='')}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL)}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {quote(refers_to, safe='')}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL = "%:/?#[]@!$&'()*+,;=-._~"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


# ZIP directories ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


def _end_record(source, size: int) -> tuple[int, int, int]:
    """(entries, directory size, directory start), from the ZIP64 end record if there is one."""
    length = min(size, 22 + 65535)
    tail = source.read_at(length, size - length)
    at = tail.rfind(b"PK\x05\x06", 0, max(0, length - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at + 3)
    if at < 0:
        raise ValueError("no end record: not a ZIP file")
    entries, directory, start = struct.unpack_from("<HII", tail, at + 10)
    before = size - length + at - 20
    locator = source.read_at(20, before) if before >= 0 else b""
    if locator[:4] == b"PK\x06\x07":
        place = struct.unpack_from("<Q", locator, 8)[0]
        wide = source.read_at(56, place)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is not where its locator says")
        entries, directory, start = struct.unpack_from("<QQQ", wide, 32)
    return entries, directory, start


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and places that do not fit 32 bits, from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        tag, length = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            spot, out = at + 4, []
            for v in values:
                if v == 0xFFFFFFFF:
                    v = struct.unpack_from("<Q", extra, spot)[0]
                    spot += 8
                out.append(v)
            return out
        at += 4 + length
    return values


def directory(source, size: int) -> list[Member]:
    """The members of a package, from its central directory."""
    entries, length, start = _end_record(source, size)
    raw, at, members = source.read_at(length, start), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        plain, packed, header = _wide(raw[at + 46 + n_name : at + 46 + n_name + n_extra], [plain, packed, header])
        members.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def data_start(source, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = source.read_at(30, member.header_at)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


# Writing ------------------------------------------------------------------------------------------------------------


class Package:
    """One package in the making, held in memory up to its bounded size."""

    def __init__(self):
        self.records, self.lines = io.BytesIO(), []

    def add(self, page: str | None, kind: str, raw: bytes) -> None:
        packed = gzip.compress(raw, 4, mtime=0)
        self.lines.append(json.dumps({"page": page, "type": kind, "offset": self.records.tell(), "length": len(packed)}))
        self.records.write(packed)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in ((ARCHIVE, self.records.getvalue()), (INDEX, "\n".join(self.lines).encode())):
                z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
        return out.getvalue()


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page, url, html, digest, first): ``first`` is the response's page if the row repeats another page's payload."""
    html = F.coalesce(column(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        column(id_col).alias("page"), column(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest")
    )
    firsts = (
        rows.filter(F.octet_length("html") >= LEAST_BYTES)
        .groupBy("digest")
        .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    return rows.join(firsts, "digest", "left").select(
        F.col("page").cast("string").alias("page"), "url", "html", "digest",
        F.when(~F.coalesce(F.col("page") == F.col("first"), F.lit(False)), F.col("first").cast("string")).alias("first"),
    )


def write_packages(rows: DataFrame, folder: str, most_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages of bounded size and returns (package, records, bytes). Names are new for every attempt of a task."""
    schema = T.StructType([field("package", TEXT), field("records", LONG), field("bytes", LONG)])

    def run(batches):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)

        def close(package: Package) -> list:
            name = f"{uuid.uuid4().hex}.wacz"
            raw = package.to_bytes()
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(raw)
            return [pa.array([name]), pa.array([len(package.lines)]), pa.array([len(raw)])]

        package = Package()
        for batch in batches:
            for page, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package.add(page, "response" if first is None else "revisit", record(page, url, html.encode(), digest, first))
                if package.records.tell() >= most_bytes:
                    yield close(package)
                    package = Package()
        if package.lines:
            yield close(package)

    return map_batches(rows, schema, run)


# Reading ------------------------------------------------------------------------------------------------------------


def record_places(packages: DataFrame, folder: str) -> DataFrame:
    """(package, part, place, length) of every record, from the index members; a part is a few megabytes of neighbours."""
    schema = T.StructType([field("package", TEXT), field("part", LONG), field("place", LONG), field("length", LONG)])

    def run(batches):
        store, root = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                size = store.get_file_info(f"{root}/{name}").size
                with store.open_input_file(f"{root}/{name}") as source:
                    members = {m.name: m for m in directory(source, size)}
                    index, base = members[INDEX], data_start(source, members[ARCHIVE])
                    lines = source.read_at(index.size, data_start(source, index)).decode().splitlines()
                entries = [json.loads(line) for line in lines if line]
                yield [
                    pa.array([name] * len(entries), pa.string()), pa.array([e["offset"] // RANGE_BYTES for e in entries], pa.int64()),
                    pa.array([base + e["offset"] for e in entries], pa.int64()), pa.array([e["length"] for e in entries], pa.int64()),
                ]

    return map_batches(packages.select("package"), schema, run)


def read_records(places: DataFrame, folder: str, with_payload: bool = True, tasks: int = 1) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload) of every record.

    Records are read by byte range, neighbours by the same of ``tasks`` tasks: index rows are small, what they point to is
    not, so their number is given. The digest and size of a response are those of the payload that was read; a revisit
    states them in its header fields.
    """
    names = [
        field("page", TEXT), field("url", TEXT), field("payload_bytes", LONG), field("payload_digest", TEXT),
        field("record_type", TEXT), field("refers_to", TEXT), *([field("payload", BINARY)] if with_payload else []),
    ]

    def one(raw: bytes) -> tuple:
        fields, http, payload = parse_record(gzip.decompress(raw))
        page, first = fields.get("warc-page-id"), fields.get("warc-refers-to-page")
        if fields["warc-type"] == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        else:
            size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
        return (
            None if page is None else unquote(page), fields.get("warc-target-uri"), size, digest, fields["warc-type"],
            None if first is None else unquote(first), payload,
        )

    def run(batches):
        store, root = open_store(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for package, _, place, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package != name:
                    name, source = package, store.open_input_file(f"{root}/{package}")
                rows.append(one(source.read_at(length, place)))
                if len(rows) == 512:
                    yield list(zip(*rows, strict=True))[: len(names)]
                    rows = []
            if rows:
                yield list(zip(*rows, strict=True))[: len(names)]

    dealt = places.repartition(tasks, "package", "part").sortWithinPartitions("package", "place")
    return map_batches(dealt, T.StructType(names), run)


def archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, with_payload: bool = False
) -> DataFrame:
    """Writes a record for every page into ZIP packages, reads the packages back and returns what they hold.

    Of pages with equal payloads of at least ``LEAST_BYTES`` bytes, those with the smallest id are responses, all others
    revisits of it. Null html is an empty payload; a null id never is the one referred to unless all are null, and then
    each page is a response; a null url is left out. Repeated rows are written each; ids come back with their type; other
    columns are not read. An empty table gives an empty result. Packages stay in ``folder``, a new one unless given.
    """
    folder = folder or shared_folder(pages.sparkSession, "packages")
    packages = written(write_packages(with_revisits(pages, id_col, url_col, html_col), folder), "package-list")
    size = packages.agg(F.sum("bytes")).first()[0] or 0
    found = read_records(record_places(packages, folder), folder, with_payload, max(1, -(-size // TASK_BYTES)))
    kind = pages.schema[id_col].dataType
    return found.select(
        F.col("page").cast(kind).alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
        *(["payload"] if with_payload else []),
    )
