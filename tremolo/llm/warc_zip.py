"""Operator 8: web archives packaged in ZIP, read in place.

A writer packs WARC records, each compressed on its own, and their index as stored members of ZIP archives. The reader parses
the end record, the ZIP64 end record and the central directory, locates stored members, and reads single records by offset and
length; nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads from this size on are written once; later equal ones revisit it.
REVISIT_BYTES = 1000
#: Compressed bytes of an archive, but for one longer record.
ARCHIVE_BYTES = 32_000_000
#: Groups of equal payloads up to which their table (some 100 bytes a group) is broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: Tasks that read archives, at most.
READERS = 20_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, END64_AT, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
#: A page's capture date isn't part of the table.
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "archive string, n_records long, n_bytes long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, record_id string"


@dataclass(frozen=True)
class Member:
    """A member of an archive, as its central directory has it."""

    name: str
    method: int
    crc: int
    packed: int
    size: int
    header_at: int


class RangeFile:
    """Reads of ranges of a file, through a window that is read ahead."""

    def __init__(self, file, size: int, ahead: int = 1 << 20):
        self.file, self.size, self.ahead, self.at, self.held = file, size, ahead, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError(f"bytes {at} to {at + n} of {self.size}")
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(max(n, self.ahead), self.size - at))
        return self.held[at - self.at : at - self.at + n]


def directory(file: RangeFile) -> dict[str, Member]:
    """The members of a ZIP file by name, from its central directory, with ZIP64 sizes and offsets where it has them."""
    tail_at = max(0, file.size - 65_557)
    tail = file.read(tail_at, file.size - tail_at)
    at = tail.rfind(END)
    # the record's signature may also stand in the comment that ends the file
    while at >= 0 and not (at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
        at = tail.rfind(END, 0, at + 3)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == END64_AT and (count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF):
        (end64,) = struct.unpack_from("<Q", tail, at - 20 + 8)
        record = file.read(end64, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    data, members, at = file.read(start, size), {}, 0
    for _ in range(count):
        if data[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", data, at + 16)
        (header_at,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # in this order, those alone that overflowed
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header_at = next(wide) if header_at == 0xFFFFFFFF else header_at
            extra = extra[4 + n :]
        members[name] = Member(name, method, crc, packed, plain, header_at)
        at += 46 + n_name + n_extra + n_comment
    return members


def data_at(file: RangeFile, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = file.read(member.header_at, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header_at + 30 + n_name + n_extra


def _headers(block: bytes) -> tuple[str, dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, number: str, refers_url: str | None = None) -> bytes:
    """A WARC record: a response with its payload, or a revisit with the response's HTTP head alone. ``number`` is the record's own, so
    that pages of one id, or of none, have records of different ids; page ids stand in fields of their own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = lambda url, page: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{number}>", *([] if page_id is None else [f"{PAGE}: {page_id}"]), f"WARC-Target-URI: {target(url, page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {target(refers_url, refers_to)}", f"WARC-Refers-To-Date: {DATE}", f"{REFERS}: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; a response's payload is held against its digest."""
    first, head, rest = _headers(data)
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    _, http, payload = _headers(rest[: int(head["content-length"])])
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"{head['warc-record-id']}: payload and digest differ")
    number = lambda field: None if field.lower() not in head else int(head[field.lower()])
    return {"record_id": head["warc-record-id"], "page_id": number(PAGE), "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": number(REFERS), "url": head["warc-target-uri"], "payload": payload}


class Archive:
    """A ZIP-packaged web archive, read by ranges."""

    def __init__(self, file, size: int):
        self.file = RangeFile(file, size)
        self.members = directory(self.file)

    def index(self) -> list[dict]:
        """Offset, length and key of each record."""
        member = self.members[INDEX]
        data = self.file.read(data_at(self.file, member), member.size)
        if zlib.crc32(data) != member.crc:
            raise ValueError("broken index")
        out = []
        for line in data.decode().splitlines():
            key, _, fields = line.partition(" ")
            out.append({"key": key} | json.loads(fields))
        return out

    def record(self, entry: dict) -> dict:
        at = data_at(self.file, self.members[DATA]) + entry["offset"]
        return parse_record(zlib.decompress(self.file.read(at, entry["length"]), wbits=31))


def pack(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP archive of (key, compressed record)s: data and index as stored members."""
    at, lines = 0, []
    for key, data in records:
        lines.append(f"{key} {json.dumps({'offset': at, 'length': len(data), 'filename': DATA})}\n")
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
        for name, data in ((DATA, b"".join(d for _, d in records)), (INDEX, "".join(lines).encode())):
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


#: Fields of this archive's own: the page of a record, and the page whose record has the payload.
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"


@common.tidy
def write_archives(pages: DataFrame, out_dir: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html, any more) into archives below ``out_dir``; their manifest.

    A null html is an empty payload, a null url gets a urn. Of equal payloads of ``revisit_bytes`` or more, the row with the
    largest page_id is the response, others revisit it; repeated rows of that page_id are responses all. Null page_ids count as
    smaller than others; if a group has no other, its rows are responses. Records of repeated rows have ids of their own. Very long
    payloads are written whole, in an archive of their own if they have more bytes than one should. An empty table gives no archive;
    other columns, whatever their names, aren't read.
    """
    spark = pages.sparkSession
    common.bounded_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_of("html").alias("html"))
    same = F.when(F.octet_length("html") >= revisit_bytes, F.sha2("html", 256))
    every = rows.select("page_id", "url", same.alias("same")).where("same is not null").groupBy("same").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
    groups = common.cut(every.where("n > 1").select("same", "n", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")))
    rows = common.looked_up(rows.withColumn("same", same), groups, "same", ["first", "first_url"], "n", BROADCAST_GROUPS)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "html", refers.alias("refers_to"), "first_url", F.sha1("html").alias("digest"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held, size, number = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush() -> pd.DataFrame:
            name = f"pages-{part:06d}-{seq:05d}.wacz"
            n = common.put_file(out_dir, name, [pack(held)])
            return pd.DataFrame([(name, len(held), n)], columns=["archive", "n_records", "n_bytes"])

        for batch in batches:
            whole = lambda c: [None if pd.isna(x) else int(x) for x in batch[c]]  # noqa: B023, E731
            for page_id, url, html, refers_to, first_url, digest in zip(whole("page_id"), batch["url"], batch["html"], whole("refers_to"), batch["first_url"], batch["digest"], strict=True):
                number += 1
                data = gzip.compress(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, f"{part}-{number}", first_url), 3, mtime=0)
                if held and size + len(data) > archive_bytes:
                    yield flush()
                    seq, size, held = seq + 1, 0, []
                held.append((f"urn:page:{page_id}", data))
                size += len(data)
        if held:
            yield flush()

    rows.mapInPandas(write, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")


def read_archives(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per record of the archives below ``out_dir``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, record_id."""
    names = spark.read.parquet(f"{out_dir}/manifest").select("archive")
    names = names.repartition(max(1, min(names.count(), READERS)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = common.file_system(out_dir)
        for batch in batches:
            for name in batch["archive"]:
                path = f"{folder}/{name}"
                with fs.open_input_file(path) as file:
                    archive = Archive(file, file.size())
                    found = [archive.record(entry) | {"payload": None, "archive": name} for entry in archive.index()]
                frame = pd.DataFrame(found).drop(columns="payload")
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return names.mapInPandas(read, RESULT)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` through the archives and back."""
    where = common.work_dir(spark, "op8")
    write_archives(common.table(spark, sf_dir, "pages"), where)
    return read_archives(spark, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in SQL.
ORACLE = """
with paid as (select page_id, url, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
grouped as (select *, max(page_id) over (partition by html) as first from paid)
select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest,
  case when n >= 1000 and page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from first then first end as refers_to from grouped
"""
