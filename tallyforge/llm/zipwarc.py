"""WARC records in ZIP-packaged archives: writing, locating through the directories, and reading by ranges.

An archive is a ZIP file whose members are stored, not compressed: archive/data.warc.gz (a gzip member per record) and
indexes/index.jsonl.gz (a line per record: id, offset and length in the member). A reader needs the end of the file for
the central directory, then the index, then one range per record; nothing is extracted."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise, shared_dir, ship

#: Fixed values of the ZIP format: signatures of the local header, central header, end record, and ZIP64's end record and locator.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
#: What a URI may hold as it is, and the head of each response.
URI_SAFE = ":/?#[]@!$&'()*+,;=-._~%"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
WARC_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.jsonl.gz"
#: Payloads under this many bytes are never revisits.
LEAST_REVISIT = 100


class ZipWriter:
    """Stored members written front to back. ZIP64 fields are written wherever a size, a place or a count doesn't fit,
    and for every member if `zip64`."""

    def __init__(self, out: BinaryIO, zip64: bool = False) -> None:
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, pieces: list[bytes]) -> None:
        raw, place = name.encode(), self.at
        size = sum(map(len, pieces))
        crc = 0
        for p in pieces:
            crc = zlib.crc32(p, crc)
        wide = self.zip64 or size >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        held = FULL32 if wide else size
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, held, held, len(raw), len(extra)) + raw + extra)
        for p in pieces:
            self._put(p)
        self.members.append((raw, crc, size, place))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, place in self.members:
            wide = self.zip64 or size >= FULL32 or place >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, place) if wide else b""
            s, p = (FULL32, FULL32) if wide else (size, place)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, p) + raw + extra)
        length, n = self.at - begin, len(self.members)
        if self.zip64 or n >= FULL16 or begin >= FULL32 or length >= FULL32:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, begin))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            n, length, begin = FULL16, FULL32, FULL32
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, length, begin, 0))


def _range(f, at: int, n: int) -> bytes:
    f.seek(at)
    out = f.read(n)
    if len(out) != n:
        raise ValueError("the archive ends early")
    return out


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Members by name: place of the data, its length, its CRC-32. Reads the archive's tail, its central directory, and
    the fixed part of each local header. Compressed or encrypted members are refused."""
    tail_at = max(0, size - 22 - FULL16 - 20)
    tail = _range(f, tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (len(tail) - at < 22 or struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, begin = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == n or FULL32 in (length, begin):
        sig, _, end64, _ = struct.unpack("<IIQI", _range(f, tail_at + at - 20, 20))
        if sig != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        sig, *_, n, length, begin = struct.unpack("<IQHHIIQQQQ", _range(f, end64, 56))
        if sig != END64:
            raise ValueError("no ZIP64 end of central directory")
    raw, at, members = _range(f, begin, length), 0, {}
    for _ in range(n):
        sig, _, _, flags, method, _, _, crc, packed, plain, names, extras, notes, _, _, _, place = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if sig != CENTRAL:
            raise ValueError("not a central directory entry")
        name = raw[at + 46 : at + 46 + names].decode()
        extra, e = raw[at + 46 + names : at + 46 + names + extras], 0
        while e + 4 <= len(extra):
            kind, wide = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                more = iter(struct.unpack_from(f"<{wide // 8}Q", extra, e + 4))
                plain, packed, place = (next(more) if v == FULL32 else v for v in (plain, packed, place))
            e += 4 + wide
        if method or flags & 1 or packed != plain:
            raise ValueError(f"{name} is not a stored member")
        sig, *_, names_, extras_ = struct.unpack("<IHHHHHIIIHH", _range(f, place, 30))
        if sig != LOCAL:
            raise ValueError(f"no local header of {name}")
        members[name] = (place + 30 + names_ + extras_, plain, crc)
        at += 46 + names + extras + notes
    return members


def record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """A WARC/1.1 record: an HTTP response with the payload, or a revisit, which holds its head alone; the record's header
    keeps the payload's length and digest and whom it repeats. A null url has no header; characters that a URI can't hold
    are escaped."""
    named = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {named(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=URI_SAFE)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(body)}",
    ]
    if is_revisit:
        head += [f"WARC-Refers-To: {named(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    content = HTTP_HEAD + (b"" if is_revisit else body)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}", "", ""]
    return "\r\n".join(head).encode() + content + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k: v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not hold")
    _, found, payload = rest[:n].partition(b"\r\n\r\n")
    if not found:
        raise ValueError("a record's HTTP head does not end")
    return headers, payload


#: Bytes of compressed records after which a task begins another archive: what it holds at a time.
ARCHIVE_BYTES = 64 << 20


def _write(batches: Iterator[pa.RecordBatch], at: str, most: int) -> Iterator[pa.RecordBatch]:
    gz, lines, place, made = [], [], 0, 0

    def archive() -> pa.RecordBatch:
        store, folder = fs.FileSystem.from_uri(at)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{made:04d}-{uuid.uuid4().hex[:8]}.wacz"
        with store.open_output_stream(f"{folder}/{name}") as f:
            z = ZipWriter(f)
            z.add(WARC_NAME, gz)
            z.add(INDEX_NAME, [gzip.compress("\n".join(lines).encode(), 6, mtime=0)])
            z.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{at}/{name}"]), pa.array([len(gz)])], ["path", "n"])

    for b in batches:
        for page, url, body, digest, keeper, revisit in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            one = gzip.compress(record(page, url, body, digest, keeper, revisit), 1, mtime=0)
            gz.append(one)
            lines.append(json.dumps({"page_id": page, "offset": place, "length": len(one)}))
            place += len(one)
            if place >= most:
                yield archive()
                gz, lines, place, made = [], [], 0, made + 1
    if gz:
        yield archive()


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive in any store, each by a range of its own."""
    store, p = fs.FileSystem.from_uri(path)
    with store.open_input_file(p) as f:
        members = directory(f, f.size())
        at, n, crc = members[INDEX_NAME]
        index = _range(f, at, n)
        if zlib.crc32(index) != crc:
            raise ValueError("the index does not match its checksum")
        base, total, _ = members[WARC_NAME]
        for line in gzip.decompress(index).splitlines():
            entry = json.loads(line)
            if entry["offset"] + entry["length"] > total:
                raise ValueError("a record lies outside its member")
            yield parse(gzip.decompress(_range(f, base + entry["offset"], entry["length"])))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for b in batches:
        for path in b.column(0).to_pylist():
            rows = []
            for head, content in read_archive(path):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(content).hexdigest() != digest:
                    raise ValueError("a payload does not match its digest")
                rows.append((_page(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), digest, kind, _page(head["WARC-Refers-To"]) if kind == "revisit" else None))
                if len(rows) == 5000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)


def write_archives(pages: DataFrame, at: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page into archives under `at` (a folder all executors share): path, n of each archive, which ends at `archive_bytes`.

    The smallest id of each payload of at least LEAST_REVISIT bytes is found by a partial aggregate over digests and
    joined back; a payload that is most of the table crosses the shuffle as digests only, and the join's hot key can be
    split. Null html is an empty payload. Among rows that repeat the smallest id all are responses. A null id is never
    pointed to unless all of its group are null; the null rows are then all responses. A very
    long payload is one record. Other columns are ignored; an empty table writes nothing."""
    spark = pages.sparkSession
    ship(spark)
    at = at or shared_dir(spark, "archives")
    rows = pages.select(F.col(id_col).alias("doc_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    firsts = rows.filter(F.octet_length("body") >= LEAST_REVISIT).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    firsts = materialise(firsts.select("digest", "first"), "firsts")
    revisit = F.coalesce(~F.col("first").eqNullSafe(F.col("doc_id")) & F.col("first").isNotNull(), F.lit(False))
    judged = rows.join(firsts, "digest", "left").select("doc_id", "url", "body", "digest", F.when(revisit, F.col("first")).alias("keeper"), revisit.alias("revisit"))
    return materialise(judged.mapInArrow(lambda it: _write(it, at, archive_bytes), "path string, n long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to of each record."""
    n = max(1, archives.count())
    return archives.select("path").repartition(n, "path").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
