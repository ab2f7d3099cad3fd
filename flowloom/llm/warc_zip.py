"""WARC records kept in ZIP packages, and a reader that takes them out by range.

A package is a ZIP file with one stored member of WARC records, each compressed
by itself, and one stored index of where each record begins.  Tasks write packages of about ``PACKAGE``
bytes straight to the shared folder and hand back their paths; what the written
list of paths names is the truth, so a task that ran twice leaves a file that
nobody reads.

The reader needs no extraction.  One task per package reads the end of the
file, the central directory (plain or ZIP64) and the indexes, stored or deflated.
An archive member that no index covers to its last byte is walked record by record
instead, by ranges.  The records then are rows of (path, offset, length), dealt
out by the bytes to read, and each is read by its byte range and checked against
its digest.  An archive member that was compressed by the package cannot be read
by range and raises an error, so that no record is left out in silence.

Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
largest id is the response and the others revisit it.

* NULL html is an empty payload.  A NULL page id ranks lowest; a page of NULL
  id is a response only where all its copies have none.  A NULL url leaves the target out.
* Pages equal in id and payload are alike: all are responses, or all revisits.
* A record without a payload digest has NULL there and in ``valid``; one that was written by
  other software has a NULL page id.
* An empty table gives no package and no record.  Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import query, table
from flowloom.operators.lineage import cut
from flowloom.sources.sinks import scratch_path

PACKAGE = 64_000_000
LEVEL = 3
BROADCAST_HOMES = 500_000
# Bytes that a reading task takes, and that are held at a time when a member is walked.
READ = 16_000_000
STEP = 1_000_000
RECORDS = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Signatures of the ZIP format.
_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_STORED, _DEFLATED = 0, 8
_GZIP = b"\x1f\x8b"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(urn: str | None) -> int | None:
    parts = urn.strip("<>").split(":") if urn else []
    return int(parts[2]) if parts[1:2] == ["page"] and parts[2] else None


def make_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, home: tuple | None
) -> bytes:
    """One record; ``home`` holds the id of the page that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if home is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if home is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: {_urn(page_id, digest)}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if home is not None:
        head += [f"WARC-Refers-To: {_urn(home[0], digest)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers of a record (names in lower case), its HTTP headers and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    warc = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in http.decode().split("\r\n")[1:])
    return {"warc": warc, "http": {k.lower(): v.strip() for k, _, v in fields}, "payload": payload}


class _Package:
    """A ZIP file being written to a stream that cannot go back."""

    def __init__(self, folder: str) -> None:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.zip"
        self.path = f"{folder}/{name}"
        self.stream = fs.open_output_stream(f"{base}/{name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, key: str, record: bytes) -> None:
        record = gzip.compress(record, compresslevel=LEVEL, mtime=0)
        self.member.write(record)
        self.index.append(f"{key} {json.dumps({'offset': self.size, 'length': len(record), 'filename': RECORDS})}")
        self.size += len(record)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index)


def write_packages(
    pages: DataFrame, folder: str, least_bytes: int = 0, package: int = PACKAGE
) -> DataFrame:
    """Write all pages; returns the written list of packages: ``path`` and ``records``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")
    ).withColumns({"sha1": F.sha1("payload"), "n": F.length("payload")})
    homes = cut(
        rows.filter(F.col("n") >= least_bytes)
        .groupBy("sha1", "n")
        .agg(F.max("page_id").alias("home"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .withColumn("repeated", F.lit(True))
        .drop("copies")
    )
    # A row is about 100 bytes.  A longer list is shuffled, with the pages.
    known = F.broadcast(homes) if homes.count() <= BROADCAST_HOMES else homes
    marked = rows.join(known, ["sha1", "n"], "left").withColumn(
        "revisit", F.coalesce("repeated", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("home"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, current = [], None
        for batch in batches:
            for r in batch.to_pylist():
                current = current or _Package(folder)
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                home = (r["home"],) if r["revisit"] else None
                current.add(digest, make_record(r["page_id"], r["url"], r["payload"], digest, home))
                if current.size >= package:
                    done.append(current.close())
                    current = None
        if current:
            done.append(current.close())
        if done:
            paths, counts = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), pa.array(counts, pa.int64())], ["path", "records"]
            )

    shown = marked.select("page_id", "url", "payload", "sha1", "home", "revisit")
    return cut(shown.mapInArrow(write, "path string, records long"))


class RangeReader:
    """Byte ranges of one file on any file system."""

    def __init__(self, path: str) -> None:
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise EOFError(f"{length} bytes at {offset} go past the end")
        return data


def _directory(reader: RangeReader) -> tuple[int, int, int]:
    """Offset, size and number of entries of the central directory."""
    tail_at = max(0, reader.size - 22 - 0xFFFF)
    tail = reader.read(tail_at, reader.size - tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    entries, size, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    if _FULL16 in (entries,) or _FULL32 in (size, offset):
        at = tail_at + end - 20
        locator = reader.read(at, 20) if at >= 0 else b""
        if not locator.startswith(_LOCATOR64):
            raise ValueError("sizes are in a ZIP64 record, which has no locator")
        (record_at,) = struct.unpack("<Q", locator[8:16])
        record = reader.read(record_at, 56)
        if not record.startswith(_END64):
            raise ValueError("no ZIP64 end record where its locator points")
        entries, size, offset = struct.unpack("<QQQ", record[32:56])
    return offset, size, entries


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Fill in those of (size, packed size, offset) that are in the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            body, k = extra[at + 4 : at + 4 + length], 0
            for i, value in enumerate(values):
                if value == _FULL32:
                    (values[i],) = struct.unpack("<Q", body[k : k + 8])
                    k += 8
        at += 4 + length
    return values


def entries(reader: RangeReader) -> Iterator[tuple[str, int, int, int]]:
    """Name, method, offset of the data and bytes held of every member."""
    offset, size, count = _directory(reader)
    data, at = reader.read(offset, size), 0
    for _ in range(count):
        if data[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack("<H", data[at + 10 : at + 12])[0]
        packed, plain = struct.unpack("<II", data[at + 20 : at + 28])
        names, extras, comments = struct.unpack("<HHH", data[at + 28 : at + 34])
        (start,) = struct.unpack("<I", data[at + 42 : at + 46])
        name = data[at + 46 : at + 46 + names].decode()
        extra = data[at + 46 + names : at + 46 + names + extras]
        plain, packed, start = _wide(extra, [plain, packed, start])
        at += 46 + names + extras + comments
        local = reader.read(start, 30)
        if not local.startswith(_LOCAL):
            raise ValueError(f"no local header for {name}")
        own_name, own_extra = struct.unpack("<HH", local[26:30])
        yield name, method, start + 30 + own_name + own_extra, packed


def members(reader: RangeReader) -> dict[str, tuple[int, int]]:
    """Name to (offset of the data, size) of every stored member."""
    return {name: (at, size) for name, method, at, size in entries(reader) if method == _STORED}


def _index_text(reader: RangeReader, name: str, method: int, at: int, size: int) -> str:
    data = reader.read(at, size)
    if method == _DEFLATED:
        data = zlib.decompress(data, -zlib.MAX_WBITS)
    elif method != _STORED:
        raise ValueError(f"{name}: compression method {method} is not known")
    return (gzip.decompress(data) if name.endswith(".gz") else data).decode()


def _indexed(text: str) -> Iterator[tuple[str, int, int]]:
    """Archive member, offset and length of each record that an index lists."""
    for line in text.split("\n"):
        fields, mark, body = line.partition("{")
        if mark:
            at = json.loads(mark + body)
            name = at["filename"]
            yield name if "/" in name else f"archive/{name}", int(at["offset"]), int(at["length"])


def walk(reader: RangeReader, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of every record of an archive member, each a gzip member or plain."""
    at, end = start, start + size
    while at < end:
        packed = reader.read(at, min(2, end - at)) == _GZIP
        length = (_gzip_length if packed else _plain_length)(reader, at, end)
        yield at, length
        at += length


def _gzip_length(reader: RangeReader, at: int, end: int) -> int:
    unpack, place = zlib.decompressobj(zlib.MAX_WBITS | 16), at
    while not unpack.eof:
        if place >= end:
            raise EOFError(f"the record at {at} goes past its member")
        data = reader.read(place, min(STEP, end - place))
        place += len(data)
        while data and not unpack.eof:
            unpack.decompress(data, STEP)
            data = unpack.unconsumed_tail
    return place - len(unpack.unused_data) - at


def _plain_length(reader: RangeReader, at: int, end: int) -> int:
    head = b""
    while b"\r\n\r\n" not in head:
        if at + len(head) >= end:
            raise EOFError(f"the record at {at} goes past its member")
        head += reader.read(at + len(head), min(4096, end - at - len(head)))
    head = head[: head.index(b"\r\n\r\n") + 4]
    if not head.startswith(b"WARC/1."):
        raise ValueError(f"no WARC record at {at}")
    lines = (line.partition(":") for line in head.decode().split("\r\n"))
    (body,) = (int(v) for k, _, v in lines if k.lower() == "content-length")
    length = len(head) + body + 4
    if at + length > end:
        raise EOFError(f"the record at {at} goes past its member")
    return length


def package_records(reader: RangeReader) -> Iterator[tuple[int, int]]:
    """Offset and length of every record of a package."""
    archives, listed = {}, {}
    for name, method, at, size in entries(reader):
        if name.startswith("archive/") and name.endswith((".warc", ".warc.gz")):
            if method != _STORED:
                raise ValueError(f"{name} is compressed by its package and cannot be read by range")
            archives[name] = (at, size)
        elif name.startswith("indexes/") and name.removesuffix(".gz").endswith((".cdx", ".cdxj")):
            for member, offset, length in _indexed(_index_text(reader, name, method, at, size)):
                listed.setdefault(member, {})[offset] = length
    missing = sorted(set(listed) - set(archives))
    if missing:
        raise ValueError(f"an index names {missing[0]}, which the package does not hold")
    for name, (at, size) in archives.items():
        own = listed.get(name, {})
        if sum(own.values()) == size:
            yield from ((at + offset, length) for offset, length in own.items())
        else:
            yield from walk(reader, at, size)


def locate_records(packages: DataFrame) -> DataFrame:
    """``path``, ``offset`` and ``length`` of every record of the packages."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = list(package_records(RangeReader(path)))
                if rows:
                    offsets, lengths = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * len(rows)),
                            pa.array(offsets, pa.int64()),
                            pa.array(lengths, pa.int64()),
                        ],
                        ["path", "offset", "length"],
                    )

    n = packages.count()
    spread = packages.select("path").repartition(max(1, min(n, 10_000)))
    return cut(spread.mapInArrow(locate, "path string, offset long, length long"))


def read_records(located: DataFrame, payloads: bool = True) -> DataFrame:
    """Every located record with its fields; ``valid`` says whether its payload has its digest."""

    def fields(data: bytes) -> dict:
        found = parse_record(gzip.decompress(data) if data.startswith(_GZIP) else data)
        warc, kind = found["warc"], found["warc"].get("warc-type")
        digest = warc.get("warc-payload-digest", "").partition(":")[2] or None
        valid = digest and (kind == "revisit" or base32_sha1(found["payload"]) == digest)
        return {
            "page_id": _page_of(warc.get("warc-record-id")),
            "url": warc.get("warc-target-uri"),
            "record_type": kind,
            "payload_bytes": int(found["http"].get("content-length", len(found["payload"]))),
            "payload_digest": digest,
            "refers_to": _page_of(warc.get("warc-refers-to")),
            "valid": valid,
            "payload": found["payload"] if payloads and kind != "revisit" else None,
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path = None, None
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                if r["path"] != path:
                    reader, path = RangeReader(r["path"]), r["path"]
                rows.append(fields(reader.read(r["offset"], r["length"])))
                held += len(rows[-1]["payload"] or b"")
                if held >= READ:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    shape = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("refers_to", pa.int64()),
            ("valid", pa.bool_()),
            ("payload", pa.binary()),
        ]
    )
    located = cut(located)
    size = located.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-size // READ), 50_000))
    dealt = located.repartition(tasks, "path", F.floor(F.col("offset") / 4_000_000))
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(
        read,
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string,"
        " refers_to long, valid boolean, payload binary",
    )


# Five hex digits are four base32 digits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body))::BIGINT AS n, sha1(body) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS home FROM h)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER,
         1)), '') AS payload_digest,
       CASE WHEN page_id = home THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> home THEN home END AS refers_to, true AS valid
FROM g
"""


@query("op4_warc_zip", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(table(spark, sf_dir, "pages"), scratch_path(spark, "packages"))
    return read_records(locate_records(packages), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"
    )
