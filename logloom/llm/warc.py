"""WARC records in ZIP archives: written by Spark, read back by byte ranges.

WARC 1.1 (ISO 28500:2017); the ZIP file format with its ZIP64 extension (APPNOTE 6.3.10). An archive holds two members, both
stored and not compressed by ZIP: `pages.warc.gz`, in which every record is a gzip member of its own, and `pages.cdxj`, an
index with a line of JSON per record. As nothing is compressed twice, a record is a range of the archive.

Writing: tasks pack their rows into archives of a bounded size, one archive is one row of bytes, and Spark's text writer
puts each into a file of its own through its committer, so any file system works and a task that is repeated leaves no half
archive. The line end that the writer adds is the comment of the archive, whose length the archive declares.

Reading: the end record of an archive is found from its end, then the ZIP64 record if there is one, the central directory,
the index member, and the records it names, each by reading a range. Stores that pyarrow opens are read by ranges; for
others Spark's binary reader hands over the archives, and ranges are taken from their bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import map_rows, table
from logloom.session import new_table_path

RECORDS, INDEX = b"pages.warc.gz", b"pages.cdxj"
#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
COMMENT = b"\n"
_ZIP64_AT = 0xFFFFFFFF
_FIRST_READ = 1 << 16

WRITTEN = T.StructType([T.StructField("archive", T.BinaryType())])


# ---- records ---------------------------------------------------------------------------------------------------------


def digest32(payload: bytes) -> str:
    """Base32 of the SHA-1, in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A WARC response, or a revisit of the page `refers_to`, as a gzip member.

    A revisit has the headers of the response, Content-Length included, and no payload.
    """
    digest = digest32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",  # pages carry no time; a fixed one keeps reruns equal
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 1, mtime=0)


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def parse(member: bytes) -> dict:
    """Headers, type, payload and payload length of a record; a payload that does not match its digest is an error."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [x.split(b":")[1] for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and digest32(payload) != digest:
        raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest")
    return {"fields": fields, "type": fields["warc-type"], "payload": payload, "payload_bytes": int(lengths[0]), "digest": digest}


# ---- archives --------------------------------------------------------------------------------------------------------


def archive(members: list[tuple[bytes, bytes]], comment: bytes = b"", zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with `zip64`, or if it must, with ZIP64 sizes, offsets and end records."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        at, crc, n = len(out), zlib.crc32(data), len(data)
        big = zip64 or max(n, at) >= _ZIP64_AT
        size, extra = (_ZIP64_AT, struct.pack("<HHQQ", 1, 16, n, n)) if big else (n, b"")
        version = 45 if big else 20
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", version, 0, 0, 0, 33, crc, size, size, len(name), len(extra)) + name + extra + data
        where, more = (_ZIP64_AT, struct.pack("<HHQQQ", 1, 24, n, n, at)) if big else (at, b"")
        directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", version, version, 0, 0, 0, 33, crc, size, size, len(name), len(more), 0, 0, 0, 0, where) + name + more
    at, n, count = len(out), len(directory), len(members)
    out += directory
    if zip64 or at >= _ZIP64_AT or count >= 0xFFFF:
        end = len(out)
        out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, n, at)
        out += struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
        at, n, count = _ZIP64_AT, _ZIP64_AT, 0xFFFF
    out += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, n, at, len(comment)) + comment
    return bytes(out)


def directory(read: Callable[[int, int], bytes], length: int) -> dict[bytes, tuple[int, int, int]]:
    """Name -> (offset of the local header, length, method) of the members of an archive, by ranges.

    `read(offset, n)` returns bytes of the archive, `length` is its size. The end record is looked for from the end over a
    comment of any length; ZIP64 records and extra fields are followed where a value is at its maximum.
    """
    span = min(length, 22 + 0xFFFF + 20)
    tail = read(length - span, span)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\5\6", 0, at)  # a signature inside the comment
    if at < 0:
        raise ValueError("no ZIP archive: its end record is missing")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or size == _ZIP64_AT or start == _ZIP64_AT:
        signature, _, end = struct.unpack("<4sIQ", read(length - span + at - 20, 16))
        if signature != b"PK\6\7":
            raise ValueError("the ZIP64 locator is missing")
        count, size, start = struct.unpack_from("<QQQ", read(end, 56), 32)
    data, out, p = read(start, size), {}, 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        method, = struct.unpack_from("<H", data, p + 10)
        _, n, names, extras, comments = struct.unpack_from("<IIHHH", data, p + 20)
        where, = struct.unpack_from("<I", data, p + 42)
        name = data[p + 46 : p + 46 + names]
        extra = data[p + 46 + names : p + 46 + names + extras]
        packed, = struct.unpack_from("<I", data, p + 20)
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:  # only the values that are at their maximum, in this order
                values = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                n = values.pop(0) if n == _ZIP64_AT else n
                packed = values.pop(0) if packed == _ZIP64_AT else packed
                where = values.pop(0) if where == _ZIP64_AT else where
            extra = extra[4 + width :]
        out[name] = (where, n, method)
        p += 46 + names + extras + comments
    return out


def member_start(read: Callable[[int, int], bytes], entry: tuple[int, int, int]) -> int:
    """Offset of the first byte of a stored member."""
    at, _, method = entry
    if method:
        raise ValueError("only stored members can be read by ranges")
    names, extras = struct.unpack_from("<HH", read(at, 30), 26)
    return at + 30 + names + extras


def records_of(read: Callable[[int, int], bytes], length: int) -> Iterator[dict]:
    """Parsed records of an archive in the order of its index, each read as a range."""
    members = directory(read, length)
    index, records = members[INDEX], members[RECORDS]
    base, lines = member_start(read, records), read(member_start(read, index), index[1])
    for line in lines.decode().splitlines():
        entry = json.loads(line)
        yield parse(read(base + entry["offset"], entry["length"])) | {"page_id": entry["page_id"], "refers_to": entry.get("refers_to")}


# ---- Spark -----------------------------------------------------------------------------------------------------------


def first_copies(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least `min_bytes` bytes the smallest id is no revisit.

    Payloads are compared by SHA-1 and length. A null body is the empty payload. Rows of one id are one page: they refer to
    no other row of that id. A null id is never referred to unless all copies have it, and then they are responses.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha": F.unhex(F.sha1("payload")), "n": F.octet_length("payload")})
    several = rows.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    several = several.where("rows > 1").select(F.col("sha").alias("sha_"), F.col("n").alias("n_"), "first")
    joined = rows.join(several, (F.col("sha") == F.col("sha_")) & (F.col("n") == F.col("n_")), "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(later, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = 0, id_col: str = "page_id", body_col: str = "html") -> None:
    """Write a WARC record for every page into ZIP archives in the folder `path`, which must not exist."""

    def pack(rows: Iterator[tuple]) -> Iterator[tuple]:
        data, lines = bytearray(), []

        def closed() -> tuple:
            whole = archive([(RECORDS, bytes(data)), (INDEX, "".join(lines).encode())], COMMENT)
            return (whole[: -len(COMMENT)],)  # the writer adds it

        for page_id, url, payload, refers_to in rows:
            member = record(page_id, url, payload, refers_to)
            entry = {"page_id": page_id, "offset": len(data), "length": len(member)}
            lines.append(json.dumps(entry if refers_to is None else entry | {"refers_to": refers_to}) + "\n")
            data += member
            if len(data) >= archive_bytes:
                yield closed()
                data, lines = bytearray(), []
        if lines:
            yield closed()

    packed = map_rows(first_copies(pages, min_bytes, id_col, body_col), WRITTEN, pack, size=1)
    # a cast of bytes to text keeps the bytes as they are
    packed.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", COMMENT.decode()).text(path)


def _ranges(uri: str) -> tuple[Callable[[int, int], bytes], int]:
    """Range reader and size of a file of a store that pyarrow opens."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    file = store.open_input_file(path)
    return lambda at, n: file.read_at(n, at), file.size()


def read_archives(spark: SparkSession, path: str, reader: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of all records in the archives of a folder.

    reader: "ranges" opens the archives in the tasks and reads ranges, for stores of the schemes file, s3, gs and hdfs;
    "spark" lets Spark load each archive, for all others; by default the scheme of the path decides. payload is null for
    revisits. An archive that is no ZIP file, or a record that does not match its digest, fails the job.
    """
    if reader is None:
        reader = "ranges" if urlsplit(path).scheme in ("", "file", "s3", "gs", "hdfs") else "spark"
    schema = T.StructType(
        [
            T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
            T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
        ]
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def rows(inputs: Iterable[tuple]) -> Iterator[tuple]:
        for (given,) in inputs:
            if isinstance(given, bytes):
                read, length = (lambda at, n, data=given: data[at : at + n]), len(given)
            else:
                read, length = _ranges(given if "://" in given else given.replace("file:/", "file:///", 1))
            for r in records_of(read, length):
                payload = r["payload"] if r["type"] == "response" else None
                yield r["page_id"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"], payload

    return map_rows(files.select("path" if reader == "ranges" else "content"), schema, rows, size=256)


def op6_warc_in_zip(spark, sf_dir: str) -> DataFrame:
    """Every page as the archives have it."""
    path = new_table_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("payload")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, list_transform(range(40), lambda i: instr('0123456789abcdef', hex[i + 1]) - 1) AS nib FROM p
), c AS (
  SELECT *, flatten(list_transform(nib, lambda v: [v // 8 % 2, v // 4 % 2, v // 2 % 2, v % 2])) AS bits FROM b
), d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         (bits[5 * i + 1] * 16 + bits[5 * i + 2] * 8 + bits[5 * i + 3] * 4 + bits[5 * i + 4] * 2 + bits[5 * i + 5] + 1)::INT]), '') AS b32,
         min(page_id) OVER (PARTITION BY html) AS first
  FROM c
)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to
FROM d
"""
