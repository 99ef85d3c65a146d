"""WARC records in ZIP packages, read by range without extraction.

A package is a ZIP file with two stored members: `archive/data.warc.gz` with the records, each a
gzip member of its own, and `indexes/records.idx` with a line of offset and length for each. The reader finds members by
the central directory (with ZIP64 fields where they are used), takes the index, and reads
records by their ranges. Of pages with equal payloads the one with the largest page_id is a
response, the others are revisits of it without a payload.

Defined cases: a null html is an empty payload; a null url is left out; a null page_id is smaller than any
other. Rows that repeat the page_id of a response with the same payload are responses too.
An empty table gives no package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatstrata.llm.token_files import file_system
from chatstrata.session import scratch_path, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/records.idx"
PACKAGE_BYTES = 1 << 30
COMPRESSION = 2
READ_BYTES = 1 << 22
# Records of a package are read by tasks in stretches of this size.
STRETCH_BYTES = 1 << 25

# Fixed values of the ZIP format: signatures, record layouts, the marks of ZIP64.
END_SIGNATURE, END = b"PK\x05\x06", struct.Struct("<4s4H2LH")
END64_LOCATOR_SIGNATURE, END64_LOCATOR = b"PK\x06\x07", struct.Struct("<4sLQL")
END64_SIGNATURE, END64 = b"PK\x06\x06", struct.Struct("<4sQ2H2L4Q")
ENTRY_SIGNATURE, ENTRY = b"PK\x01\x02", struct.Struct("<4s6H3L5H2L")
LOCAL_SIGNATURE, LOCAL = b"PK\x03\x04", struct.Struct("<4s5H3L2H")
IN_ZIP64, ZIP64_EXTRA, STORED = 0xFFFFFFFF, 1, 0
# Fixed values of the WARC format.
VERSION, LINE = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that keeps the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    head = [VERSION, *(f"{name}: {value}".encode("utf-8", "surrogatepass") for name, value in fields)]
    return LINE.join(head) + LINE + LINE + block + LINE + LINE


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload, payload_bytes and payload_digest of one record."""
    head, _, rest = data.partition(LINE + LINE)
    version, *lines = head.split(LINE)
    if version != VERSION:
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(line.decode("utf-8", "surrogatepass").split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(LINE + LINE)
    size = next(int(line[15:]) for line in http.split(LINE) if line.startswith(b"Content-Length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": _page_id(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": digest,
    }


@dataclass
class Member:
    name: str
    method: int
    size: int
    header_offset: int


class Package:
    """The directory of a ZIP file of which any range can be read."""

    def __init__(self, file, size: int):
        self.file = file
        tail_start = max(0, size - END.size - 0xFFFF)
        tail = self.range(tail_start, size - tail_start)
        at = tail.rfind(END_SIGNATURE)
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, entries, length, start, _ = END.unpack_from(tail, at)
        locator = at - END64_LOCATOR.size
        if locator >= 0 and tail[locator : locator + 4] == END64_LOCATOR_SIGNATURE:
            end64 = END64_LOCATOR.unpack_from(tail, locator)[2]
            found = END64.unpack(self.range(end64, END64.size))
            if found[0] != END64_SIGNATURE:
                raise ValueError("no ZIP64 end of central directory")
            entries, length, start = found[7:10]
        self.members = {m.name: m for m in self._entries(self.range(start, length), entries)}

    def range(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("the file ends early")
        return data

    @staticmethod
    def _entries(directory: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            found = ENTRY.unpack_from(directory, at)
            if found[0] != ENTRY_SIGNATURE:
                raise ValueError("damaged central directory")
            method, packed, size = found[4], found[8], found[9]
            name_size, extra_size, comment_size, offset = found[10], found[11], found[12], found[16]
            name_at = at + ENTRY.size
            name = directory[name_at : name_at + name_size].decode("utf-8")
            extra = directory[name_at + name_size : name_at + name_size + extra_size]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == ZIP64_EXTRA:
                    # only the fields that did not fit, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    size = next(values) if size == IN_ZIP64 else size
                    packed = next(values) if packed == IN_ZIP64 else packed
                    offset = next(values) if offset == IN_ZIP64 else offset
                extra = extra[4 + length :]
            yield Member(name, method, size, offset)
            at = name_at + name_size + extra_size + comment_size

    def start_of(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        member = self.members[name]
        if member.method != STORED:
            raise ValueError(f"{name} is compressed")
        header = LOCAL.unpack(self.range(member.header_offset, LOCAL.size))
        if header[0] != LOCAL_SIGNATURE:
            raise ValueError("damaged local header")
        return member.header_offset + LOCAL.size + header[9] + header[10]

    def read(self, name: str) -> bytes:
        return self.range(self.start_of(name), self.members[name].size)


class PackageWriter:
    """Records streamed into one package."""

    def __init__(self, sink):
        self.package = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.package.open(DATA, "w", force_zip64=True)
        self.size, self.index = 0, io.StringIO()

    def add(self, data: bytes) -> None:
        self.index.write(f"{self.size} {len(data)}\n")
        self.data.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.data.close()
        self.package.writestr(INDEX, self.index.getvalue())
        self.package.close()


def _payload(name: str = "html") -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, revisit and refers_to; payloads below `least_bytes` are never revisited."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    keyed = pages.withColumn("_sha1", F.sha1(_payload()))
    found = keyed.where(F.octet_length(_payload()) >= least_bytes).select("page_id", "_sha1")
    best = found.groupBy("_sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1")
    revisits = found.join(best, "_sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("_sha1").alias("_digest"), "refers_to").distinct()
    # by page, not by payload: a payload that many pages share is spread over all tasks
    same = keyed.page_id.eqNullSafe(F.col("_id")) & (F.col("_sha1") == F.col("_digest"))
    joined = keyed.join(revisits, same, "left")
    return joined.select("page_id", "url", "html", F.col("_digest").isNotNull().alias("revisit"), "refers_to")


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Writes packages of records (as of `with_revisits`); returns the staged list of those that count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        paths: list[str] = []
        writer = sink = None
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    store.create_dir(root, recursive=True)
                    paths.append(f"{root}/pages-{uuid.uuid4().hex}.zip")
                    sink = store.open_output_stream(paths[-1])
                    writer = PackageWriter(sink)
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                whole = record(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"])
                writer.add(gzip.compress(whole, COMPRESSION, mtime=0))
                if writer.size >= PACKAGE_BYTES:
                    writer.close()
                    sink.close()
                    writer = None
        if writer is not None:
            writer.close()
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return staged(records.mapInArrow(write, "path string"), "packages")


def read_packages(packages: DataFrame, folder: str) -> DataFrame:
    """The records of packages: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as file:
                    package = Package(file, file.size())
                    start, lines = package.start_of(DATA), package.read(INDEX).split(b"\n")[:-1]
                at, size = ([int(line.split()[i]) for line in lines] for i in (0, 1))
                columns = [pa.array([path] * len(at), pa.string()), pa.array([start + a for a in at], pa.int64()), pa.array(size, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "at", "size"])

    fields = [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        path = file = None
        for batch in batches:
            rows = batch.to_pylist()
            first = 0
            while first < len(rows):
                if rows[first]["path"] != path:
                    if file is not None:
                        file.close()
                    path = rows[first]["path"]
                    file = store.open_input_file(path)
                after = first + 1
                start, end = rows[first]["at"], rows[first]["at"] + rows[first]["size"]
                while after < len(rows) and (r := rows[after])["path"] == path and r["at"] == end and r["at"] + r["size"] - start <= READ_BYTES:
                    end += r["size"]
                    after += 1
                file.seek(start)
                data = file.read(end - start)
                spans = [(r["at"] - start, r["at"] - start + r["size"]) for r in rows[first:after]]
                parsed = [parse_record(gzip.decompress(data[a:b])) for a, b in spans]
                yield pa.RecordBatch.from_pylist(parsed, schema=schema)
                first = after
        if file is not None:
            file.close()

    files = max(1, packages.count())
    index = packages.repartition(files, "path").mapInArrow(indexed, "path string, at long, size long")
    stretches = index.repartition("path", F.floor(F.col("at") / STRETCH_BYTES)).sortWithinPartitions("path", "at")
    types = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    return stretches.mapInArrow(read, types)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages written as packages to the shared folder and read back."""
    folder = scratch_path(spark, "warc")
    return read_packages(write_packages(with_revisits(pages, least_bytes), folder), folder)
