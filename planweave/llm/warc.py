"""WARC records in ZIP packages: written shard by shard, read back through the ZIP directories by range."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.common import bounded_batches, partitions, shared_folder, written

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Bytes after which a task begins another archive, bytes of records in a read, and how hard records are packed.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 8 << 20
GZIP_LEVEL = 1
#: Most revisits that are broadcast: a hash of 64 digits and two ids each.
SENT_REVISITS = 100_000
DATE = "2024-01-01T00:00:00Z"

LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MANY = 0xFFFFFFFF


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but keeps its digest and length."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


class ZipWriter:
    """A ZIP of stored members, written front to back with ZIP64 sizes."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.members = sink, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: list[bytes]) -> None:
        crc = size = 0
        for c in chunks:
            crc, size = zlib.crc32(c, crc), size + len(c)
        raw = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, size, size)
        self.members.append((raw, crc, size, self.at))
        self._put(struct.pack("<4s5H3I2H", LOCAL, 45, 0x800, 0, 0, 0x21, crc, MANY, MANY, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            self._put(c)

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._put(struct.pack("<4s6H3I5H2I", CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, MANY, MANY, len(raw), len(extra), 0, 0, 0, 0, MANY) + raw + extra)
        size, end64, n = self.at - start, self.at, len(self.members)
        self._put(struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sIQI", LOCATOR64, 0, end64, 1))
        self._put(struct.pack("<4s4H2IH", END, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, MANY), MANY, 0))


@dataclass
class Member:
    name: str
    size: int
    stored: bool
    header_at: int


class ZipArchive:
    """A ZIP read by ranges: the end record, ZIP64 or not, the central directory, then members in place."""

    def __init__(self, file) -> None:
        self.file, self.size = file, file.size()
        tail_at = max(0, self.size - (1 << 16) - 22)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(END)
        if end < 0:
            raise ValueError("no end of central directory")
        count, size, start = struct.unpack_from("<H2I", tail, end + 10)
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == LOCATOR64 and (MANY in (size, start) or count == 0xFFFF):
            (end64,) = struct.unpack_from("<Q", tail, locator + 8)
            head = self.read(end64, 56)
            if head[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, size, start = struct.unpack_from("<3Q", head, 32)
        self.members = {m.name: m for m in self._directory(self.read(start, size), count)}

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    @staticmethod
    def _directory(data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, packed, size, n_name, n_extra, n_comment = *struct.unpack_from("<H", data, at + 10), *struct.unpack_from("<2I3H", data, at + 20)
            (offset,) = struct.unpack_from("<I", data, at + 42)
            (flags,) = struct.unpack_from("<H", data, at + 8)
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, i = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while i + 4 <= len(extra):
                kind, n = struct.unpack_from("<2H", extra, i)
                if kind == 1:  # only the fields that don't fit stand here, in this order
                    wide, j = extra[i + 4 : i + 4 + n], 0
                    if size == MANY:
                        (size,), j = struct.unpack_from("<Q", wide, j), j + 8
                    if packed == MANY:
                        j += 8
                    if offset == MANY:
                        (offset,) = struct.unpack_from("<Q", wide, j)
                i += 4 + n
            yield Member(name, size, method == 0, offset)
            at += 46 + n_name + n_extra + n_comment

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if not m.stored:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.read(m.header_at, 30)
        return m.header_at + 30 + sum(struct.unpack_from("<2H", head, 26))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Spark would take."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's file system; Hadoop's names of stores are turned into pyarrow's."""
    scheme, apart, rest = folder.partition(":")
    folder = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "wasbs": "abfss"}.get(scheme, scheme) + apart + rest
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def _write(folder: str):
    """Writes a task's records as archives and returns their names. Names are new each time, and only those that
    a finished task returned are ever read, so a task that runs again is harmless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        records: list[bytes] = []
        index: list[str] = []
        at = 0
        names: list[str] = []

        def flush() -> None:
            nonlocal at
            name = f"pages-{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{path}/{name}") as sink:
                archive = ZipWriter(sink)
                archive.add("archive/pages.warc.gz", records)
                archive.add("indexes/pages.cdxj", ["".join(index).encode()])
                archive.close()
            names.append(name)
            records.clear()
            index.clear()
            at = 0

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), *(batch.column(i).to_pylist() for i in (3, 4)), strict=True):
                # each record is a gzip member of its own, so that any can be read alone
                data = gzip.compress(record(page_id, url, payload.as_py(), digest, refers_to), GZIP_LEVEL, mtime=0)
                records.append(data)
                index.append(json.dumps({"offset": at, "length": len(data), "filename": "pages.warc.gz"}) + "\n")
                at += len(data)
                if at > ARCHIVE_BYTES:
                    flush()
        if records:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return run


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, body[: int(fields["Content-Length"])]


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def indexed(archive: ZipArchive) -> dict[str, list[tuple[int, int]]]:
    """(offset, length) of the records of every archive in the package, by the archive's file name: what the index
    members say, lines that end in a JSON object."""
    found: dict[str, list[tuple[int, int]]] = {}
    for name, member in archive.members.items():
        if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
            data = archive.read(archive.start(name), member.size)
            for line in (gzip.decompress(data) if name.endswith(".gz") else data).decode().splitlines():
                if "{" in line:
                    entry = json.loads(line[line.index("{") :])
                    if "offset" in entry:
                        found.setdefault(entry.get("filename", ""), []).append((int(entry["offset"]), int(entry["length"])))
    return {name: sorted(spans) for name, spans in found.items()}


def scanned(archive: ZipArchive, base: int, size: int) -> Iterator[bytes]:
    """The records of an archive without an index, one gzip member after the other."""
    at, inflate, parts = 0, zlib.decompressobj(31), []
    while at < size:
        data = archive.read(base + at, min(READ_BYTES, size - at))
        at += len(data)
        while data:
            parts.append(inflate.decompress(data))
            if not inflate.eof:
                break
            yield b"".join(parts)
            data, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []


def in_ranges(archive: ZipArchive, base: int, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    """The records at ``spans``; neighbours of up to READ_BYTES together are read at once."""
    i = 0
    while i < len(spans):
        first, end, j = spans[i][0], sum(spans[i]), i + 1
        while j < len(spans) and sum(spans[j]) - first <= READ_BYTES:
            end, j = sum(spans[j]), j + 1
        data = archive.read(base + first, end - first)
        for offset, length in spans[i:j]:
            yield gzip.decompress(data[offset - first : offset - first + length])
        i = j


KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())


def _read(folder: str, payloads: bool):
    def rows_of(name: str, archive: ZipArchive) -> Iterator[tuple]:
        index = indexed(archive)
        for member in archive.members.values():
            if not member.name.endswith(".warc.gz"):
                continue
            base, spans = archive.start(member.name), index.get(member.name.rsplit("/", 1)[-1])
            for data in in_ranges(archive, base, spans) if spans else scanned(archive, base, member.size):
                fields, body = parse_record(data)
                if fields["WARC-Type"] not in ("response", "revisit", "resource"):
                    continue
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or hashlib.sha1(body).hexdigest()
                if not revisit and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"{name}: a payload does not match its digest")
                size = int(fields.get("WARC-Payload-Length", len(body))) if revisit else len(body)
                yield _page(fields.get("WARC-Record-ID", "")), size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To", "")) if revisit else None, fields.get("WARC-Target-URI"), body if payloads and not revisit else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{name}") as file:
                    rows, held = [], 0
                    for row in rows_of(name, ZipArchive(file)):
                        rows.append(row)
                        held += row[1] if payloads else 200
                        if held > READ_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return run


def originals(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html") -> DataFrame:
    """(page_id, content, refers_to) of the rows that revisit another: the largest id with an equal payload of
    LEAST_BYTES or more. Only digests and ids are shuffled."""
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.octet_length(payload).alias("size"), F.sha2(payload, 256).alias("content"))
    large = rows.filter(F.col("size") >= LEAST_BYTES)
    best = large.groupBy("content").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1")
    return large.join(best, "content").filter("page_id <> best").select("page_id", "content", F.col("best").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Writes one WARC record per row into ZIP packages in ``folder``; returns their names, as a written table.

    The row with the largest id among equal payloads of LEAST_BYTES or more is a response, the others revisit it.
    A null payload is empty; a row with a null id is a response; of rows that repeat an id and a payload all
    with the largest id are responses. Other columns are ignored. Revisits are broadcast up to SENT_REVISITS rows (about 10 MB).
    """
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    # few revisits are sent to every task, so that no payload is shuffled; many are joined
    revisits = written(originals(pages, id_column, payload_column))
    revisits = F.broadcast(revisits) if revisits.count() <= SENT_REVISITS else revisits
    joined = rows.withColumn("content", F.sha2("payload", 256)).join(revisits, ["page_id", "content"], "left").select("page_id", "url", "payload", F.sha1("payload").alias("digest"), "refers_to")
    return joined.mapInArrow(_write(qualified(pages.sparkSession, folder)), "name string")


def read_archives(names: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The response, resource and revisit records of every archive in the named packages: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return names.mapInArrow(_read(qualified(names.sparkSession, folder), payloads), kinds)


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads every record back."""
    folder = qualified(spark, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    store, path = open_folder(folder)
    store.create_dir(path)
    listing = f"{folder}-names"
    write_archives(pages, folder).write.parquet(listing)
    names = spark.read.schema("name string").parquet(listing).repartition(partitions(pages))
    return read_archives(names, folder, payloads=False).drop("url", "payload")

