"""WARC archives: a Python data source that reads and writes them.

Reading plans partitions from the files, takes record-type and header predicates, parses headers
first and never inflates the payload of a record that no predicate lets through, nor any payload when
only header columns are asked for: each record is a gzip member of its own whose extra field holds
its length, so the reader seeks past it. Archives of other writers lack that field; there the rest of
the member is inflated and dropped.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_path, table

SCHEMA = "record_id string, record_type string, date string, target_uri string, refers_to string, content_length long, payload_length long, payload_digest string, http_status int, content_type string, payload binary, file string, offset long"
#: Columns that are headers, and the header of each.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
#: A gzip member: 10 bytes, then an extra field `sl` with the member's whole length and its inflated length.
MEMBER = struct.Struct("<2sBBIBBH2sHII")


def place(path: str):
    """(filesystem, path in it) of any path that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def gzip_member(data: bytes, level: int = 3) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    n = MEMBER.size + len(body) + 8
    return MEMBER.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"sl", 8, n & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """Names in lower case; continued lines are joined; of a repeated name the first counts."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


@dataclass
class FilePart(InputPartition):
    files: list[tuple[str, int]]


class Opened:
    """Reads forward in one archive, plain or gzip, record by record."""

    def __init__(self, source, size: int) -> None:
        self.source, self.size, self.at, self.buffer = source, size, 0, b""

    def fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.source.read(max(1 << 16, n - len(self.buffer)))
            if not more:
                return False
            self.buffer += more
        return True

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.source.seek(self.at)
            self.buffer = b""


class Record:
    """A record whose headers are parsed; the block is only read when asked for."""

    def __init__(self, opened: Opened) -> None:
        self.opened, self.offset, self.inflate, self.member = opened, opened.at, None, 0
        self.plain, self.taken = bytearray(), 0
        opened.fill(2)
        if opened.buffer[:2] == b"\x1f\x8b":
            opened.fill(MEMBER.size)
            if len(opened.buffer) >= MEMBER.size and opened.buffer[3] & 4:
                extra = MEMBER.unpack_from(opened.buffer)
                self.member = extra[9] if extra[7] == b"sl" else 0
            self.inflate = zlib.decompressobj(31)
        head = self.until(b"\r\n\r\n")
        self.headers = parse_headers(head)
        self.length = int(self.headers.get("content-length", 0))
        self.head = len(head) + 4

    def more(self, most: int = 1 << 14) -> bool:
        """Inflate, or read, some more of the record: the pieces grow in place, so a payload of any length is inflated in linear time."""
        if self.inflate is None:
            have = len(self.plain)
            if not self.opened.fill(have + 1):
                return False
            self.plain = bytearray(self.opened.buffer)
            return len(self.plain) > have
        if self.inflate.eof:
            return False
        self.opened.fill(1)
        data = self.opened.buffer
        made = self.inflate.decompress(data, most)
        if not data and not made and not self.inflate.eof:
            raise ValueError("an archive ends within a record")
        self.plain += made
        rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.taken += len(data) - len(rest)
        self.opened.at += len(data) - len(rest)
        self.opened.buffer = rest
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.plain.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record without an end of its headers")
        return bytes(self.plain[:at])

    def block(self, n: int) -> bytes:
        """The first n bytes of the block, or fewer at its end."""
        end = self.head + min(n, self.length)
        if self.inflate is None:
            self.opened.fill(end)
            return self.opened.buffer[self.head : end]
        while len(self.plain) < end and self.more(1 << 18):
            pass
        return bytes(memoryview(self.plain)[self.head : end])

    def http_head(self) -> bytes:
        n = 1 << 12
        while b"\r\n\r\n" not in (found := self.block(n)) and n < self.length:
            n *= 2
        return found.partition(b"\r\n\r\n")[0] if b"\r\n\r\n" in found else b""

    def close(self) -> None:
        """Go to the next record without inflating what is left of this one."""
        opened = self.opened
        if self.inflate is None:
            opened.skip(self.head + self.length)
            while opened.fill(2) and opened.buffer[:2] == b"\r\n":
                opened.skip(2)
        elif self.member and not self.inflate.eof:
            opened.skip(self.member - self.taken)
        else:
            while not self.inflate.eof:
                self.plain = bytearray()
                self.more(1 << 18)


def records(source, size: int) -> Iterator[Record]:
    opened = Opened(source, size)
    while opened.fill(1):
        record = Record(opened)
        yield record
        record.close()


def hex_digest(value: str | None) -> str | None:
    """Bare lower-case hex of a labelled digest in base 32 or 16."""
    if not value:
        return None
    bare = value.rpartition(":")[2]
    try:
        return base64.b32decode(bare.upper()).hex() if len(bare) == 32 else bytes.fromhex(bare).hex()
    except ValueError:
        return bare.lower()


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = schema.fieldNames()
        self.path, self.target = options["path"], int(options.get("partitionbytes", 32 << 20))
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        """Take equality and IN on header columns, and IS NOT NULL on them where an equality holds too; Spark keeps the rest."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo) and f.value is not None:
                self.equal[name] = self.equal.get(name, {f.value}) & {f.value}
            elif name in HEADERS and isinstance(f, In):
                self.equal[name] = self.equal.get(name, set(f.value)) & set(f.value)
            elif not (name in HEADERS and isinstance(f, IsNotNull) and any(isinstance(g, EqualTo) and g.attribute == f.attribute for g in filters)):
                yield f

    def partitions(self) -> list[FilePart]:
        """Files packed, largest first, into partitions near the target size; those of a manifest, where there is one."""
        from pyarrow import fs

        where, root = place(self.path)
        info = where.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [(root, info.size)]
        elif where.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with where.open_input_stream(f"{root}/{MANIFEST}") as f:
                found = [(f"{root}/{x['name']}", x["bytes"]) for x in json.loads(f.read())]
        else:
            listed = where.get_file_info(fs.FileSelector(root, recursive=True))
            found = [(x.path, x.size) for x in listed if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)]
        parts: list[FilePart] = []
        room = 0
        for path, size in sorted(found, key=lambda x: (-x[1], x[0])):
            if size > room or not parts:
                parts.append(FilePart([]))
                room = self.target
            parts[-1].files.append((path, size))
            room -= size
        return parts or [FilePart([])]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        where, _ = place(self.path)
        kinds = pa.schema([("content_length", pa.int64()), ("payload_length", pa.int64()), ("http_status", pa.int32()), ("payload", pa.binary()), ("offset", pa.int64())])
        schema = pa.schema([(c, kinds.field(c).type if c in kinds.names else pa.string()) for c in self.columns])
        rows: list[dict] = []
        held = 0
        for path, size in partition.files:
            with where.open_input_file(path) as source:
                for record in records(source, size):
                    row = self.row(record, path)
                    if row is not None:
                        rows.append(row)
                        held += len(row.get("payload") or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def row(self, record: Record, path: str) -> dict | None:
        """A record's columns, or None if a pushed predicate rules it out by its headers."""
        h = record.headers
        out: dict = {c: h.get(HEADERS[c]) for c in HEADERS}
        out["payload_digest"] = hex_digest(out["payload_digest"])
        if any(out[c] not in some for c, some in self.equal.items()):
            return None
        out |= {"content_length": record.length, "file": path, "offset": record.offset, "content_type": h.get("content-type")}
        if {"payload", "payload_length", "http_status"} & {*self.columns}:
            head = record.http_head() if "http" in (h.get("content-type") or "") else b""
            skip = len(head) + 4 if head else 0
            status = re.match(rb"HTTP/\S+ (\d+)", head)
            out["http_status"] = int(status[1]) if status else None
            whole = out["record_type"] != "revisit"
            said = parse_headers(head).get("content-length", "")
            out["payload_length"] = record.length - skip if whole else int(said) if said.isdigit() else None
            if "payload" in self.columns and whole:
                out["payload"] = record.block(record.length)[skip:]
        return {c: out.get(c) for c in self.columns}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (record_id, record_type, date, target_uri, refers_to, payload) as gzip archives of bounded size.

    Only files that the manifest names count, so what a lost or repeated task has left is not read.
    A revisit row's payload is not stored: its block holds the HTTP headers, with the payload's length.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("filebytes", 64 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        sink, size = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    files.append((f"{uuid.uuid4().hex}.warc.gz", 0))
                    sink, size = where.open_output_stream(f"{root}/{files[-1][0]}", compression=None), 0
                size += sink.write(gzip_member(self.record(row)))
                if size >= self.most:
                    sink.close()
                    files[-1], sink = (files[-1][0], size), None
        if sink is not None:
            sink.close()
            files[-1] = (files[-1][0], size)
        return Written(files)

    @staticmethod
    def record(row: dict) -> bytes:
        payload = row["payload"] or b""
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = row["record_type"] == "revisit"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target_uri"]) if row["target_uri"] else None
        headers = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"], "WARC-Target-URI": uri, "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response"}
        if revisit:
            headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": row["refers_to"]}
        return warc_record({k: v for k, v in headers.items() if v}, http if revisit else http + payload)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        named = [{"name": n, "bytes": b} for m in messages if m for n, b in m.files]
        with where.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(named).encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, root = place(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                try:
                    where.delete_file(f"{root}/{name}")
                except OSError:
                    pass


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, {k.lower(): v for k, v in dict(self.options).items()})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in dict(self.options).items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Records under path. `columns` are the only ones parsed: Spark's Python sources are not told of a projection, so it is named here."""
    register(spark)
    schema = StructType.fromDDL(SCHEMA)
    return spark.read.format("warc").schema(StructType([schema[c] for c in columns or schema.names])).options(**options).load(path)


def write_warc(df: DataFrame, path: str, **options) -> None:
    register(df.sparkSession)
    df.write.format("warc").options(**options).mode("append").save(path)


def record_urn(key: Column) -> Column:
    """A version 8 UUID that holds a 64-bit key; null gives null."""
    h = F.lpad(F.lower(F.hex(key.cast("long"))), 16, "0")
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8000-8000-00000000"), F.substring(h, 13, 4), F.lit(">"))


def urn_key(urn: Column) -> Column:
    h = F.concat(F.substring(urn, 11, 8), F.substring(urn, 20, 4), F.substring(urn, 43, 4))
    high, low = F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def with_revisits(pages: DataFrame, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows for write_warc from page_id, url, html.

    Of pages whose payloads of at least `least` bytes are equal, those with the largest page_id are
    responses and the others revisit it; smaller payloads are all responses. A null html is an empty
    payload. A null page_id never is the largest, unless all are null; then all are responses, as are
    repeated rows of the largest page_id. Groups are found from digests and ids alone, counted before
    the shuffle; the payloads then move once, and only a join that Spark may split for skew moves them.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    sized = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    groups = sized.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n").withColumnRenamed("digest", "of")
    joined = sized.join(groups, F.col("digest") == F.col("of"), "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select(record_urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.lit(date).alias("date"), F.col("url").alias("target_uri"), F.when(revisit, record_urn(F.col("largest"))).alias("refers_to"), "payload")


def op1_query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(with_revisits(table(spark, sf_dir, "pages")), path)
    read = read_warc(spark, path, ["record_id", "record_type", "target_uri", "refers_to", "payload_length", "payload_digest", "payload"])
    whole = F.col("payload").isNotNull()
    return read.select(urn_key(F.col("record_id")).alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"), F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", urn_key(F.col("refers_to")).alias("refers_to"))


#: The same for DuckDB.
OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS largest, count(*) AS n FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN g.n > 1 AND g.largest IS DISTINCT FROM d.page_id AND g.largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN g.n > 1 AND g.largest IS DISTINCT FROM d.page_id THEN g.largest END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
"""
