"""WARC archives as a Spark data source, format "warc".

Writing: every task writes its own files (one gzip member per record, with the skip lengths of the member in its extra
field); the commit lists the files of the successful tasks in a manifest, so what a lost or repeated task left is never
read. Reading: files are packed into partitions, each record's header is parsed first, filters on its fields are pushed
down to it, and the payload of a record that fails them, or that is not asked for, is passed over by seeking.

Folders are opened with pyarrow's file systems: file, hdfs, s3 and gs addresses, or a plain path.
"""
from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import ship

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Field names and profile of the archive format, and the digits of base 32.
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MANIFEST = "_files.json"
END = b"\r\n\r\n"
PIECE = 1 << 16
#: Limits of a batch of rows handed to Spark.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base 32 of the SHA-1 of binary data: 160 bits are 32 digits, without padding."""
    hexed = F.sha1(data)
    digits = []
    for part in range(4):
        bits = F.conv(F.substring(hexed, part * 10 + 1, 10), 16, 10).cast("long")
        digits += [F.substring(F.lit(BASE32), (F.shiftright(bits, 35 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*digits)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _field(value: str) -> str:
    """A header value keeps to its line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(row: dict, date: str) -> bytes:
    """One record. A response holds the payload, a revisit only the answer's head with the payload's length."""
    kind, payload = row["record_type"], row["payload"] or b""
    size = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind != "revisit":
        block += payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date), ("WARC-Target-URI", row["target_uri"]),
            ("WARC-Payload-Digest", row["payload_digest"] and f"sha1:{row['payload_digest']}")]
    if kind == "revisit":
        head += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", row["refers_to"] and f"<{row['refers_to']}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {_field(v)}\r\n" for k, v in head if v is not None) + "\r\n").encode() + block + END


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field 'sl' says its own length and the record's, for readers that skip."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, (len(body) + 32) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Stream:
    """Bytes of a file, plain or of joined gzip members, read forward."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.at, self.size = file, 0, file.size()
        self.held, self.z, self.next = b"", None, None
        self.zipped = self._take(2) == b"\x1f\x8b"
        self._seek(0)

    def _seek(self, at: int) -> None:
        self.file.seek(at)
        self.at = at

    def _take(self, n: int) -> bytes:
        data = self.file.read(n)
        self.at += len(data)
        return data

    def _open_member(self) -> None:
        start, head = self.at, self._take(24)
        self.next = None
        if head[3:4] == b"\x04" and head[12:14] == b"sl":
            self.next = start + struct.unpack("<I", head[16:20])[0]
        self._seek(start)
        self.z = zlib.decompressobj(31)

    def _more(self) -> bool:
        if not self.zipped:
            data = self._take(PIECE)
            self.held += data
            return bool(data)
        if self.z is None or self.z.eof:
            if self.at >= self.size:
                return False
            self._open_member()
        data = self._take(min(PIECE, (self.next or self.size) - self.at))
        out = self.z.decompress(data)
        if self.z.eof and self.z.unused_data:
            self._seek(self.at - len(self.z.unused_data))
        self.held += out
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is taken too; None at the end."""
        look = 0
        while (at := self.held.find(mark, look)) < 0:
            look = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out, self.held = self.held[:at], self.held[at + len(mark):]
        return out

    def read(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        self.held = b""
        while have < n and self._more():
            parts.append(self.held)
            have += len(self.held)
            self.held = b""
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        """Pass over n bytes and the end of the record: by seeking in a plain file or to the next member."""
        n += len(END)
        if len(self.held) >= n:
            self.held = self.held[n:]
        elif not self.zipped:
            self._seek(self.at + n - len(self.held))
            self.held = b""
        elif self.next is not None:
            self._seek(self.next)
            self.held, self.z = b"", None
        else:
            self.read(n)


def records(file: pa.NativeFile, wanted, payload: bool) -> Iterator[dict]:
    """Rows of a file whose header fields `wanted` accepts. Only their payloads are read, and only if asked for."""
    s = Stream(file)
    while (head := s.until(END)) is not None:
        fields = {}
        for line in head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields.get("content-length", 0))
        row = {c: fields.get(f) for c, f in FIELDS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].rpartition(":")[2]
        if not wanted(row):
            s.skip(n)
            continue
        row |= {"payload": None, "payload_bytes": None}
        left = n
        if "application/http" in fields.get("content-type", "") and (answer := s.until(END)) is not None:
            left = n - len(answer) - len(END)
            for line in answer.split(b"\r\n"):
                if line.lower().startswith(b"content-length:"):
                    row["payload_bytes"] = int(line.partition(b":")[2])
        if payload and row["record_type"] != "revisit":
            row["payload"] = s.read(left)
            left = 0
        s.skip(left)
        yield row


class Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class Done(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcSource(DataSource):
    """format("warc"). Options: path; payload (true); partition_bytes, for packing files; level, file_bytes and date, for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons with header fields are tested before a payload is touched; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in FIELDS and isinstance(f, (EqualTo, StringStartsWith)):
                self.tests.append((type(f).__name__, column, f.value))
            elif column in FIELDS and isinstance(f, In):
                self.tests.append(("In", column, tuple(f.value)))
            elif column in FIELDS and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((type(f).__name__, column, None))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            have = row[column]
            if not (have is None if kind == "IsNull" else have is not None and (kind == "IsNotNull" or (have == value if kind == "EqualTo" else have in value if kind == "In" else have.startswith(value)))):
                return False
        return True

    def partitions(self) -> list[Files]:
        fs, root = _place(self.path)
        info = fs.get_file_info(f"{root}/{MANIFEST}")
        if info.type == pafs.FileType.File:
            with fs.open_input_stream(info.path) as f:
                names = [f"{root}/{n}" for n in json.loads(f.read())]
        else:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else fs.get_file_info([root])
            names = [i.path for i in found if i.path.endswith((".warc", ".warc.gz")) or i.path == root]
        sizes = {i.path: i.size or 0 for i in fs.get_file_info(sorted(names))}
        out: list[Files] = []
        room = 0
        for n, size in sizes.items():
            if size > room:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].names.append(n)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _place(self.path)
        rows, held = [], 0
        for name in partition.names:
            with fs.open_input_file(name) as file:
                for row in records(file, self.wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.level, self.file_bytes = int(options.get("level", 6)), int(options.get("file_bytes", 128 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        names, out, room = [], None, 0
        try:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}
                    data = record(row, self.date)
                    data = member(data, self.level) if self.level else data
                    if out is None or room < len(data):
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.level else ""))
                        out, room = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), self.file_bytes
                    out.write(data)
                    room -= len(data)
        finally:
            if out is not None:
                out.close()
        return Done(names)

    def commit(self, messages: list[Done | None]) -> None:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Done | None]) -> None:
        fs, root = _place(self.path)
        for n in [n for m in messages if m for n in m.names]:
            fs.delete_file(f"{root}/{n}")


def register(spark: SparkSession) -> None:
    """Make format("warc") known to the session, with filters pushed down to Python sources."""
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def deduplicated(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", prefix: str = "urn:page:", least_bytes: int = 0) -> DataFrame:
    """Records of all pages, in the columns of SCHEMA: of equal payloads the smallest id is the response, the others revisit it.

    A null payload is an empty one. Payloads under least_bytes, and rows whose group has no id at all, are responses; rows
    that repeat an id and its payload are the same record again, with its type. A null id beside others revisits.
    """
    rows = pages.select(pages[id_col].cast("string").alias("id"), pages[id_col].alias("n"), pages[url_col].alias("target_uri"), F.coalesce(pages[payload_col], F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", base32_sha1(F.col("payload")).alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"))
    first = rows.groupBy("payload_digest").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("many")).filter((F.col("many") > 1) & F.col("first").isNotNull())
    rows = rows.join(first, "payload_digest", "left")
    again = F.coalesce(F.col("first").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~F.col("n").eqNullSafe(F.col("first")), F.lit(False))
    return rows.select(F.concat(F.lit(prefix), F.coalesce("id", F.lit("null"))).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
                       F.when(again, F.concat(F.lit(prefix), F.col("first").cast("string"))).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"))


def write(rows: DataFrame, path: str, **options) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
