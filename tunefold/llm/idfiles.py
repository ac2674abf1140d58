"""Token ids in binary files with a shared zstandard dictionary, as a Spark data source, format "idfiles".

A dictionary is trained once on the serialized ids of a bounded sample of documents and lies beside the files. Each document
is a zstandard frame of its own, compressed with the dictionary, so a short document is read without its neighbours. A file
is: MAGIC, the SHA-256 of the dictionary, the bytes per id; the frames; the index (ids of the documents, ends of the frames,
numbers of ids); the length of the index and MAGIC. Tasks write files of their own and the commit lists those of the
successful ones, in order and with the number of ids before each, so what a lost or repeated task left is never read.
"""
from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .bpe import coder
from .common import ship
from .mapped import slices

SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
MAGIC = b"tuneids1"
MANIFEST = "_files.json"
#: Bounds of the sample that the dictionary is trained on, and its size.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 512, 32_768, 65_536
#: Limits of a file's frames and of a batch handed to Spark.
FILE_BYTES, BATCH_BYTES = 128 << 20, 8 << 20
NULL = -(1 << 63)
INDEX = np.dtype([("doc", "<i8"), ("end", "<i8"), ("n", "<i8"), ("known", "u1")])


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int | None = None, out: str = "ids") -> DataFrame:
    """doc_id (long) and the ids of every whole text as little-endian unsigned 32-bit integers, in the partitions and order of df.

    path: the tokenizers file on the driver, broadcast to the tasks. end: an id to append to each document. A null text is an empty one.
    """
    ship(df.sparkSession)
    with open(path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB whatever the corpus is

    closing = np.array([] if end is None else [end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(held.value)
        for part in (p for batch in batches for p in slices(batch)):
            ids, counts = c.encoded(part.column(1).to_pylist())
            data, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([data[a:b] + closing for a, b in zip([0, *stops], stops)], pa.binary())], names=["doc_id", out])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col]).mapInArrow(run, f"doc_id long, {out} binary")


def in_order(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt and sorted by id (null first). Rows that share an id go by a hash and the length of the text, then by
    where they stood, so a hot id is dealt to many tasks."""
    keys = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col), F.length(text_col), F.col("__row")]
    return df.select(id_col, text_col, F.monotonically_increasing_id().alias("__row")).repartitionByRange(*keys).sortWithinPartitions(*keys).select(id_col, text_col)


def trained(df: DataFrame, path: str, *, text_col: str = "text", end: int | None = None, width: int = 2, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, size: int = DICTIONARY) -> bytes:
    """A dictionary from the serialized ids of at most `sample` whole texts of at most `chars` characters, chosen by a hash of the text.

    Too few or too similar texts to train on make a dictionary of their plain bytes, none at all an empty one (none is used).
    """
    rows = df.filter(F.length(text_col) <= chars).select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.orderBy(F.xxhash64("text")).limit(sample)
    got = [serialized(np.frombuffer(r["ids"], np.uint32), width) for r in encode(rows, path, text_col="text", end=end).select("ids").collect()]
    got = [g for g in got if len(g) >= 8]
    try:
        return zstandard.train_dictionary(size, got).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(got)[-size:]


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class Files(InputPartition):
    def __init__(self, files: list[dict]) -> None:
        self.files = files


class Done(WriterCommitMessage):
    def __init__(self, files: list[dict]) -> None:
        self.files = files


class IdFiles(DataSource):
    """format("idfiles"). Options: path; writing: dictionary (a file's name in path), width (bytes per id: 2 or 4), level,
    file_bytes; reading: ids (false reads the index alone), partition_bytes for packing files."""

    @classmethod
    def name(cls) -> str:
        return "idfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IdReader:
        return IdReader(self.options)

    def writer(self, schema, overwrite: bool) -> IdWriter:
        return IdWriter(self.options)


class IdWriter(DataSourceArrowWriter):
    """Rows of doc_id and ids (binary, 32-bit), in the order of the partitions."""

    def __init__(self, options) -> None:
        self.path, self.dictionary = options["path"], options["dictionary"]
        self.width, self.level, self.file_bytes = int(options.get("width", 2)), int(options.get("level", 3)), int(options.get("file_bytes", FILE_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        fs, root = _place(self.path)
        with fs.open_input_stream(f"{root}/{self.dictionary}", compression=None) as f:
            data = f.read()
        pack = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary(data), write_checksum=False)
        part, done = TaskContext.get().partitionId(), []
        rows = ((d, i.as_py()) for b in batches for d, i in zip(b.column("doc_id").to_pylist(), b.column("ids")))
        row = next(rows, None)
        while row is not None:
            name = f"part-{uuid.uuid4().hex}.ids"
            index, at = [], len(MAGIC) + 33
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(MAGIC + hashlib.sha256(data).digest() + bytes([self.width]))
                start = at
                while row is not None and at - start < self.file_bytes:
                    ids = np.frombuffer(row[1], np.uint32)
                    if self.width == 2 and len(ids) and ids.max() > 0xFFFF:
                        raise ValueError("an id needs more than two bytes: write with width 4")
                    frame = pack.compress(serialized(ids, self.width))
                    out.write(frame)
                    at += len(frame)
                    index.append((NULL if row[0] is None else row[0], at, len(ids), row[0] is not None))
                    row = next(rows, None)
                index = np.array(index, INDEX)
                out.write(index.tobytes() + struct.pack("<Q", index.nbytes) + MAGIC)
            known = index["doc"][index["known"] == 1]
            done.append({"name": name, "part": part, "place": len(done), "docs": len(index), "tokens": int(index["n"].sum()), "bytes": at,
                         "least": int(known.min()) if len(known) else None, "most": int(known.max()) if len(known) else None})
        return Done(done)

    def commit(self, messages: list[Done | None]) -> None:
        fs, root = _place(self.path)
        files, start = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["part"], f["place"])), 0
        for f in files:
            f["start"], start = start, start + f["tokens"]
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"dictionary": self.dictionary, "width": self.width, "files": files}).encode())

    def abort(self, messages: list[Done | None]) -> None:
        fs, root = _place(self.path)
        for f in [f for m in messages if m for f in m.files]:
            fs.delete_file(f"{root}/{f['name']}")


class IdReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.ids = options["path"], options.get("ids", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.wanted: set[int] | None = None

    def pushFilters(self, filters: list[Filter]):
        """doc_id = x and doc_id IN (...) are looked up in the index; other frames are not touched."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("doc_id",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = _place(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
            listed = json.loads(f.read())
        self.dictionary, out, room = listed["dictionary"], [], 0
        for f in listed["files"]:
            if self.wanted is not None and (f["least"] is None or not any(f["least"] <= x <= f["most"] for x in self.wanted if x is not None)):
                continue
            if f["bytes"] > room or not out:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].files.append(f | {"dictionary": self.dictionary})
            room -= f["bytes"]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = _place(self.path)
        for f in partition.files:
            with fs.open_input_stream(f"{root}/{f['dictionary']}", compression=None) as d:
                data = d.read()
            with fs.open_input_file(f"{root}/{f['name']}") as file:
                yield from self.rows(file, data, f["start"])

    def rows(self, file: pa.NativeFile, data: bytes, start: int) -> Iterator[pa.RecordBatch]:
        """Batches of a file's documents, from its index and, if asked for, the frames."""
        head, size = file.read(len(MAGIC) + 33), file.size()
        if head[:len(MAGIC)] != MAGIC or head[len(MAGIC):-1] != hashlib.sha256(data).digest():
            raise ValueError("no file of ids, or one of another dictionary")
        file.seek(size - len(MAGIC) - 8)
        length = struct.unpack("<Q", file.read(8))[0]
        file.seek(size - len(MAGIC) - 8 - length)
        index = np.frombuffer(file.read(length), INDEX)
        starts = start + np.cumsum(index["n"]) - index["n"]
        first = np.concatenate(([len(head)], index["end"][:-1])) if len(index) else np.zeros(0, np.int64)
        pick = np.arange(len(index)) if self.wanted is None else np.flatnonzero(np.isin(index["doc"], np.array([x for x in self.wanted if x is not None], np.int64)) & (index["known"] == 1))
        unpack = zstandard.ZstdDecompressor(dict_data=dictionary(data))
        kind = "<u2" if head[-1] == 2 else "<u4"
        at, here = 0, None
        while at < len(pick):
            end, rows, held = at, [], 0
            while end < len(pick) and held < BATCH_BYTES and end - at < 4096:
                i = pick[end]
                if self.ids:
                    if here != first[i]:
                        file.seek(int(first[i]))
                    frame, here = file.read(int(index["end"][i] - first[i])), index["end"][i]
                    rows.append(np.frombuffer(unpack.decompress(frame, max_output_size=int(index["n"][i]) * head[-1]), kind).astype("<u4").tobytes())
                    held += len(rows[-1])
                end += 1
            some = index[pick[at:end]]
            yield pa.RecordBatch.from_arrays([pa.array(some["doc"], mask=some["known"] == 0), pa.array(starts[pick[at:end]].astype(np.int64)), pa.array(some["n"].astype(np.int64)),
                                              pa.array(rows if self.ids else [None] * (end - at), pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
            at = end


def register(spark: SparkSession) -> None:
    """Make format("idfiles") known to the session, with filters pushed down to Python sources."""
    ship(spark)
    spark.dataSource.register(IdFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(df: DataFrame, tokenizer_path: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int | None = None, width: int = 2, **options) -> None:
    """All whole texts of df as ids in files below path, in the order of in_order().

    Null texts are empty ones; null ids come first and stay null; repeated rows are as many documents. An empty table makes
    a manifest without files. Other columns are not looked at. width 2 takes ids up to 65,535.
    """
    register(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    data = trained(rows, tokenizer_path, end=end, width=width)
    fs, root = _place(path)
    fs.create_dir(root, recursive=True)
    name = f"dictionary-{hashlib.sha256(data).hexdigest()[:16]}"
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(data)
    ids = encode(in_order(rows), tokenizer_path, end=end)
    ids.write.format("idfiles").options(dictionary=name, width=str(width), **options).mode("append").save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit integers)."""
    register(spark)
    return spark.read.format("idfiles").options(**options).load(path)
