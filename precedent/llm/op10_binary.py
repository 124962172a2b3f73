"""Token-ID output: independent zstandard frames with a trailing seek table.

File layout, in order:

* one zstandard frame per document: its ids as little-endian unsigned 32-bit integers;
* a skippable frame (``TABLE_MAGIC``) with the document table: per document its id
  (64-bit, signed) and a flag byte (1: the id is null);
* a skippable frame (``SEEK_MAGIC``) with the seek table of the public zstandard
  seekable format: per frame compressed size, decompressed size and the low 32 bits
  of the content's XXH64, then the number of frames, a descriptor byte (0x80:
  checksums present) and the closing magic number.

A reader loads the tail, finds the documents it wants and decompresses their
frames only, each verified by its checksum.

Documents are range-partitioned by ``doc_id`` and sorted within each task, so
that the files, in order, hold the documents in ascending order.  A task writes
its file under a name of its own attempt and returns it; only returned names
become part of the output, so a lost or repeated task leaves no trace in it.
One narrow row per file reaches the driver, never one per document.

Defined results: null and empty texts hold the end id alone; null ``doc_id``
comes first; repeated rows are each a document, ordered by text; an empty table
gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precedent.llm.common import n_partitions, shared_path, small_batches, token_encoder

END_ID = 0
# Fixed values of the public zstandard seekable format and its skippable frames.
TABLE_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
SEEK_END = 0x8F92EAB1
CHECKSUMS = 0x80


def open_fs(path: str):
    """``(filesystem, path on it)`` for a URI or a plain local path, on any file system that pyarrow knows."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class FrameWriter:
    """Appends documents to an open binary sink; ``close`` writes the tables."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink = sink
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.docs, self.seeks, self.n_ids = [], [], 0

    def add(self, doc_id: int | None, ids: bytes):
        import xxhash

        frame = self.compressor.compress(ids)
        self.sink.write(frame)
        self.docs.append(struct.pack("<qB", doc_id or 0, doc_id is None))
        self.seeks.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.n_ids += len(ids) // 4

    def close(self):
        table = b"".join(self.docs)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        foot = b"".join(self.seeks) + struct.pack("<IBI", len(self.seeks), CHECKSUMS, SEEK_END)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(foot)) + foot)
        self.sink.close()


class FrameReader:
    """Random access to one file: ``doc_ids`` in order, ``read(i)`` for the ids of the i-th document."""

    def __init__(self, path: str):
        import numpy as np
        import zstandard

        files, inner = open_fs(path)
        self.file = files.open_input_file(inner)
        size = self.file.size()
        n, flags, end = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if end != SEEK_END or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        seek_at = size - 9 - 12 * n
        seeks = np.frombuffer(self.file.read_at(12 * n, seek_at), "<u4").reshape(-1, 3)
        self.sizes, self.checks = seeks[:, 0].astype("i8"), seeks[:, 2]
        self.starts = np.cumsum(self.sizes) - self.sizes
        table = np.frombuffer(self.file.read_at(9 * n, seek_at - 8 - 9 * n),
                              np.dtype([("id", "<i8"), ("null", "u1")]))
        self.doc_ids = [None if null else i for i, null in zip(table["id"].tolist(), table["null"].tolist())]
        self.decompressor = zstandard.ZstdDecompressor()
        self.path = path

    def _content(self, i: int, frame: bytes) -> bytes:
        import xxhash

        ids = self.decompressor.decompress(frame)
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != int(self.checks[i]):
            raise ValueError(f"{self.path}: checksum of frame {i} does not match")
        return ids

    def read(self, i: int) -> bytes:
        return self._content(i, self.file.read_at(int(self.sizes[i]), int(self.starts[i])))

    def __iter__(self):
        """All documents in order, through one buffered pass."""
        self.file.seek(0)
        held, at, n = b"", 0, len(self.doc_ids)
        for i in range(n):
            size = int(self.sizes[i])
            if len(held) - at < size:
                held = held[at:] + self.file.read(max(size, 1 << 20))
                at = 0
            yield self.doc_ids[i], self._content(i, held[at:at + size])
            at += size


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> list[tuple]:
    """Write the files under ``path``; ``[(file, n_docs, n_ids, first place), ...]`` in order."""
    end = end_id.to_bytes(4, "little")

    def write(batches):
        import uuid

        from pyspark import TaskContext

        encoder = token_encoder(tokenizer)
        part, writer, name = TaskContext.get().partitionId(), None, None
        for batch in small_batches(batches, "text"):
            if writer is None:
                name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                files, inner = open_fs(name)
                files.create_dir(inner.rpartition("/")[0], recursive=True)
                writer = FrameWriter(files.open_output_stream(inner, compression=None))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(),
                                   encoder.encode(batch.column("text"))):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(writer.docs)],
                                              "n_ids": [writer.n_ids]}, schema=schema)

    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()),
                        ("n_ids", pa.int64())])
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").repartitionByRange(n_partitions(spark), "doc_id")
    files = rows.sortWithinPartitions("doc_id", "text").mapInArrow(
        write, "part long, file string, n_docs long, n_ids long").collect()      # a row per file
    out, start = [], 0
    for r in sorted(files, key=lambda r: r["part"]):
        out.append((r["file"], r["n_docs"], r["n_ids"], start))
        start += r["n_ids"]
    return out


def read_tokens(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files, a task per file."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                rows = []
                for doc_id, ids in FrameReader(name):
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                         schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                     schema=schema)

    listed = spark.createDataFrame(files, "file string, n_docs long, n_ids long, start long")
    if files:
        listed = listed.repartitionByRange(len(files), "start")
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, files: list[str], doc_ids: list[int]) -> DataFrame:
    """``(doc_id, ids)`` of the asked documents only; no other frame is decompressed."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    wanted = set(doc_ids)

    def read(batches):
        import numpy as np

        for batch in batches:
            for name in batch.column("file").to_pylist():
                reader = FrameReader(name)
                for i, doc_id in enumerate(reader.doc_ids):
                    if doc_id in wanted:
                        ids = np.frombuffer(reader.read(i), "<u4").tolist()
                        yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "ids": [ids]}, schema=schema)

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    if files:
        listed = listed.repartition(len(files))
    return listed.mapInArrow(read, "doc_id long, ids array<long>")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to a fresh place in the shared folder and read it back."""
    return read_tokens(spark, write_tokens(docs, shared_path(spark, "token-ids"), tokenizer))
