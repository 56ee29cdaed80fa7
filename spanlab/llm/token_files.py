"""Token-ID files: length-delimited binary records with masked checksums and an offset index.

A shard is two files.  The data file holds one record per document, each framed as

    length of the payload   8 bytes, little endian
    masked crc of those 8   4 bytes
    payload                 the ids, little endian, in the index header's width
    masked crc of payload   4 bytes

where ``masked(c) = rotate_right(c, 15) + 0xa282ead8`` keeps a checksum of data that
itself holds checksums from degenerating.  The index file holds a header, then for
every record its document id, byte offset and number of ids, so that records can be
read in any order.

Shards are written by range-partitioned tasks straight into the shared folder through
a file-system URI; a task that is run again writes files of another name, and only the
names that a finished task reports enter the manifest, so lost executors leave no half
shards in the result.

Nulls: a null text is an empty document; a null document id sorts first and is kept; ids are taken as longs.
Ties: documents of equal id are ordered by text.  Extra columns are ignored.  An empty
table gives an empty manifest and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_words import release
from .common import scratch, written
from .wordids import word_ids

MAGIC = b"SPTK"
HEADER = struct.Struct("<4sHHq")  # magic, version, bytes an id, records
SHARD_BYTES = 32 << 20
NO_ID = -(1 << 63)

MANIFEST = "part int, shard int, data string, index string, n_records long, n_ids long"
RECORDS = "doc_id long, start long, ids binary"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> memoryview:
    """The payload of the record at byte ``at``; ValueError where a checksum differs."""
    (size,), (c,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
    payload = data[at + 12 : at + 12 + size]
    if c != masked(bytes(data[at : at + 8])) or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Shard:
    """Collects records up to SHARD_BYTES, then writes both files."""

    def __init__(self, folder: str, part: int, width: int):
        self.folder, self.part, self.width, self.k = folder, part, width, 0
        self._empty()

    def _empty(self) -> None:
        self.data, self.size, self.docs, self.offsets, self.counts = [], 0, [], [], []

    def add(self, doc: int, payload: bytes) -> None:
        record = frame(payload)
        self.docs.append(doc)
        self.offsets.append(self.size)
        self.counts.append(len(payload) // self.width)
        self.data.append(record)
        self.size += len(record)

    def close(self) -> dict | None:
        if not self.docs:
            return None
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        name = f"{self.part:06d}-{self.k:05d}-{uuid.uuid4().hex[:12]}"
        with store.open_output_stream(f"{folder}/{name}.bin") as out:
            for record in self.data:
                out.write(record)
        with store.open_output_stream(f"{folder}/{name}.idx") as out:
            out.write(HEADER.pack(MAGIC, 1, self.width, len(self.docs)))
            for column, kind in ((self.docs, "<i8"), (self.offsets, "<i8"), (self.counts, "<i8")):
                out.write(np.array(column, kind).tobytes())
        row = {"part": self.part, "shard": self.k, "data": f"{self.folder}/{name}.bin", "index": f"{self.folder}/{name}.idx", "n_records": len(self.docs), "n_ids": sum(self.counts)}
        self.k += 1
        self._empty()
        return row


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``docs(doc_id, text)`` in ascending doc_id order; returns the manifest, a row a shard.

    The order of the corpus is (part, shard, position in the shard).
    """
    folder = folder or scratch(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, shard, rows = word_ids(vocabulary), None, []
        for batch in batches:
            ids, ends = words.encode(batch.column("text"))
            shard = shard or _Shard(folder, TaskContext.get().partitionId(), ids.dtype.itemsize)
            raw, end, at = memoryview(ids.astype(ids.dtype.newbyteorder("<")).tobytes()), np.array([end_id], ids.dtype.newbyteorder("<")).tobytes(), 0
            for doc, upto in zip(batch.column("doc_id").to_pylist(), (ends * ids.dtype.itemsize).tolist(), strict=True):
                shard.add(NO_ID if doc is None else doc, b"".join((raw[at:upto], end)))
                at = upto
                if shard.size >= shard_bytes:
                    rows.append(shard.close())
        if shard and (row := shard.close()):
            rows.append(row)
        shard = None
        release()
        if rows:
            names = ["part", "shard", "data", "index", "n_records", "n_ids"]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST))


def read_index(path: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes an id, then document ids, byte offsets and numbers of ids of a shard's records."""
    store, at = _store(path)
    with store.open_input_file(at) as f:
        raw = f.read()
    magic, version, width, n = HEADER.unpack_from(raw)
    if magic != MAGIC or version != 1:
        raise ValueError(f"{path} is no index of this format")
    docs, offsets, counts = np.frombuffer(raw, "<i8", 3 * n, HEADER.size).reshape(3, n)
    return width, docs, offsets, counts


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every record of the shards in ``manifest``: doc_id, start (ids of all earlier documents), ids (uint32)."""
    before = F.sum("n_ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("data", "index", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    n = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                width, docs, offsets, counts = read_index(s["index"])
                starts = s["before"] + np.cumsum(counts) - counts
                store, at = _store(s["data"])
                with store.open_input_file(at) as f:
                    data = memoryview(f.read())
                for a in range(0, len(docs), 2000):
                    ids = [np.frombuffer(unframe(data, int(o)), f"<u{width}").astype("<u4").tobytes() for o in offsets[a : a + 2000]]
                    doc = docs[a : a + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(starts[a : a + 2000], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])
        release()

    return shards.repartition(max(1, min(n, 20_000))).mapInArrow(read, RECORDS)
