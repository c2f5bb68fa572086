"""Length-delimited binary records with masked checksums and a separate offset index.

Data file: blocks of a few megabytes, one after another::

    b"HLR2" u64 bytes of the block up to its newline | u64 writer | u64 tokens of the writer's earlier records
    record*      u64 length | u32 masked crc32 of the eight length bytes | payload | u32 masked crc32 of payload
    newline

A payload is ``i64 doc_id, u8 width, ids`` with ids as little-endian unsigned integers of ``width``
bytes: two while every id fits, else four.  The mask rotates the checksum right by 15 bits and adds a
constant, so that a checksum stored inside other checked data does not disturb the outer one.

Index file (one for each data file): ``b"HLX1" u64 writer u64 count``, ``count`` entries
``i64 doc_id, u64 offset, u64 tokens, u64 tokens of the writer's earlier records``, ``u32 masked crc32
of the entries``, newline.  With it a reader can fetch records in any order by seeking.

Writing is distributed: documents are range-partitioned and sorted by ``doc_id``; each range writes
files of about ``file_bytes`` through Spark's own writer and commit protocol (so any store that Spark writes
will do, and a lost executor's half-written files never appear).  The n-th files of all ranges share a folder, so there are as few folders
as a range has files.  Starts are global: a range's start is the sum of the ranges before it, which is one
number for each range.

Null text counts as empty (one record of the end id); null ids sort first and are kept; rows of one id are ordered by
the hash of their text, which also lets ranges part them; repeated rows give a record each; extra columns are ignored; an empty table writes no records.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm._arrow import rows
from hashloom.llm.encode import crc, encoder, slices, vocabulary_path

MASK = 0xA282EAD8
NULL_ID = -(1 << 63)
HEAD = 28  # bytes before a block's first record


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload framed at ``at`` and where the next frame starts; raises ValueError if either checksum is wrong."""
    head = data[at : at + 8]
    (size,) = struct.unpack("<Q", head)
    if struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"length checksum is wrong at {at}")
    payload = data[at + 12 : at + 12 + size]
    if len(payload) != size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"payload checksum is wrong at {at}")
    return payload, at + 16 + size


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    return struct.pack("<qB", NULL_ID if doc_id is None else doc_id, width) + ids.astype(f"<u{width}").tobytes()


def ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc, width = struct.unpack_from("<qB", payload)
    return None if doc == NULL_ID else doc, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, vocabulary: Callable[[], str] = vocabulary_path, partitions: int | None = None, block_bytes: int = 4 << 20, file_bytes: int = 64 << 20) -> None:
    """Encode ``docs`` and write data and index files below ``path``, ascending by ``doc_id`` over ranges, files and records."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(vocabulary(), end_id).batch, TaskContext.get().partitionId()
        data, entries, before, size = [], [], 0, HEAD
        first = place = roll = block = 0  # tokens before the block, its place in the file, the numbers of both

        def row(kind: str, value: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([roll], pa.int32()), pa.array([block], pa.int64()), pa.array([value])], ["kind", "roll", "block", "value"])

        def close() -> pa.RecordBatch:
            nonlocal data, first, place, block, size
            got = row("data", b"HLR2" + struct.pack("<QQQ", size, writer, first) + b"".join(data))
            data, first, place, block, size = [], before, place + size + 1, block + 1, HEAD
            return got

        def finish() -> pa.RecordBatch:
            nonlocal entries, place, roll
            body = b"".join(struct.pack("<qQQQ", *x) for x in entries)
            got = row("index", b"HLX1" + struct.pack("<QQ", writer, len(entries)) + body + struct.pack("<I", masked(body)))
            entries, place, roll = [], 0, roll + 1
            return got

        for b in slices(batches, 1):
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                framed = frame(payload_of(doc, ids))
                entries.append((NULL_ID if doc is None else doc, place + size, len(ids), before))
                data.append(framed)
                size, before = size + len(framed), before + len(ids)
                if size >= block_bytes:
                    yield close()
                    if place >= file_bytes:
                        yield finish()
        if data:
            yield close()
        if entries:
            yield finish()

    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    ordered = source.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    files = ordered.mapInArrow(run, "kind string, roll int, block long, value binary").sortWithinPartitions("kind", "roll", "block")
    files.select("kind", "roll", F.col("value").cast("string")).write.partitionBy("kind", "roll").option("maxRecordsPerFile", 0).text(path)


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    folder = f"{path}/kind={kind}"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):  # nothing was written
        return spark.createDataFrame([], "content binary")
    return spark.read.format("binaryFile").load(folder).select("content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(writer, doc_id, byte_offset, tokens, earlier)`` from the index files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 1):
            raw = b.column(0)[0].as_py()
            writer, count = struct.unpack_from("<QQ", raw, 4)
            body = raw[20 : 20 + 32 * count]
            if raw[:4] != b"HLX1" or struct.unpack_from("<I", raw, 20 + 32 * count)[0] != masked(body):
                raise ValueError("index file is damaged")
            e = np.frombuffer(body, "<i8").reshape(-1, 4)
            doc = pa.array(e[:, 0], mask=e[:, 0] == NULL_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(count, writer, np.int64)), doc, *(pa.array(np.ascontiguousarray(e[:, k])) for k in (1, 2, 3))], ["writer", "doc_id", "byte_offset", "tokens", "earlier"])

    return _files(spark, path, "index").mapInArrow(run, "writer long, doc_id long, byte_offset long, tokens long, earlier long")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of every record, checksums verified; ``ids`` is null unless ``with_ids``."""
    # one row for each range that wrote, a number that the writer's partition count bounds
    totals = sorted((r[0], r[1]) for r in read_index(spark, path).groupBy("writer").agg(F.sum("tokens")).collect())
    base, at = {}, 0
    for writer, tokens in totals:
        base[writer] = at
        at += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 1):
            raw, place, out = b.column(0)[0].as_py(), 0, []
            while place < len(raw):
                if raw[place : place + 4] != b"HLR2":
                    raise ValueError("data file is damaged")
                size, writer, earlier = struct.unpack_from("<QQQ", raw, place + 4)
                start, at = base[writer] + earlier, place + HEAD
                while at < place + size:
                    payload, at = unframe(raw, at)
                    doc, ids = ids_of(payload)
                    out.append((doc, start, len(ids), crc(ids), ids.tobytes() if with_ids else None))
                    start += len(ids)
                place += size + 1
            types = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return _files(spark, path, "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_at(data: bytes, offset: int) -> tuple[int | None, np.ndarray]:
    """One record of a data file by the offset its index gives: ``(doc_id, ids)``."""
    return ids_of(unframe(data, offset)[0])
