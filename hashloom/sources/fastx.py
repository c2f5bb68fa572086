"""FASTA and FASTQ sources.

Files are read whole by Spark (plain, gzip, bzip2, xz or zstd, from any store it reads) and parsed on the executors; a file is one task's work,
so very large inputs should come as several files.  Records keep their whole header line as id.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "filename string, record_ix int, record_id string, seq binary"
BATCH = 1000


class FormatError(ValueError):
    pass


def plain(data: bytes) -> bytes:
    """The bytes, unpacked if their first ones are those of gzip, bzip2, xz or zstd."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:3] == b"BZh":
        return bz2.decompress(data)
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    return data


def records(data: bytes) -> Iterator[tuple[str, bytes]]:
    """``(header, sequence)`` of FASTA or FASTQ bytes; multi-line FASTA sequences are joined."""
    lines = plain(data).splitlines()
    at = next((k for k, line in enumerate(lines) if line.strip()), len(lines))
    if at == len(lines):
        return
    if lines[at][:1] == b">":
        head, parts = None, []
        for line in lines[at:]:
            if line[:1] == b">":
                if head is not None:
                    yield head, b"".join(parts)
                head, parts = line[1:].strip().decode("utf-8", "replace"), []
            else:
                parts.append(line.strip())
        yield head, b"".join(parts)
    elif lines[at][:1] == b"@":
        while at < len(lines):
            if not lines[at].strip():
                at += 1
                continue
            if lines[at][:1] != b"@" or at + 2 >= len(lines) or lines[at + 2][:1] != b"+":
                raise FormatError(f"not a FASTQ record at line {at + 1}")
            yield lines[at][1:].strip().decode("utf-8", "replace"), lines[at + 1].strip()
            at += 4
    else:
        raise FormatError("neither FASTA nor FASTQ")


def parse(files: DataFrame) -> DataFrame:
    """``SCHEMA`` rows of ``files(filename, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                out: list[tuple] = []

                def flush() -> pa.RecordBatch:
                    got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True)], ["filename", "record_ix", "record_id", "seq"])
                    out.clear()
                    return got

                for ix, (head, seq) in enumerate(records(content.as_py())):
                    out.append((name.as_py(), ix, head, seq))
                    if len(out) == BATCH:
                        yield flush()
                if out:
                    yield flush()

    return files.select("filename", "content").mapInArrow(run, SCHEMA)


def read_fastx(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Records of files; ``-`` is standard input."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if paths == ["-"]:
        return from_bytes(spark, sys.stdin.buffer.read(), "-")
    return parse(spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("filename"), "content"))


def from_bytes(spark: SparkSession, data: bytes, filename: str = "") -> DataFrame:
    return parse(spark.createDataFrame([(filename, bytearray(data))], "filename string, content binary"))


def samples(spark: SparkSession, table: DataFrame) -> DataFrame:
    """``(name, input_moltype, filename, record_id, seq)`` for the samples of ``table(name, input_moltype, paths)``."""
    each = table.select("name", "input_moltype", F.explode("paths").alias("filename"))
    paths = sorted({r[0] for r in each.select("filename").distinct().collect()})  # a list of files is a driver-side table
    found = read_fastx(spark, paths) if paths else spark.createDataFrame([], SCHEMA)
    return found.join(each, "filename").select("name", "input_moltype", "filename", "record_id", "seq")
