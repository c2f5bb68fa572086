"""Sketch views of ordinary tables: baskets of keys and word shingles of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.hashing import max_hash, md5_64
from hashloom.model import Sketches, from_rows
from hashloom.scratch import materialize
from hashloom.session import spread

SHINGLE_BITS = 60


#: Bytes of text that a task cuts into shingles at once (a longer text alone).
BYTES = 1 << 20


def _shingled(text: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(number of the text, hash)`` of the shingles of lower-case texts that lie one after the other and end before ``ends``."""
    word = ((text >= 97) & (text <= 122)) | ((text >= 48) & (text <= 57))
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = np.append(0, ends[:-1])
    begins = begins[begins < len(text)]
    first[begins] = word[begins]
    # the words again, a space after each: a shingle is a stretch of this
    start = np.flatnonzero(first)
    if len(start) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(word)
    place = np.arange(len(at)) + np.cumsum(first[at]) - 1
    plain = np.full(len(at) + len(start), 32, np.uint8)
    plain[place] = text[at]
    begin = place[first[at]]
    end = np.append(begin[1:], len(plain)) - 1
    owner = np.searchsorted(ends, start, "right")
    kept = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    begin, end = begin[kept], end[kept + n - 1]
    return owner[kept], (md5_64(plain, begin, end - begin) >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64)


def shingle_rows(docs: DataFrame, id_col: str, text_col: str = "text", n: int = 3, scaled: int = 1) -> DataFrame:
    """``(id, hash)``: 60 bits of the md5 of every run of ``n`` words, repeats included; shorter texts have none.

    Words are what lies between stretches of other signs than a to z and 0 to 9, in lower case.  With ``scaled`` only the hashes that such a sketch keeps.
    """
    most, step = max_hash(scaled, SHINGLE_BITS), BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            if not len(texts):
                continue
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
            low = 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + step, "right")) - 1)
                owner, hashes = _shingled(data[offsets[low] : offsets[high]], offsets[low + 1 : high + 1] - offsets[low], n)
                kept = hashes <= most
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[kept] + low)), pa.array(hashes[kept])], ["id", "hash"])
                low = high

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).mapInArrow(run, f"id {kind}, hash bigint")


def stored(sk: Sketches) -> Sketches:
    """The collection with its postings written once, for plans that read them several times."""
    postings, _ = materialize(sk.postings, "postings")
    return Sketches(sk.manifest, postings, sk.bits)


def shingles(spark: SparkSession, sf_dir: str, table: str, abund: bool = True, scaled: int = 1) -> Sketches:
    """One sketch a text: its shingles, with how often each occurs; ``scaled`` leaves out the others before they are counted."""
    id_col = {"documents": "doc_id", "benchmark": "item_id"}[table]
    docs = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows = shingle_rows(spread(docs.select(id_col, "text")), id_col, scaled=scaled)
    return from_rows(rows, "id", "hash", abund=abund, bits=SHINGLE_BITS, scaled=scaled, keep=docs.select(F.col(id_col).alias("id")))


def supplier_parts(spark: SparkSession, sf_dir: str, abund: bool = True) -> Sketches:
    """One sketch a supplier: the parts it ships, with the number of lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey")
    return from_rows(lines, "l_suppkey", "l_partkey", abund=abund)


def nation_parts(spark: SparkSession, sf_dir: str, abund: bool = True) -> Sketches:
    """One sketch a customer nation: the parts ordered there."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return from_rows(rows.select(F.col("c_nationkey").cast("bigint").alias("nation"), "l_partkey"), "nation", "l_partkey", abund=abund)
