"""Searching sketches as they arrive: a stream of postings against a static collection, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hashloom.model import Sketches, from_rows
from hashloom.operators.overlap import multisearch


def search_stream(rows: DataFrame, against: Sketches, id_col: str, hash_col: str, sink: Callable[[DataFrame, int], None], checkpoint: str, threshold: float = 0.01, **options) -> StreamingQuery:
    """Compare every sketch of a micro-batch of ``(id, hash)`` rows with ``against`` and hand the results to ``sink(df, batch)``.

    A sketch is what one batch holds of it, so its rows must arrive together (one file for a sketch, as a file source gives).
    A batch that is repeated after a failure has the same number, by which the sink can make its writes idempotent.
    """

    def batch(df: DataFrame, number: int) -> None:
        queries = from_rows(df, id_col, hash_col, bits=against.bits)
        sink(multisearch(queries, against, threshold, keep_ids=True, **options).withColumn("batch", F.lit(number)), number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
