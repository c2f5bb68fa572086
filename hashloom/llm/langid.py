"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams (one to three code points of the lower-cased text) of every
learning document by language: each task counts whole batches with ``bincount`` and emits the
non-zero cells once, and one aggregation adds them up.  The log-probability matrix has
(languages x buckets) cells, a size that the parameter ``buckets`` bounds, and is broadcast.  Scoring gathers
the rows of a batch's n-grams in numpy and sums them document by document over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm._arrow import rows

SPAN = 1 << 18  # code points that are hashed at once
MATRIX_BYTES = 256 << 20  # the largest matrix that is broadcast


def _spans(text: str) -> Iterator[str]:
    """The text cut at ``SPAN`` code points; neighbours share two, so that every n-gram ends in one span."""
    yield text[:SPAN]
    for at in range(SPAN, len(text), SPAN):
        yield text[at - 2 : at + SPAN]


def grams(text: str, buckets: int, first: bool = True) -> np.ndarray:
    """Buckets of all n-grams of one span; with ``first`` unset, of those that end after its first two code points."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    out = []
    for n in (1, 2, 3):
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h[0 if first else 3 - n :] >> np.uint64(7))
    return (np.concatenate(out) % np.uint64(buckets)).astype(np.int64) if out else np.zeros(0, np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15) -> tuple[list[str], np.ndarray]:
    """Languages in ascending order and the matrix (buckets, languages) of smoothed log probabilities, the prior in a last row.

    Rows whose text or language is null take no part.  The counts cover every row given.  A matrix above ``MATRIX_BYTES`` is an
    error that says to take fewer buckets (1,000 languages fit at the default).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in rows(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = total.setdefault(lang, np.zeros(buckets + 1, np.int64))
                held[buckets] += 1
                for k, span in enumerate(_spans(text)):
                    held += np.bincount(grams(span, buckets, not k), minlength=buckets + 1)
        for lang, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(held[at])], ["lang", "bucket", "n"])

    usable = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    cells = usable.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets rows
    langs = sorted(cells["lang"].unique())
    if len(langs) * buckets * 8 > MATRIX_BYTES:
        raise ValueError(f"{len(langs)} languages of {buckets} buckets exceed {MATRIX_BYTES} bytes: train with fewer buckets")
    count = np.zeros((buckets + 1, len(langs)))
    count[cells["bucket"].to_numpy(), np.searchsorted(langs, cells["lang"].to_numpy())] = cells["n"]
    grown = count[:buckets] + 0.5
    logs = np.log(grown / grown.sum(axis=0))
    prior = np.log(np.maximum(count[buckets:], 1) / max(1, count[buckets].sum()))
    return langs, np.concatenate([logs, prior]).astype(np.float64)


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``: the likeliest language (ties: the first by name) and its posterior probability.

    ``und`` with score 0 if the text is null or has no letter, or no language was learned.  Every row, repeated ones included,
    gets a result from its text alone; a null id is kept.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((langs, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = held.value
        buckets = len(logs) - 1
        rest = np.ascontiguousarray(logs[:buckets].T)
        for b in rows(batches):
            pred, score = [], []
            for text in b.column(1).to_pylist():
                if not langs or text is None or next(filter(str.isalpha, text), None) is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                count = np.zeros(buckets, np.int64)
                for k, span in enumerate(_spans(text)):
                    count += np.bincount(grams(span, buckets, not k), minlength=buckets)
                at = np.flatnonzero(count)
                s = logs[buckets] + rest[:, at] @ count[at]
                best = int(np.argmax(s))
                pred.append(langs[best])
                score.append(float(1 / np.exp(s - s[best]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
