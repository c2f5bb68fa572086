"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items become passages of at most ``longest`` words; their words are the vocabulary.
2. Every document, whole, becomes a sequence of vocabulary numbers (0 for other words), written once to shared storage.
3. Inverse frequencies are counted over all blocks of ``BLOCK`` words of all documents.
4. A randomised singular value decomposition of the passages' TF-IDF matrix A gives the latent space: the product
   ``A'G`` with a Gaussian G and then the Gram matrix of A in the range found are summed over the distributed passages, and
   only matrices of (features x rank) and (rank x rank) reach the driver.
5. Each window of two neighbouring blocks is projected and compared with all passages; cosines of ``least_cosine`` make candidates.
6. A short passage is a small part of such a window, and a fixed rank blurs a large benchmark, so the cosine decides nothing alone:
   every stretch of two passage lengths (one begins at each half length) that holds as many of the passage's rarest words as the
   least subsequence implies is a candidate too, whatever its cosine.
7. A candidate is verified on the words around its window, or in its stretch: a bit-parallel longest common subsequence covers
   ``least_lcs`` of the passage, or ``paraphrase_lcs`` of it and the answer check holds: most of the answer's words (the passage's
   rarest ones, or the words of ``answer_col``) stand there too.

Vocabulary, frequencies and latent space are those of the whole benchmark, whatever its size; only the search goes through it in parts of
about ``part_words`` words, so that what is broadcast is bounded.  A vocabulary of more than ``most_words`` words is not broadcast: words
are numbered by a hash then, and two of them may share a number, by which no leak is lost.
Words are lower-cased and free of ASCII and typographic punctuation, so added marks and case changes do not hide a leak; in
scripts without spaces each character is a word.

Null texts count as empty; passages under ``least_words`` words are not looked for; repeated document rows give repeated
results; null ids are kept; extra columns are ignored; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm._arrow import rows
from hashloom.llm._text import spaced_words
from hashloom.scratch import materialize

BLOCK = 32
FEATURES = 1 << 14
STEP = 1024  # blocks that are projected at once
SLAB = 256  # words at which the stretches begin that are looked through at once


def split_passages(words: list, longest: int) -> list[list]:
    """The words cut into the fewest equal parts of at most ``longest``."""
    n = max(1, -(-len(words) // longest))
    return [words[k * len(words) // n : (k + 1) * len(words) // n] for k in range(n)]


def passages(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None, longest: int, least_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            out = [(i, k, p, spaced_words(a)) for i, t, a in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, p in enumerate(split_passages(spaced_words(t), longest)) if len(p) >= least_words]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["item_id", "part", "words", "answer"])

    answer = F.col(answer_col) if answer_col else F.lit(None)
    return benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), answer.cast("string").alias("_answer")).mapInArrow(run, "item_id long, part long, words array<binary>, answer array<binary>")


class Numbers:
    """Numbers of words, 0 for those outside the vocabulary; with a hash to ``size`` numbers when there is no vocabulary."""

    def __init__(self, words: list[bytes] | None, size: int):
        self.size = size if words is None else len(words)
        self.known = None if words is None else {w: k for k, w in enumerate(sorted(words), 1)}
        self.kind = "<u2" if self.size < 65535 else "<u4"

    def of(self, words: list[bytes]) -> list[int]:
        if self.known is not None:
            get = self.known.get
            return [get(w, 0) for w in words]
        return [1 + zlib.crc32(w) % self.size for w in words]


def numbered(docs: DataFrame, numbers: Numbers, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, ids)``: the number of every word of each document, little-endian, two bytes wide if the vocabulary allows."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for b in rows(batches):
            ids = [np.array(v.of(spaced_words(t)), v.kind).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids binary")


def idf_weights(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """Logarithmic inverse frequency of each number over all blocks of all documents (at least 0.1; 0 for number 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, blocks = np.zeros(size, np.int64), 0
        for b in rows(batches, 200):
            keys = []
            for raw in b.column(0).to_pylist():
                ids = np.frombuffer(raw, kind)
                at = np.flatnonzero(ids)
                keys.append((at // BLOCK + blocks) * size + ids[at])
                blocks += -(-len(ids) // BLOCK)
            keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            df += np.bincount(keys % size, minlength=size)
        df[0] = blocks
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["id", "n"])

    got = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each vocabulary word at most
    df = np.zeros(size)
    df[got["id"].to_numpy()] = got["n"].to_numpy()
    idf = np.maximum(0.1, np.log((1 + df[0]) / (1 + df)))
    idf[0] = 0.0
    return idf


def tfidf(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(ids[ids > 0], return_counts=True)
    return at % FEATURES, n * idf[at]


def latent_basis(numbers: DataFrame, idf: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (features x rank) of the passages ``numbers(ids)``, by a randomised range finder."""
    spark = numbers.sparkSession
    weights = spark.sparkContext.broadcast(idf)

    def passed(basis: np.ndarray | None) -> np.ndarray:
        """The sum over passages a of a' (a basis), or with no basis of a' g with a fresh Gaussian row g for each passage."""
        held = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, q = weights.value, held.value
            total = np.zeros((rank if q is not None else FEATURES, rank))
            for b in rows(batches):
                for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    at, x = tfidf(np.array(ids, np.int64), w)
                    if q is None:
                        g = np.random.default_rng((seed, key & 0x7FFFFFFFFFFFFFFF)).standard_normal(rank)
                        np.add.at(total, at, x[:, None] * g)
                    else:
                        y = x @ q[at]
                        total += np.outer(y, y)
            some = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["row", "v"])

        sums = [F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(rank)]
        got = numbers.select("key", "ids").mapInArrow(run, "row long, v array<double>").groupBy("row").agg(*sums).toPandas()  # (features or rank) x rank cells
        out = np.zeros((rank if basis is not None else FEATURES, rank))
        if len(got):
            out[got["row"].to_numpy()] = got.drop(columns="row").to_numpy()
        return out

    q, _ = np.linalg.qr(passed(None))
    values, vectors = np.linalg.eigh(passed(q))
    return (q @ vectors[:, ::-1]).astype(np.float32)


def lcs_length(masks: dict[int, int], size: int, seq: list[int]) -> int:
    """Longest common subsequence of ``seq`` with the passage whose positions ``masks`` holds, a machine word at a time."""
    full = (1 << size) - 1
    v = full
    for t in seq:
        m = masks.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Index:
    """Latent passages with all that verification needs."""

    def __init__(self, items: list[tuple], idf: np.ndarray, basis: np.ndarray):
        self.items, self.idf, self.basis = items, idf, basis
        flat = []
        for _, _, ids, _ in items:
            at, x = tfidf(np.array(ids, np.int64), idf)
            flat.append(x.astype(np.float32) @ basis[at])
        lat = np.array(flat, np.float32).reshape(len(items), basis.shape[1])
        self.latent = lat / np.maximum(np.linalg.norm(lat, axis=1, keepdims=True), 1e-12)
        self.word = (np.arange(len(idf)) % FEATURES).astype(np.int64)
        self.weight = idf.astype(np.float32)
        self.masks: dict[int, dict[int, int]] = {}
        self.reach = max((len(ids) for _, _, ids, _ in items), default=0)

    def project(self, ids: np.ndarray) -> np.ndarray:
        """Latent vector of each block of one document."""
        n = max(1, -(-len(ids) // BLOCK))
        out = np.zeros((n, self.basis.shape[1]), np.float32)
        for first in range(0, n, STEP):
            part = ids[first * BLOCK : (first + STEP) * BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                block = at // BLOCK
                starts = np.flatnonzero(np.diff(block, prepend=-1))
                t = part[at]
                out[first + block[starts]] = np.add.reduceat(self.basis[self.word[t]] * self.weight[t][:, None], starts)
        return out

    def candidates(self, ids: np.ndarray, least: float) -> list[tuple[float, int, int]]:
        """``(cosine, window, passage)`` of all windows that reach ``least``, best first."""
        blocks = self.project(ids)
        windows = blocks[:-1] + blocks[1:] if len(blocks) > 1 else blocks
        norm = np.linalg.norm(windows, axis=1)
        live = np.flatnonzero(norm > 0)
        out = []
        step = max(16, (1 << 21) // max(1, len(self.items)))
        for at in range(0, len(live), step):
            w = live[at : at + step]
            cos = (windows[w] / norm[w][:, None]) @ self.latent.T
            i, j = np.nonzero(cos >= least)
            out += zip(cos[i, j].tolist(), w[i].tolist(), j.tolist(), strict=True)
        return sorted(out, reverse=True)

    def prepare(self, least: float) -> None:
        """The net that ``stretches`` casts for subsequences of the share ``least``.

        If at most ``n - m`` of a passage's n words may be missing, at least ``k - (n - m)`` of any k of them are there; the k
        rarest are taken, so that common words cost nothing.
        """
        owners: list[list[int]] = [[] for _ in range(len(self.idf))]
        times: list[list[int]] = [[] for _ in range(len(self.idf))]
        self.need, self.rare = np.zeros(len(self.items), np.int64), []
        for p, (_, _, ids, _) in enumerate(self.items):
            missing = len(ids) - max(1, math.ceil(least * len(ids) - 1e-9))
            k = min(len(ids), missing + max(1, len(ids) // 5))
            words, n = np.unique(sorted(ids, key=lambda t: (-self.idf[t], t))[:k], return_counts=True)
            self.need[p] = k - missing
            self.rare.append(words)
            for t, c in zip(words.tolist(), n.tolist(), strict=True):
                owners[t].append(p)
                times[t].append(c)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in owners])])
        self.owner = np.array([p for x in owners for p in x], np.int64)
        self.times = np.array([c for x in times for c in x], np.int64)
        self.mark = np.zeros(len(self.idf), bool)

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(first word, passage)`` of all stretches that may hold the passage by the number of its rarest words in them."""
        for at in range(0, len(ids) if len(self.items) else 0, SLAB):
            part = ids[at : at + SLAB + 2 * self.reach]
            seen = np.unique(part)
            low = self.first[seen]
            n = self.first[seen + 1] - low
            entries = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            there = np.bincount(self.owner[entries], self.times[entries], len(self.items))
            for p in np.flatnonzero(there >= self.need).tolist():
                size = len(self.items[p][2])
                self.mark[self.rare[p]] = True
                hits = np.flatnonzero(self.mark[part])
                self.mark[self.rare[p]] = False
                begin = np.arange(0, min(SLAB, len(ids) - at), max(1, size // 2))
                inside = np.searchsorted(hits, begin + 2 * size) - np.searchsorted(hits, begin)
                for b in begin[inside >= self.need[p]].tolist():
                    yield at + b, p

    def cosine(self, ids: np.ndarray, passage: int) -> float:
        at, x = tfidf(ids.astype(np.int64), self.idf)
        v = x.astype(np.float32) @ self.basis[at]
        return float(v @ self.latent[passage] / max(float(np.linalg.norm(v)), 1e-12))

    def share(self, passage: int, near: list[int]) -> float:
        """The share of the passage in its common subsequence with ``near``."""
        words = self.items[passage][2]
        masks = self.masks.get(passage)
        if masks is None:
            if len(self.masks) > 20_000:
                self.masks.clear()
            masks = self.masks[passage] = {}
            for k, t in enumerate(words):
                masks[t] = masks.get(t, 0) | 1 << k
        return lcs_length(masks, len(words), near) / len(words)

    def verify_stretch(self, ids: np.ndarray, first: int, passage: int, least_lcs: float, paraphrase_lcs: float) -> tuple[float, bool, bool]:
        """As ``verify``, in the stretch of two passage lengths from ``first`` on."""
        _, _, words, answer = self.items[passage]
        last = first + 2 * len(words)
        share = self.share(passage, ids[first:last].tolist())
        if share < min(least_lcs, paraphrase_lcs):
            return share, False, False
        there = set(ids[max(0, first - self.reach) : last + self.reach].tolist())
        found = bool(answer) and sum(t in there for t in answer) >= 0.8 * len(answer)
        return share, found, share >= least_lcs or (share >= paraphrase_lcs and found)

    def verify(self, ids: np.ndarray, window: int, passage: int, least_lcs: float, paraphrase_lcs: float, held: dict | None = None) -> tuple[float, bool, bool]:
        """``(share of the passage in the common subsequence, answer found, leak)``; ``held`` keeps what candidates of a document share.

        No common subsequence is longer than the number of passage words that stand near the window at all, which is
        counted first.
        """
        _, _, words, answer = self.items[passage]
        held = {} if held is None else held
        there = held.get(window)
        if there is None:
            there = held[window] = set(ids[max(0, window * BLOCK - self.reach) : (window + 2) * BLOCK + self.reach].tolist())
        if len([t for t in words if t in there]) < paraphrase_lcs * len(words):
            return 0.0, False, False
        near = ids[max(0, window * BLOCK - len(words)) : (window + 2) * BLOCK + len(words)].tolist()
        share = self.share(passage, near)
        found = bool(answer) and sum(t in there for t in answer) >= 0.8 * len(answer)
        return share, found, share >= least_lcs or (share >= paraphrase_lcs and found)


def _search(tokens: DataFrame, index: Index, kind: str, least_cosine: float, least_lcs: float, paraphrase_lcs: float) -> DataFrame:
    held = tokens.sparkSession.sparkContext.broadcast((index.items, index.idf, index.basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = Index(*held.value)
        ix.prepare(min(least_lcs, paraphrase_lcs))
        for b in rows(batches):
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind)
                best: dict[int, tuple] = {}
                shared: dict = {}
                for cos, w, p in ix.candidates(ids, least_cosine):
                    if p in best and best[p][1] >= least_lcs:
                        continue
                    share, found, leak = ix.verify(ids, w, p, least_lcs, paraphrase_lcs, shared)
                    if leak and (p not in best or share > best[p][1]):
                        best[p] = (cos, share, found, w * BLOCK)
                for first, p in ix.stretches(ids):
                    if p in best and best[p][1] >= least_lcs:
                        continue
                    share, found, leak = ix.verify_stretch(ids, first, p, least_lcs, paraphrase_lcs)
                    if leak and (p not in best or share > best[p][1]):
                        best[p] = (ix.cosine(ids[first : first + 2 * len(ix.items[p][2])], p), share, found, first)
                out += [(doc, ix.items[p][0], ix.items[p][1], *v) for p, v in best.items()]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "part", "cosine", "lcs", "answer", "word"])

    return tokens.mapInArrow(run, "doc_id long, item_id long, part long, cosine double, lcs double, answer boolean, word long")


SCHEMA = "doc_id long, item_id long, part long, cosine double, lcs double, answer boolean, word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, longest: int = 64, least_words: int = 5, rank: int = 128, least_cosine: float = 0.5, least_lcs: float = 0.8, paraphrase_lcs: float = 0.6, part_words: int = 1_000_000, most_words: int = 1 << 21) -> DataFrame:
    """``(doc_id, item_id, part, cosine, lcs, answer, word)``: a row for each document row and benchmark passage that leaked into it.

    ``word`` is the number of the document's word at which the window begins.
    """
    spark = docs.sparkSession
    table, _ = materialize(passages(benchmark, item_col, item_text_col, answer_col, longest, least_words).withColumn("key", F.xxhash64("item_id", "part")), "passages")
    n, total = table.agg(F.count(F.lit(1)), F.sum(F.size("words") + F.size("answer"))).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    vocabulary, _ = materialize(table.select(F.explode(F.concat("words", "answer")).alias("word")).distinct(), "vocabulary")
    few = vocabulary.count() <= most_words
    numbers = Numbers([bytes(r["word"]) for r in vocabulary.collect()] if few else None, most_words)
    tokens, _ = materialize(numbered(docs, numbers, id_col, text_col), "numbered")
    idf = idf_weights(tokens, numbers.size + 1, numbers.kind)
    held = spark.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            ids, answers = ([held.value.of(x) for x in b.column(k).to_pylist()] for k in (3, 4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, pa.list_(pa.int64())) for x in (ids, answers))], ["key", "item_id", "part", "ids", "answer"])

    coded, _ = materialize(table.select("key", "item_id", "part", "words", "answer").mapInArrow(run, "key long, item_id long, part long, ids array<long>, answer array<long>"), "coded")
    basis = latent_basis(coded.repartition(max(1, min(n // 64, spark.sparkContext.defaultParallelism))), idf, min(rank, FEATURES, n))
    out = spark.createDataFrame([], SCHEMA)
    parts = -(-int(total) // part_words)
    for k in range(parts):
        items = []
        for r in coded.filter(F.pmod("key", F.lit(parts)) == k).orderBy("item_id", "part").collect():  # about ``part_words`` words
            rare = sorted(set(r["ids"]), key=lambda t: (-idf[t], t))
            items.append((r["item_id"], r["part"], r["ids"], r["answer"] or rare[: max(3, len(rare) // 4)]))
        if items:
            out = out.unionByName(_search(tokens, Index(items, idf, basis), numbers.kind, least_cosine, least_lcs, paraphrase_lcs))
    return out
