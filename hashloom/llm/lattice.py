"""Document likelihood on a subword lattice.

An existing subword vocabulary spans, over each word (with its word-start mark), the lattice of all
segmentations into pieces.  Pieces are drawn independently with unigram probabilities, so the marginal
probability of a word is the sum over all paths, which a forward recursion in log space gives; the
probability of a text is the product over its words and the end token.

Scores.  The vocabulary's order of merges gives the first scores (a piece of rank r has a weight of
1/(r + 2)).  Expectation steps over every distinct training word, weighted by its count, turn them into
expected piece counts and these, smoothed, into the next scores, until the likelihood of a training token rises by less than
``tolerance`` (natural logarithm) a step.

Recursions run over many words at once: words of one length stand side by side, one numpy step takes all of them a code point
further, and pieces are found by rolling hashes.  Long words are worked on in segments, so that memory stays bounded.

Corpus tables.  One pass counts the words of all texts, task by task with bounded memory, and one aggregation
adds the counts; the result has a row for each distinct word of the corpus and grows with it.  Its head, the most
frequent words up to ``head`` rows (a bound on what is broadcast), is looked up while texts are scored; all other words reach their
counts and probabilities by an equi-join, already grouped by document.  Words over ``SHORT`` bytes go by a 128-bit digest
there, so that a frequent long word is broadcast like any other.

The base score is additive smoothing over whole words:
``log10((c + 0.1) / (N + 0.1 (V + 1)))`` for each token.

Null text counts as empty and has the end token alone; rows that are repeated are scored each (and counted each in training);
a null id is kept, and counts as one whose remainder is not 0; extra columns are ignored; an empty table gives no rows.  Without
training rows N and V are 0 and the lattice keeps the vocabulary's own scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm._arrow import rows, utf8
from hashloom.scratch import materialize

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACE = re.compile(rb"[\x20\x09-\x0d]")
START = "▁"
END = b""  # the end token: no word is empty
SMOOTH = 0.1
SHORT = 64  # bytes of a word that stands for itself in joins and broadcasts
CHUNK = 1 << 20  # bytes of a text that are split at once
HELD_BYTES = 64 << 20  # bytes of text whose words are counted before they are handed on
CELLS = 1 << 14  # code points whose words are worked on at once
SEGMENT = 1 << 12  # code points of a word that are worked on at once


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    """Where an installed public vocabulary lies; resolved on the machine that reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces in order; control and byte pieces are left out (bytes have a fallback of their own)."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, part by part."""
    data = utf8(text).translate(LOWER)
    at = 0
    while at < len(data):
        cut = SPACE.search(data, at + CHUNK) if len(data) - at > CHUNK else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def key_of(word: bytes) -> bytes:
    """What a word is joined by: itself, or if it is long a space (which no word holds) and its 128-bit digest."""
    if len(word) <= SHORT:
        return word
    from xxhash import xxh3_128_digest

    return b" " + xxh3_128_digest(word)


def _roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _codes(texts: list[str], n: int) -> np.ndarray:
    """Code points of texts of ``n`` code points each, a row for each position."""
    return np.ascontiguousarray(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(len(texts), n).T).astype(np.uint64)


class Lattice:
    """Recursions over the segmentations of words; ``logs`` are natural logarithms, the last 257 those of bytes and the end."""

    def __init__(self, pieces: list[str], logs: np.ndarray):
        self.logs, self.n = logs, len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.end = float(logs[-1])
        by_size: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            by_size.setdefault(len(p), []).append(k)
        self.hashes = np.zeros(self.n, np.uint64)
        for size, at in by_size.items():
            h = np.zeros(len(at), np.uint64)
            for c in _codes([pieces[k] for k in at], size):
                h = _roll(h, c)
            self.hashes[at] = h
        # open addressing: a slot holds the number of a piece or -1
        bits = max(4, (8 * self.n).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(self.n), (self.hashes >> self.shift).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = left[free]
            stay = self.slots[slot] != left
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The pieces of these hashes, -1 where there is none."""
        flat = h.ravel()
        slot = (flat >> self.shift).astype(np.int64)
        out = self.slots[slot]
        check = np.flatnonzero(out >= 0)
        check = check[self.hashes[out[check]] != flat[check]]
        while len(check):
            slot[check] = (slot[check] + 1) & self.mask
            out[check] = self.slots[slot[check]]
            check = check[out[check] >= 0]
            check = check[self.hashes[out[check]] != flat[check]]
        return out.reshape(h.shape)

    def edges(self, codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Pieces that end at the positions low + 1 to high of words of one length: numbers and scores by (position, length, word).

        A code point outside the vocabulary goes by its bytes: it takes a number of its own behind those of ``logs``, in the order of the
        list returned.  The last number means that there is no piece.
        """
        first, words = max(0, low - self.longest + 1), codes.shape[1]
        h = np.zeros((high - first, words), np.uint64)
        ids = np.full((high - low, self.longest, words), -1, np.int32)
        for size in range(1, min(self.longest, high - first) + 1):
            h = _roll(h[: high - first - size + 1], codes[first + size - 1 : high])
            skip = max(0, low + 1 - size - first)  # starts whose piece of this size ends before
            if skip < len(h):
                ids[first + skip + size - low - 1 :, size - 1] = self.lookup(h[skip:])
        single = ids[:, 0]
        odd = np.nonzero(single < 0)
        names, inverse = np.unique(codes[low:high][odd], return_inverse=True)
        spelled = [chr(int(c)).encode("utf-8", "replace") for c in names]
        total = len(self.logs)
        single[odd] = total + inverse
        ids[ids < 0] = total + len(names)
        scores = np.concatenate([self.logs, [sum(self.logs[self.n + b] for b in s) for s in spelled], [-np.inf]])
        return ids, scores[ids], spelled

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(indices, codes)`` of words of one length, at most ``CELLS`` code points at once (a longer word stands alone)."""
        texts = [START + w.decode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(sizes, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            n = int(sizes[run[0]]) if len(run) else 0
            step = max(1, CELLS // max(1, n))
            for at in range(0, len(run), step):
                part = run[at : at + step]
                yield part, _codes([texts[k] for k in part], n)

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Log probabilities of all beginnings, by position and word; and the last segment's edges."""
        n, words = codes.shape
        alpha = np.zeros((n + 1, words))
        held: tuple = ()
        for low in range(0, n, SEGMENT):
            held = self.edges(codes, low, min(n, low + SEGMENT))
            for j, s in enumerate(held[1], low + 1):
                m = min(j, self.longest)
                terms = alpha[j - m : j][::-1] + s[:m]
                high = terms.max(axis=0)
                terms -= high
                alpha[j] = high + np.log(np.exp(terms, out=terms).sum(axis=0))
        return alpha, held

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """Natural logs of the words' marginal probabilities."""
        out = np.full(len(words), self.end)
        inner = np.array([k for k, w in enumerate(words) if w != END], np.int64)
        for at, codes in self.groups([words[k] for k in inner]):
            out[inner[at]] = self.forward(codes)[0][-1]
        return out

    def expect(self, words: list[bytes], counts: np.ndarray, into: np.ndarray) -> float:
        """Add the expected uses of each piece, times the words' counts; returns the log likelihood of all uses."""
        ends = np.array([w == END for w in words], bool)
        into[-1] += counts[ends].sum()
        likelihood = self.end * float(counts[ends].sum())
        inner = np.flatnonzero(~ends)
        for at, codes in self.groups([words[k] for k in inner]):
            n, total = codes.shape[0], len(self.logs)
            alpha, held = self.forward(codes)
            count = counts[inner[at]].astype(np.float64)
            likelihood += float(alpha[-1] @ count)
            mass = np.zeros(alpha.shape)  # expected passes through each position
            mass[n] = count
            for low in reversed(range(0, n, SEGMENT)):
                ids, scores, spelled = held if low + SEGMENT >= n else self.edges(codes, low, low + SEGMENT)
                for j in range(len(scores), 0, -1):
                    m = min(low + j, self.longest)
                    share = scores[j - 1]
                    np.exp(alpha[low + j - m : low + j][::-1] + share[:m] - alpha[low + j], out=share[:m])
                    share[:m] *= mass[low + j]
                    share[m:] = 0.0
                    mass[low + j - m : low + j][::-1] += share[:m]
                uses = np.flatnonzero(ids.ravel() < total + len(spelled))
                got = np.bincount(ids.ravel()[uses], scores.ravel()[uses], total + len(spelled))
                into += got[:total]
                for s, k in zip(spelled, got[total:], strict=True):
                    for b in s:
                        into[self.n + b] += k
        return likelihood


def first_logs(pieces: list[str]) -> np.ndarray:
    """Scores by the vocabulary's own order; bytes rank behind all pieces, the end before them."""
    w = 1.0 / (np.arange(len(pieces) + 257) + 2.0)
    w[-1] = 0.5
    return np.log(w / w.sum())


def count_words(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """``(word, n, c)``: uses in all texts and in those where ``train`` holds; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        size = 0  # no less than the bytes of the words held

        def out() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(held):
                n = pa.array(list(c.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), n, n if k else pa.array(np.zeros(len(c), np.int64))], ["word", "n", "c"])
                c.clear()

        for b in rows(batches, 200):
            for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = held[bool(t)]
                c[END] += 1
                for part in word_lists(text):
                    c.update(part)
                    size += sum(map(len, part)) if len(part) < 1000 else CHUNK
                    if size > HELD_BYTES or len(c) > 400_000:
                        yield from out()
                        size = 0
        yield from out()

    parts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train")).mapInArrow(run, "word binary, n long, c long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _held(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of words put together, so that there are many words of each length."""
    parts: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        parts.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= most or size > CHUNK * 16:
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if n else b
            parts, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def fit(words: DataFrame, vocabulary: Callable[[], str] = vocabulary_path, tolerance: float = 0.01, most_steps: int = 30, history: list[float] | None = None) -> np.ndarray:
    """Scores fitted to the training words of ``words(word, c)``; the result has a cell for each piece.

    ``history`` takes the log likelihood of a training token before each step.
    """
    spark = words.sparkSession
    pieces = load_pieces(vocabulary())
    logs, last = first_logs(pieces), -math.inf
    for _ in range(most_steps):
        held = spark.sparkContext.broadcast(logs)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            pieces = load_pieces(vocabulary())
            lattice, total, likelihood, n = Lattice(pieces, held.value), np.zeros(len(pieces) + 257), 0.0, 0
            for b in _held(batches):
                counts = b.column(1).to_numpy()
                likelihood += lattice.expect(b.column(0).to_pylist(), counts, total)
                n += int(counts.sum())
            at = np.flatnonzero(total)
            # two more rows: the likelihood and the number of tokens
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([total[at], [likelihood, n]]))], ["piece", "n"])

        got = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # two rows more than there are pieces at most
        held.unpersist()
        found = dict(zip(got["piece"].tolist(), got["n"].tolist(), strict=True))
        tokens, likelihood = found.pop(-2, 0.0), found.pop(-1, 0.0)
        if not tokens:
            break
        total = np.full(len(logs), SMOOTH)
        total[list(found)] += list(found.values())
        logs = np.log(total / total.sum())
        if history is not None:
            history.append(likelihood / tokens)
        if likelihood / tokens - last < tolerance:
            break
        last = likelihood / tokens
    return logs


def _threshold(words: DataFrame, head: int) -> int:
    """The least count n such that at most ``head`` words have n or more uses, by a histogram of 16 bins an octave."""
    bin_ = F.floor(F.log2("n") * 16)
    found = words.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).orderBy(F.desc("b")).collect()  # below 1,024 rows
    least, total = 1 << 62, 0
    for r in found:
        total += r["k"]
        if total > head:
            break
        least = r["low"]
    return least


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: Callable[[], str] = vocabulary_path, head: int = 1 << 17, tolerance: float = 0.01) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row, learned where ``held_out`` is not true."""
    spark = docs.sparkSession
    out = F.coalesce(held_out, F.lit(False))
    words, _ = materialize(count_words(docs, ~out, text_col), "words")
    n, v = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    logs = spark.sparkContext.broadcast(fit(words, vocabulary, tolerance))

    def lattice_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(load_pieces(vocabulary()), logs.value)
        for b in _held(batches):
            held = b.column(0).to_pylist()
            lp = lattice.log_probs(held) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, held), pa.binary()), b.column(1), b.column(2), pa.array(lp)], ["word", "n", "c", "lp"])

    scored, _ = materialize(words.select("word", "n", "c").mapInArrow(lattice_logs, "word binary, n long, c long, lp double"), "scored")
    least = _threshold(scored, head)
    floor = n + SMOOTH * (v + 1)
    top = scored.filter(F.col("n") >= least).toPandas()  # ``head`` rows at most, each of a bounded length
    base_logs = np.log10((top["c"].to_numpy(np.float64) + SMOOTH) / floor)
    common = spark.sparkContext.broadcast({bytes(w): (float(b), float(p), int(c > 0)) for w, b, p, c in zip(top["word"], base_logs, top["lp"], top["c"], strict=True)})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = common.value, TaskContext.get().partitionId() << 33
        for b in rows(batches, 500):
            cols: list[list] = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                tf = Counter((END,))
                for part in word_lists(text):
                    tf.update(part)
                base = lat = 0.0
                have = total = 0
                rare, times = [], []
                for w, k in tf.items():
                    total += k
                    w = w if len(w) <= SHORT else key_of(w)
                    hit = known.get(w)
                    if hit is None:
                        rare.append(w)
                        times.append(k)
                    else:
                        base += k * hit[0]
                        lat += k * hit[1]
                        have += k * hit[2]
                for c, value in zip(cols, (row, total, have, base, lat, rare, times), strict=True):
                    c.append(value)
                row += 1
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "lat", "rare", "times"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), out.alias("held_out"))
    first, _ = materialize(source.mapInArrow(texts, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, lat double, rare array<binary>, times array<long>"), "texts")
    rest = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("k"))
    found = rest.join(scored.filter(F.col("n") < least).select("word", "c", "lp"), "word")
    tail = found.select(
        "row", F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("n_known"), (F.col("k") * F.log10((F.col("c") + SMOOTH) / F.lit(floor))).alias("base"), (F.col("k") * F.col("lp")).alias("lat")
    )
    none = F.lit(None)
    both = first.select("row", "n_known", "base", "lat", "doc_id", "held_out", "n_tokens").unionByName(
        tail.withColumns({"doc_id": none.cast("long"), "held_out": none.cast("boolean"), "n_tokens": none.cast("long")})
    )
    done = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lat").alias("score"))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
