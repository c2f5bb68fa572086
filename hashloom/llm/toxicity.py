"""Toxicity scores from a lexicon trie searched with Levenshtein automata.

Lexicon.  Entries are whole words or stems (word beginnings) that labelled documents show to be toxic;
``learn_lexicon`` picks them from document frequencies by label, or a caller brings a list.

Matching.  The entries form a trie.  The Levenshtein automaton of a lexicon entry accepts what lies within
its edit budget (none below five letters, one from five, two from ten; the first letter stays; stems take no edits).  All the automata run together over the trie: a state is a set of (trie node, edits spent), and states are
determinised as words reach them, so a word costs one table look-up a letter and most words die
after a few letters.  An entry of d edits, cut into d + 1 pieces, leaves one piece whole in whatever it matches; words
that hold no such piece are told by a few set look-ups and never reach the automaton.

Context.  A hit inside quotation marks or near a reporting word within ``WINDOW`` words counts as quoted,
one near a word of direct address as aimed.  The document's features (log counts of exact,
misspelled, quoted and aimed hits, summed entry weights, density) enter a logistic model that is fitted on a bounded sample of
labelled rows.

Null and empty texts score like a text without hits.  Each row, repeated or not, is scored from its text alone; a null
id is kept; extra columns are ignored.  Without labelled rows of both kinds nothing can be learned: every score is then the share of toxic
labels, or 0 without labels.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm._arrow import rows, utf8
from hashloom.llm._text import plain_words
from hashloom.scratch import materialize

WORD = re.compile(r"[^\W_]+")
MARKS = re.compile(r'["“”«»„]')
WINDOW = 6
REPORTING = frozenset("said says wrote writes quoted quote called calls dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your you're youre u tu toi vous du dich dein ihr tú usted eres".split())
STEMS = (3, 4, 5, 6, 7)
CHUNK = 1 << 20
FEATURES = 7
STATES = 50_000  # states of the automaton that are kept
MEMO = 200_000  # words whose matches are kept
LONGEST = 64  # bytes of a word that the lexicon may learn


def chunks(text: str) -> Iterator[str]:
    """Pieces of about a million code points, cut at white space where there is any."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = cut if cut > at else end
        yield text[at:end]
        at = end


@dataclass
class Lexicon:
    """Entries with weights; a key that ends with ``*`` is a stem.  Only ``firm`` words take edits (None: all words), which ``learn_lexicon`` makes all it learned."""

    weights: dict[str, float] = field(default_factory=dict)
    firm: frozenset[str] | None = None

    def edits(self, entry: str) -> int:
        if entry.endswith("*") or len(entry) < 5 or (self.firm is not None and entry not in self.firm):
            return 0
        return 1 if len(entry) < 10 else 2

    def __post_init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.budget: list[int] = [0]  # the most that any entry below may spend
        for entry in sorted(self.weights):
            text, is_stem = entry.rstrip("*"), entry.endswith("*")
            spend = self.edits(entry)
            node = 0
            self.budget[0] = max(self.budget[0], spend)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], spend)
            if is_stem:
                self.stem[node] = entry
            else:
                self.word[node] = entry
        self.whole = {e.encode() for e in self.weights if not e.endswith("*")}
        self.begins = {e[:-1].encode() for e in self.weights if e.endswith("*")}
        self.begin_sizes = sorted({len(e) for e in self.begins})
        self.pieces: set[tuple[str, int, int, str]] = set()
        layout: dict[tuple[str, int], set[tuple[int, int]]] = {}
        for entry in self.weights:
            spend = self.edits(entry)
            cuts = [1 + k * (len(entry) - 1) // (spend + 1) for k in range(spend + 2)] if spend else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                # edits before and after the piece shift it and change the length, never more than there are
                for size in range(len(entry) - spend, len(entry) + spend + 1):
                    for at in range(max(1, a - spend), a + spend + 1):
                        before, after = abs(at - a), abs((size - at) - (len(entry) - a))
                        if before + after <= spend and (before == 0 or a > 1) and (after == 0 or b < len(entry)) and at + b - a <= size:
                            self.pieces.add((entry[0], size, at, entry[a:b]))
                            layout.setdefault((entry[0], size), set()).add((at, at + b - a))
        self.layout = {k: sorted(v) for k, v in layout.items()}
        self.memo: dict[bytes, tuple[str, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        """Drop all states; state 0 is dead, state 1 the start."""
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.begun: list[tuple[int, str] | None] = []  # the best stem that a state completes
        self.ended: list[tuple[int, str] | None] = []  # the best word that ends in a state
        for state in (frozenset(), frozenset({(0, 0)})):
            self._number(state)

    def _number(self, state: frozenset) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.begun.append(min(((0, self.stem[node]) for node, spent in state if not spent and self.stem[node]), default=None))
            self.ended.append(min(((spent, self.word[node]) for node, spent in state if self.word[node] and spent <= self.edits(self.word[node])), default=None))
        return k

    def _step(self, state: frozenset, c: str) -> frozenset:
        """States after one letter: match, substitution and insertion, then any deletions."""
        out: dict[int, int] = {}

        def add(node: int, spent: int) -> None:
            if spent <= self.budget[node] and spent < out.get(node, 99):
                out[node] = spent
                if node:  # the first letter of an entry stays
                    for child in self.children[node].values():
                        add(child, spent + 1)

        for node, spent in state:
            if c in self.children[node]:
                add(self.children[node][c], spent)
            if node:
                add(node, spent + 1)
                for child in self.children[node].values():
                    add(child, spent + 1)
        return frozenset(out.items())

    def find(self, word: str) -> tuple[str, int] | None:
        """The matching entry of the fewest edits (ties: first by name) and the edits, or None."""
        if len(self.states) > STATES:
            self._forget()
        moves, begun = self.moves, self.begun
        at = 1
        best: tuple[int, str] | None = None
        for c in word:
            to = moves[at].get(c)
            if to is None:
                to = moves[at][c] = self._number(self._step(self.states[at], c))
            at = to
            if not at:
                break
            if begun[at] and (best is None or begun[at] < best):
                best = begun[at]
        if self.ended[at] and (best is None or self.ended[at] < best):
            best = self.ended[at]
        return (best[1], best[0]) if best else None

    def possible(self, w: bytes) -> bool:
        """False only for words that match no entry."""
        if w in self.whole:
            return True
        for k in self.begin_sizes:
            if w[:k] in self.begins:
                return True
        word = w.decode()
        size, pieces = len(word), self.pieces
        for a, b in self.layout.get((word[:1], size), ()):
            if (word[0], size, a, word[a:b]) in pieces:
                return True
        return False

    def lookup(self, words: Iterable[bytes]) -> dict[str, tuple[str, int]]:
        """The words that match an entry, with what they match."""
        memo, found = self.memo, {}
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            try:
                hit = memo[w]
            except KeyError:
                hit = memo[w] = self.find(w.decode()) if self.possible(w) else None
            if hit:
                found[w.decode()] = hit
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Feature vector of a whole text."""
        exact = edited = quoted = aimed = weight = n = 0.0
        for part in chunks(text or ""):
            plain = plain_words(part)
            n += len(plain)
            hits = self.lookup(set(plain))
            if not hits:
                continue
            part = part.lower()
            words = WORD.findall(part)
            marks = [m.start() for m in MARKS.finditer(part)]
            places = [m.start() for m in WORD.finditer(part)] if marks else []
            for k in [k for k, w in enumerate(words) if w in hits]:
                entry, spent = hits[words[k]]
                near = words[max(0, k - WINDOW) : k + WINDOW + 1]
                before = bisect.bisect_left(marks, places[k]) if marks else 0
                is_quoted = bool(before % 2 and before < len(marks)) or not REPORTING.isdisjoint(near)
                exact += not spent
                edited += bool(spent)
                quoted += is_quoted
                aimed += not ADDRESS.isdisjoint(near)
                weight += self.weights[entry] * (0.5 if spent else 1.0) * (0.5 if is_quoted else 1.0)
        return np.array([1.0, *np.log1p([exact, edited, quoted, aimed, weight]), min(1.0, 20 * (exact + edited) / max(n, 1.0))])


def terms(text: str) -> set[str]:
    """The distinct words of a text and their beginnings (``STEMS`` letters, marked ``*``)."""
    words = {w.decode() for part in chunks(text) for w in plain_words(part) if len(w) <= LONGEST and not w.isdigit()}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def learn_lexicon(sample: DataFrame, least_docs: int = 3, least_gain: float = 20.0, most: int = 4096) -> Lexicon:
    """Entries from ``sample(text, label)``: terms far more frequent in documents labelled 1, by a likelihood ratio.

    A term needs ``least_docs`` toxic documents, a ratio statistic of ``least_gain`` and a toxic share of at least 0.8; a
    stem that qualifies covers everything that begins with it.  ``most`` bounds the lexicon, strongest entries first.  Equal texts
    count once.
    """
    sample = sample.dropDuplicates(["text", "label"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
            held.clear()
            return got

        for b in rows(batches, 100):
            for text in b.column(0).to_pylist():
                held.update(terms(text or ""))
            if len(held) > 300_000:
                yield out()
        if held:
            yield out()

    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    p, n = size.get(1, 0), size.get(0, 0)
    if not p or not n:
        return Lexicon()
    pos = sample.filter("label = 1").select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("a")).filter(F.col("a") >= least_docs)
    neg = sample.filter("label = 0").select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("b"))
    both = pos.join(neg, "term", "left").select("term", "a", F.coalesce("b", F.lit(0)).alias("b"))
    share = (F.col("a") / p) / (F.col("a") / p + (F.col("b") + 0.5) / n)
    rate = (F.col("a") + F.col("b")) / F.lit(p + n)
    gain = 2 * (F.col("a") * F.log(F.col("a") / (rate * p)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (rate * n))).otherwise(0.0))
    # the share is that of the sample as it is drawn, and the words an honest document uses by chance stay below it
    kept = both.filter((share >= 0.8) & (F.col("a") >= 0.8 * (F.col("a") + F.col("b"))) & (gain >= least_gain))
    chosen = kept.select("term", "a", "b", gain.alias("gain")).orderBy(F.desc("gain"), "term").limit(most).collect()
    weights = {r["term"]: math.log((r["a"] + 0.5) / (p + 1) / ((r["b"] + 0.5) / (n + 1))) for r in chosen}
    seen = {r["term"]: r["a"] for r in chosen}
    most_of: dict[str, int] = {}
    for word, a in seen.items():
        if not word.endswith("*"):
            for k in STEMS:
                if k < len(word):
                    most_of[word[:k]] = max(a, most_of.get(word[:k], 0))
    # a stem that one word explains is dropped for the word, which may then be matched with edits
    stems = {t[:-1] for t, a in seen.items() if t.endswith("*") and most_of.get(t[:-1], 0) < 0.8 * a}

    def covered(t: str) -> bool:
        text = t.rstrip("*")
        return any(text[:k] in stems for k in STEMS if k < len(text)) or (t.endswith("*") and text not in stems)

    return Lexicon({t: w for t, w in weights.items() if not covered(t)}, frozenset(t for t in seen if not t.endswith("*")))


def misspelled(text: str, firm: frozenset[str]) -> str:
    """The text with each word that takes edits spelled with one: in turn a letter replaced, dropped or doubled in its middle."""
    turn = 0

    def change(m: re.Match) -> str:
        nonlocal turn
        w = m[0]
        if len(w) < 5 or w.lower() not in firm:
            return w
        turn += 1
        k = len(w) // 2
        return w[:k] + ("0", "", 2 * w[k])[turn % 3] + w[k + 1 :]

    return WORD.sub(change, text)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps (the first column is the constant, which is not shrunk)."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: list[float]
    firm: frozenset[str] | None = None


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000) -> Model:
    """Lexicon and logistic weights from at most ``sample`` labelled rows, a quarter of them toxic at most.

    Every third toxic text is learned from a second time with its insults misspelled.

    The rows are those of the lowest hash of the id, so the choice does not depend on order or size; their ids are what is
    broadcast.  Rows with a null id or label take no part.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("label")).filter("_id is not null and label in (0, 1)").dropDuplicates(["_id"])
    hashed = usable.orderBy(F.xxhash64("_id"), "_id")
    drawn, _ = materialize(hashed.filter("label = 1").limit(sample // 4).unionByName(hashed.filter("label = 0").limit(sample - sample // 4)), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "_id")
    held, _ = materialize(texts.select("text", "label"), "labelled")
    lexicon = learn_lexicon(held)
    weights, firm = lexicon.weights, lexicon.firm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(weights, firm)
        for b in rows(batches):
            f, y = [], []
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f.append(lex.features(t).tolist())
                if label and t and firm and zlib.crc32(utf8(t)) % 3 == 0:  # teaches what an edited hit is worth
                    f.append(lex.features(misspelled(t, firm)).tolist())
                y += [label] * (len(f) - len(y))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["f", "label"])

    got = held.mapInArrow(run, "f array<double>, label int").toPandas()  # at most 4/3 of ``sample`` rows
    y = got["label"].to_numpy(np.float64) if len(got) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.0, 1e-12), 1 - 1e-12)
        return Model({}, [math.log(share / (1 - share))] + [0.0] * (FEATURES - 1))
    return Model(weights, fit_logistic(np.stack(got["f"].to_list()), y).tolist(), firm)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, w = Lexicon(held.value.lexicon, held.value.firm), np.array(held.value.weights)
        for b in rows(batches):
            s = np.array([1 / (1 + math.exp(-max(-30.0, min(30.0, float(lex.features(t) @ w))))) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject (score below 0.5), with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, w = Lexicon(held.value.lexicon, held.value.firm), np.array(held.value.weights)
        for b in rows(batches):
            yield b.filter(pa.array([float(lex.features(t) @ w) < 0.0 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
