import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.llm import lattice
from tests.llm.helpers import awkward, documents, empty

def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0



def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [x for x in re.split("[\x20\x09-\x0d]+", text) if x] + [None]


def every_segmentation(pieces, logs, word):
    u, vocab = lattice.START + word, dict(zip(pieces, logs, strict=False))

    def total(i):
        if i == len(u):
            return 1.0
        out = 0.0
        for j in range(i + 1, len(u) + 1):
            if u[i:j] in vocab:
                out += math.exp(vocab[u[i:j]]) * total(j)
            elif j == i + 1:
                out += math.exp(sum(logs[len(pieces) + b] for b in u[i:j].encode())) * total(j)
        return out

    return math.log(total(0))


WORDS = ("a", "ab", "abab", "abba", "babbab", "azb", "é", "abab", "b", "中a", "ababababab")


@pytest.mark.parametrize("segment", [1 << 12, 3, 1])
def test_forward_recursion_sums_all_segmentations(monkeypatch, segment):
    monkeypatch.setattr(lattice, "SEGMENT", segment)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ab"]
    logs = lattice.first_logs(pieces)
    got = lattice.Lattice(pieces, logs).log_probs([w.encode() for w in WORDS] + [lattice.END])
    assert got[:-1].tolist() == pytest.approx([every_segmentation(pieces, logs, w) for w in WORDS]) and got[-1] == logs[-1]


@pytest.mark.parametrize("segment", [1 << 12, 3, 1])
def test_expected_counts_add_up(monkeypatch, segment):
    monkeypatch.setattr(lattice, "SEGMENT", segment)
    pieces = ["▁", "a", "b", "ab", "▁a", "bab"]
    logs = lattice.first_logs(pieces)
    lat, into = lattice.Lattice(pieces, logs), np.zeros(len(pieces) + 257)
    likelihood = lat.expect([b"ab", lattice.END], np.array([2, 3]), into)
    # letters covered by the pieces used: the start mark, a and b, twice each
    assert sum(len(p) * into[k] for k, p in enumerate(pieces)) == pytest.approx(6.0) and into[-1] == 3.0
    assert likelihood == pytest.approx(2 * every_segmentation(pieces, logs, "ab") + 3 * logs[-1])
    # the derivative of the likelihood by a piece's score is its expected count
    words, n = [w.encode() for w in WORDS], np.arange(1, len(WORDS) + 1)
    into = np.zeros(len(logs))
    lat.expect(words, n, into)
    for k in (0, 1, 3, 5, len(pieces) + ord("z"), len(pieces) + 0xC3):
        up, down = logs.copy(), logs.copy()
        up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
        slope = (lattice.Lattice(pieces, up).log_probs(words) - lattice.Lattice(pieces, down).log_probs(words)) @ n / 2e-5
        assert into[k] == pytest.approx(slope, rel=1e-4)


def test_lookup_finds_pieces_and_nothing_else():
    pieces = lattice.load_pieces(lattice.vocabulary_path())
    lat = lattice.Lattice(pieces, lattice.first_logs(pieces))
    assert len(set(lat.hashes.tolist())) == len(pieces) and lat.lookup(lat.hashes).tolist() == list(range(len(pieces)))
    assert (lat.lookup(np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64)) == -1).all()


def test_each_step_raises_the_likelihood(spark):
    """On the training words and on others; the steps end when the rise is below the tolerance."""
    rng = np.random.default_rng(5)
    parts = ["ba", "ku", "lo", "men", "tra", "vi", "son"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 5)))
    rows = [(k, " ".join(word() for _ in range(50))) for k in range(40)]
    words = lattice.count_words(documents(spark, rows), F.col("doc_id") >= 0).cache()
    pieces = lattice.load_pieces(lattice.vocabulary_path())
    other = [word().encode() for _ in range(500)]
    history, held_out = [], []
    for steps in (1, 2, 3):
        logs = lattice.fit(words, tolerance=0.0, most_steps=steps)
        held_out.append(lattice.Lattice(pieces, logs).log_probs(other).mean())
    lattice.fit(words, tolerance=0.01, history=history)
    assert all(b > a for a, b in zip(history, history[1:], strict=False)) and 3 < len(history) < 30 and history[-1] - history[-2] < 0.01
    assert held_out[0] < held_out[1] < held_out[2]
    words.unpersist()


def test_words_are_counted_in_parts(spark, monkeypatch):
    text = "Some words of a text, " * 500 + "x" * 5000 + " end"
    monkeypatch.setattr(lattice, "CHUNK", 64)
    assert [w for part in lattice.word_lists(text) for w in part] == text.lower().encode().split()
    assert lattice.key_of(b"x" * 64) == b"x" * 64 and len(lattice.key_of(b"x" * 65)) == 17


def test_frequent_long_words(spark):
    """A long word in every text is scored like any other."""
    url = "https://example.org/" + "a" * 3000
    rows = [(k, f"{url} text {k}") for k in range(30)]
    got = {r.doc_id: (r.n_known, r.score) for r in lattice.score(documents(spark, rows), held(), head=3).collect()}
    want = {r.doc_id: (r.n_known, r.score) for r in lattice.score(documents(spark, rows), held(), head=0).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in got)


def plain_base(rows):
    c = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return n, c, lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))


@pytest.mark.parametrize("head", [1 << 17, 5, 0])
def test_scores_against_plain_python(spark, head):
    from tests.llm.helpers import TEXTS

    rows = [*TEXTS, *[(k, f"some words {k} The the {'rare' * (k % 3)}") for k in range(20, 60)]]
    n, c, base = plain_base(rows)
    got = lattice.score(documents(spark, rows), held(), head=head).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 6))
    want = [(i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), base(t)) for i, t in rows]
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score)) for r in got)
    assert {r.train_tokens for r in got} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_head_does_not_change_scores(spark):
    docs = awkward(spark)
    a, b = (sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lattice.score(docs, held(), head=h).collect()) for h in (1 << 17, 3))
    assert a == b


def test_model_is_better_on_known_text(spark):
    rows = [(k, "the cat sat on the mat and the dog sat on the log") for k in range(40)] + [(1000, "zq xv wjk qpz vvx")]
    got = {r.doc_id: r.score / r.n_tokens for r in lattice.score(documents(spark, rows), held()).collect()}
    assert got[1] > got[1000]


def test_empty(spark):
    assert lattice.score(empty(spark), held()).count() == 0
