import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hashloom.llm import decontam as D
from tests.llm.helpers import awkward, documents, empty


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=80), st.lists(st.integers(1, 6), max_size=90))
def test_bit_parallel_lcs(a, b):
    masks = {}
    for k, t in enumerate(a):
        masks[t] = masks.get(t, 0) | 1 << k
    assert D.lcs_length(masks, len(a), b) == plain_lcs(a, b)


@settings(deadline=None)
@given(st.lists(st.integers(), max_size=300), st.integers(1, 64))
def test_split(words, longest):
    parts = D.split_passages(words, longest)
    assert [w for p in parts for w in p] == words and all(len(p) <= longest for p in parts)


def corpus(seed=1, n=200):
    rnd = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    text = lambda k: [word() for _ in range(k)]
    return rnd, text, [(k, text(rnd.randint(5, 400))) for k in range(n)]


@pytest.mark.parametrize("part_words", [1_000_000, 120])
def test_planted_leaks(spark, part_words):
    rnd, text, docs = corpus()
    items = [(k, text(rnd.randint(12, 150))) for k in range(20)]
    want = set()
    for k, (i, passage) in enumerate(items):
        p = list(passage)
        for _ in range(len(p) // 12):  # a light paraphrase
            p[rnd.randrange(len(p))] = "changed"
        for doc, words in ((2 * k, passage), (2 * k + 1, p)):
            at = rnd.randrange(len(docs[doc][1]) + 1)
            docs[doc][1][at:at] = [w.upper() + "," for w in words]
            want.add((doc, i))
    df = documents(spark, [(i, " ".join(w)) for i, w in docs])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, bench, part_words=part_words).collect()}
    assert got == want


def test_answer_column(spark):
    bench = spark.createDataFrame([(1, "which metal melts at the lowest heat of all metals known", "mercury")], "item_id long, text string, answer string")
    kept = "which metal melts of all metals known"
    docs = documents(spark, [(1, f"ask {kept} it is mercury"), (2, f"ask {kept} nobody knows"), (3, "mercury is a planet")])
    got = {(r.doc_id, r.answer) for r in D.find_leaks(docs, bench, answer_col="answer").collect()}
    assert got == {(1, True)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    bench = docs.selectExpr("doc_id as item_id", "text", "lang as words", "1 as key")
    got = D.find_leaks(docs, bench, item_col="item_id").collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert {(1, 1), (2, 1), (1, 2), (7, 7)} <= found and not found & {(3, 1), (4, 1), (6, 6), (9, 9)}
    assert D.find_leaks(empty(spark), bench).count() == 0
    assert D.find_leaks(docs, bench.limit(0)).count() == 0


def test_latent_space_keeps_passages_apart(spark):
    rnd, text, _ = corpus(5)
    items = [text(30) for _ in range(40)]
    vocab = {w: k for k, w in enumerate(sorted({w for x in items for w in x}), 1)}
    idf = np.ones(len(vocab) + 1)
    idf[0] = 0
    numbers = spark.createDataFrame([(k, [vocab[w] for w in x]) for k, x in enumerate(items)], "key long, ids array<long>")
    basis = D.latent_basis(numbers, idf, 40)
    assert np.allclose(basis.T @ basis, np.eye(40), atol=1e-4)
    index = D.Index([(k, 0, [vocab[w] for w in x], []) for k, x in enumerate(items)], idf, basis)
    for k, x in enumerate(items):
        assert index.candidates(np.array([vocab[w] for w in x], np.uint16), 0.5)[0][2] == k


def test_short_passages_of_a_large_benchmark(spark):
    """Far more passages than latent dimensions, each a small part of a window: unchanged ones are all found, also near long documents' ends."""
    rnd, text, _ = corpus(9)
    words = text(4000)
    pick = lambda k: [words[int(len(words) * rnd.random() ** 2)] for _ in range(k)]
    items = [pick(rnd.randint(8, 29)) for _ in range(2000)]
    docs = [pick(rnd.choice([0, 3, 200, 700])) for _ in range(400)]
    want = {(k, 5 * k) for k in range(400)}
    for k, words_of in enumerate(docs):
        at = rnd.choice([0, len(words_of), rnd.randrange(len(words_of) + 1)])
        words_of[at:at] = items[5 * k]
    df = documents(spark, [(k, " ".join(w)) for k, w in enumerate(docs)])
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, bench).collect() if r.lcs >= 0.8}
    assert want <= got and all(plain_lcs(items[i], docs[d]) >= 0.8 * len(items[i]) for d, i in got)


def test_parts_and_hashed_numbers_do_not_change_results(spark):
    """Cosines are those of the whole benchmark however it is searched; words numbered by a hash lose nothing."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3)))
    items = [[word() for _ in range(rnd.randint(8, 60))] for _ in range(30)]
    docs = [" ".join([word() for _ in range(40)] + (items[k % 30] if k % 2 else []) + [word() for _ in range(40)]) for k in range(80)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    key = lambda r: (r.doc_id, r.item_id, r.part)
    whole = {key(r): (round(r.cosine, 4), r.lcs) for r in D.find_leaks(df, bench).collect()}
    parts = {key(r): (round(r.cosine, 4), r.lcs) for r in D.find_leaks(df, bench, part_words=150).collect()}
    hashed = {key(r) for r in D.find_leaks(df, bench, most_words=600).collect()}
    assert whole == parts and {k[:2] for k in whole} >= {(k, k % 30) for k in range(80) if k % 2} and set(whole) <= hashed


def test_scripts_without_spaces(spark):
    """A Chinese and a Thai passage without a space are found inside other text."""
    bench = spark.createDataFrame([(1, "春眠不觉晓处处闻啼鸟夜来风雨声"), (2, "กขคงจฉชซฌญฎฏฐ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "前言在此" * 9 + "春眠不觉晓,处处闻啼鸟。夜来风雨声" + "后记" * 20), (2, "abc กขคงจฉชซฌญฎฏฐ def"), (3, "前言在此后记" * 9)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()} == {(1, 1), (2, 2)}


def test_leaks_against_brute_force(spark):
    """Documents and benchmark of edited and unchanged passages: what is found is what a plain common subsequence finds in any stretch."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(2))
    items = [[word() for _ in range(rnd.randint(10, 40))] for _ in range(12)]
    docs = []
    for k in range(60):
        inside = [w if rnd.random() > rnd.choice([0, 0.1, 0.5]) else word() for w in items[k % 12]] if k % 3 else []
        docs.append([word() for _ in range(50)] + inside + [word() for _ in range(50)])
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, bench, paraphrase_lcs=0.8).collect()}
    sure, possible = set(), set()
    for d, x in enumerate(docs):
        for i, item in enumerate(items):
            n = len(item)
            if any(plain_lcs(item, x[at : at + n]) >= 0.8 * n for at in range(0, len(x) - n + 1)):
                sure.add((d, i))
            if plain_lcs(item, x) >= 0.8 * n:
                possible.add((d, i))
    assert sure and sure <= got <= possible
