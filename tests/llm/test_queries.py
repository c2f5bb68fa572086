"""Every registered query of the subpackage over a small folder: columns, held-out rows, results against plain code."""

import random
import zlib

import numpy as np
import pytest

from hashloom.llm import langid
from hashloom.llm import queries as Q
from tests.llm.helpers import TEXTS

COLUMNS = {
    "op1_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op2_linked_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3_subword_lattice": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_url_automaton": ["page_id", "host", "path", "rule", "verdict"],
    "op5_pivot_top_k": ["query_id", "rank", "vec_id", "score"],
    "op6_language_bayes": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_sum_of_squares_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_latent_decontamination": ["doc_id", "item_id", "part", "cosine", "lcs", "answer", "word"],
    "op9_levenshtein_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_binary_records": ["doc_id", "start", "n_tokens", "ids_crc32"],
}
SPLITS = {"op3_subword_lattice": (10, 0), "op6_language_bayes": (3, 1), "op9_levenshtein_toxicity": (5, 0)}
LETTERS = {"aa": "aeioubdk", "bb": "lmnrstue", "cc": "pqvwxyzo"}


def corpus():
    rnd = random.Random(7)
    rows = []
    for k in range(150):
        lang = rnd.choice(list(LETTERS))
        rows.append((k, " ".join("".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(6, 40))) + (" moron clown" if k % 4 == 0 else ""), lang))
    return rows + [(i and i + 1000, t, None) for i, t in TEXTS]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = tmp_path_factory.mktemp("sf")
    docs = corpus()
    spark.createDataFrame([(i, t, lang, "s") for i, t, lang in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, docs[5][1])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, "http://www.example.com/en/x"), (2, None)], "page_id long, url string").write.parquet(f"{sf}/pages.parquet")
    rng = np.random.default_rng(1)
    spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(120)], "vec_id long, embedding array<double>").write.parquet(f"{sf}/embeddings.parquet")
    return str(sf)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_held_out_rows(spark, folder, name):
    got = Q.QUERIES[name](spark, folder)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = got.collect()
    assert rows
    if name in SPLITS:
        n, k = SPLITS[name]
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _, _ in corpus())
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % n == k) for r in rows)


def plain_language(rows, buckets=1 << 15):
    """Multinomial naive Bayes with a dictionary and loops."""
    count, prior = {}, {}
    for i, text, lang in rows:
        if text is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 3 != 1):
            prior[lang] = prior.get(lang, 0) + 1
            c = count.setdefault(lang, {})
            for g in langid.grams(text, buckets).tolist():
                c[g] = c.get(g, 0) + 1
    total = {x: sum(c.values()) + 0.5 * buckets for x, c in count.items()}

    def predict(text):
        if text is None or not any(x.isalpha() for x in text):
            return "und", 0.0
        s = {x: np.log(prior[x] / sum(prior.values())) + sum(np.log((count[x].get(g, 0) + 0.5) / total[x]) for g in langid.grams(text, buckets).tolist()) for x in sorted(count)}
        best = max(s, key=s.get)
        return best, 1 / sum(np.exp(v - s[best]) for v in s.values())

    return predict


def test_languages_against_plain_bayes(spark, folder):
    short = [r for r in corpus() if r[1] is None or len(r[1]) < 5000]
    predict = plain_language([r for r in corpus()])
    got = {}
    for r in Q.op6_language_bayes(spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    for i, text, _ in short:
        lang, p = predict(text)
        assert any(x == lang and s == pytest.approx(p, abs=1e-6) for x, s in got[i]), (i, lang, got[i])


def test_leaks_and_toxicity(spark, folder):
    assert {(r.doc_id, r.item_id) for r in Q.op8_latent_decontamination(spark, folder).collect()} >= {(5, 1)}
    rows = [r for r in Q.op9_levenshtein_toxicity(spark, folder).collect() if r.held_out and r.doc_id is not None and r.doc_id < 150]
    assert rows and all(r.predicted == int(r.doc_id % 4 == 0) and 0 <= r.score <= 1 for r in rows)
