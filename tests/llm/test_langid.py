import random

import pytest
from pyspark.sql import functions as F

from hashloom.llm import langid
from tests.llm.helpers import awkward, empty

SYLLABLES = {"aa": ["lo", "mi", "ra", "ten"], "bb": ["kru", "zsch", "opf", "gra"], "cc": ["é", "oué", "çai", "leau"]}


def corpus(seed, n):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rnd.choice(list(SYLLABLES))
        rows.append((k, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 30))), lang))
    return rows


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(corpus(1, 600), "doc_id long, text string, lang string")
    langs, logs = langid.train(df.filter("doc_id % 3 <> 1"))
    assert langs == ["aa", "bb", "cc"] and logs.shape == ((1 << 15) + 1, 3)
    got = langid.predict(df, langs, logs).join(df, "doc_id").filter("doc_id % 3 = 1")
    rows = got.collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_do_not_change_counts(monkeypatch):
    import numpy as np

    text = "".join(random.Random(3).choice("abc dé") for _ in range(1000))
    count = lambda: sum(np.bincount(langid.grams(s, 512, not k), minlength=512) for k, s in enumerate(langid._spans(text)))
    whole = count()
    for span in (2, 3, 7, 100, 999):
        monkeypatch.setattr(langid, "SPAN", span)
        assert np.array_equal(count(), whole), span
    assert whole.sum() == 1000 + 999 + 998


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("lang", F.when(F.col("doc_id") == 9, None).otherwise(F.lit("en")))
    model = langid.train(docs)
    got = langid.predict(docs, *model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(by[i] == ("und", 0.0) for i in (3, 4, 5, 6)) and by[1] == ("en", 1.0) and by[9][0] == "en"
    assert langid.predict(empty(spark), *model).count() == 0


@pytest.mark.parametrize("none", ["text", "lang"])
def test_nothing_to_learn(spark, none):
    docs = awkward(spark)
    model = langid.train(docs.withColumn(none, F.lit(None).cast("string")))
    assert model[0] == []
    assert {r.lang_pred for r in langid.predict(docs, *model).collect()} == {"und"}
