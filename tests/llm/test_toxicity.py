import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hashloom.llm import toxicity as T
from tests.llm.helpers import awkward, empty


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


WORDS = ["abc", "abcde", "abdce", "bcdea", "abcdeabcde", "cab", "edcba"]


@settings(deadline=None, max_examples=400)
@given(st.text("abcde", max_size=13))
def test_automaton_against_edit_distance(word):
    """Matches are what the distance allows, with the first letter in place; fewest edits first, then by name."""
    got = T.Lexicon(dict.fromkeys(WORDS, 1.0)).find(word)
    fits = []
    for w in WORDS:
        budget = 0 if len(w) < 5 else 1 if len(w) < 10 else 2
        d = distance(w[1:], word[1:]) if word[:1] == w[0] else 99
        if d <= budget:
            fits.append((d, w))
    assert got == ((min(fits)[1], min(fits)[0]) if fits else None)


def test_stems_take_no_edits():
    lex = T.Lexicon({"foul*": 1.0, "clown": 1.0})
    assert lex.find("foulness") == ("foul*", 0) and lex.find("fool") is None and lex.find("foul") == ("foul*", 0)
    assert lex.find("cl0wn") == ("clown", 1) and lex.find("klown") is None and lex.find("") is None


def test_context():
    lex = T.Lexicon({"idiot": 2.0})
    plain, quoted, said, aimed = (lex.features(t) for t in ("what an idiot here", 'he wrote it "idiot" there, far away from', "she said idiot", "you idiot"))
    assert plain[1] > 0 and plain[3] == 0 and plain[4] == 0
    assert quoted[3] > 0 and said[3] > 0 and said[5] < plain[5] and aimed[4] > 0
    assert lex.features("idi0t idiott")[2] > 0 and lex.features(None)[1:].sum() == lex.features("")[1:].sum() == 0


def test_misspelled():
    got = T.misspelled("A Moron, a moron and a MORON; foul clown", frozenset({"moron", "foul", "clown"}))
    assert got == "A Moon, a morron and a MO0ON; foul clwn"


def labelled(spark, seed=3, n=700):
    rnd = random.Random(seed)
    bad = ["worthless", "moron", "clown", "stupid"]
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < 0.2
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            words[rnd.randrange(len(words))] = rnd.choice(bad) if rnd.random() < 0.7 else "xyl" + rnd.choice(["osa", "eti", "amu", "ori"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = T.train(docs, labels.filter("doc_id % 5 <> 0"))
    assert {"moron", "clown", "stupid", "worthless"} <= set(model.lexicon) and any(t.startswith("xyl") for t in model.lexicon)
    rows = T.score(docs, model).join(labels, "doc_id").filter("doc_id % 5 = 0").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    odd = spark.createDataFrame([(1, "badora m0ron felita, stupld clovn"), (2, "badora felita")], "doc_id long, text string")
    assert [r.predicted for r in T.score(odd, model).orderBy("doc_id").collect()] == [1, 0]


def test_sample_is_bounded_and_stable(spark):
    docs, labels = labelled(spark)
    a, b = (T.train(docs.repartition(k), labels.repartition(k), sample=200) for k in (1, 5))
    assert a.lexicon == b.lexicon and a.weights == pytest.approx(b.weights)


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = T.Model({"fox": 3.0, "wor*": 2.0}, [-3.0, 4.0, 1.0, 0.0, 0.0, 1.0, 1.0])
    got = T.score(docs, model).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if r.predicted} == {1, 2, 9}
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "5", "6", "7", "8", "None", "None"])
    assert T.score(empty(spark), model).count() == 0 and T.keep_clean(empty(spark), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)], [(1, None), (None, 1)]])
def test_nothing_to_learn(spark, labels):
    docs = awkward(spark)
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r.score for r in T.score(docs, model).collect()}
    assert len(scores) == 1 and (scores.pop() > 0.5) == (labels == [(1, 1), (2, 1)])


def test_very_long_words_and_chunks(monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 50)
    text = "clean words " * 30 + "x" * 200 + " moron " + "end " * 20
    assert "".join(T.chunks(text)) == text
    assert T.Lexicon({"moron": 1.0}).features(text)[1] > 0
    assert F is not None


@settings(deadline=None, max_examples=400)
@given(st.sampled_from(WORDS + ["abcdeabcdeab", "ab*"]), st.lists(st.tuples(st.integers(0, 14), st.sampled_from(["", "a", "é", "e"]), st.booleans()), max_size=3))
def test_no_match_is_told_impossible(word, edits):
    lex = T.Lexicon(dict.fromkeys([*WORDS, "abcdeabcdeab", "éabcdé", "ab*"], 1.0))
    for at, c, instead in edits:
        word = word[:at] + c + word[at + instead :]
    hit = lex.find(word)
    assert lex.lookup([word.encode()]) == ({word: hit} if hit else {})


def test_rare_insults_take_edits(spark):
    """An insult in few of very many toxic documents is found misspelled too."""
    rows = [(f"moron clown text{k} more{k % 7}", 1) for k in range(1500)] + [(f"grumblehead text{k}", 1) for k in range(12)] + [(f"text{k} plain{k % 7} words", 0) for k in range(4500)]
    lex = T.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert lex.find("grumblehead") == ("grumblehead", 0)
    assert lex.find("grumb1ehead") == ("grumblehead", 1) and lex.find("moro0n") == ("moron", 1)
