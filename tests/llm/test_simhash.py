import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hashloom.llm import simhash
from tests.llm.helpers import TEXTS, awkward, documents, empty


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, fps):
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                par[find(a)] = find(b)
    low = {}
    for k in range(len(fps)):
        if ids[k] is not None:
            low[find(k)] = min(ids[k], low.get(find(k), ids[k]))
    return [low.get(find(k)) for k in range(len(fps))]


def test_awkward_rows(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    fps = [plain_fingerprint(t) for _, t in TEXTS]
    want = sorted(zip((str(i) for i, _ in TEXTS), fps, map(str, components([i for i, _ in TEXTS], fps)), strict=True))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_known_values(spark):
    hexes = {r[0] for r in spark.createDataFrame([(0,), (-1,)], "fp long").select(simhash.hex16(F.col("fp"))).collect()}
    assert hexes == {"0" * 16, "f" * 16}
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("hot", [64, 1, 4])
def test_links_against_all_pairs(spark, hot):
    """Random fingerprints with planted neighbours, and a crowd that shares one segment, at every setting of ``hot``."""
    rnd = random.Random(11)
    base = [rnd.getrandbits(64) for _ in range(40)]
    crowd = rnd.getrandbits(64)
    fps = set(base)
    for b in base:
        for d in (1, 2, 3, 4, 5):
            fps.add(b ^ sum(1 << k for k in rnd.sample(range(64), d)))
    for _ in range(60):
        fps.add(crowd ^ sum(1 << k for k in rnd.sample(range(32), rnd.randint(0, 6))))
        fps.add(crowd ^ (1 << rnd.randint(32, 63)) ^ sum(1 << k for k in rnd.sample(range(32), rnd.randint(0, 3))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from hashloom.plans.graph import connected_components

    got = {r.node % (1 << 64): r.component for r in connected_components(simhash.links(df, hot=hot)).collect()}
    want = components(list(range(len(fps))), fps)
    same = {}
    for f, c in zip(fps, want, strict=True):
        same.setdefault(c, set()).add(got.get(f, f"alone {f}"))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_keep_one(spark):
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "3", "6", "7", "None", "8", "9"])
    near = " ".join(f"word{k}" for k in range(3000))
    docs = documents(spark, [(10, near), (11, near + " extra"), (12, "another text entirely with its own words")])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [10, 12]
    assert simhash.keep_one(empty(spark)).count() == 0


def edited(rnd, words, share):
    return [rnd.choice(["zu", "ke", "ola"]) + str(rnd.randrange(99)) if rnd.random() < share else w for w in words]


def plain_groups(texts, similarity=0.8):
    """Kept rows by brute force: all pairs of five-word shingle sets, in chains."""
    sets = [set(simhash.shingles(t.lower().encode().split(), 5).tolist()) for t in texts]
    par = list(range(len(texts)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                par[y] = x
    return par, find


@pytest.mark.parametrize("hot", [64, 12])
def test_near_copies_go(spark, hot):
    """Copies with a few edited words against brute force; nothing goes that is similar to nothing."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3)))
    texts = []
    for k in range(40):
        base = [word() for _ in range(rnd.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 1, 3]) if k else 25):
            texts.append(" ".join(edited(rnd, base, rnd.choice([0.005, 0.01, 0.02]))))
    order = list(range(len(texts)))
    rnd.shuffle(order)
    _, find = plain_groups([texts[k] for k in order])
    want = {k for k in range(len(order)) if find(k) == k}
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, [(k, texts[o]) for k, o in enumerate(order)]), hot=hot).collect()}
    assert want <= kept and len(kept - want) <= 0.08 * (len(order) - len(want))


def test_other_columns_and_repeated_rows(spark):
    """Columns named like the operator's own stay as they are; of rows that share id and text one stays."""
    rows = [(1, "one two three four five six", 5, 6, 7, "x"), (1, "one two three four five six", 4, 6, 7, "y"), (2, "one  two three four five SIX", 1, 1, 1, "z"), (3, "other words", 77, 1, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, node long, row_id long, `_salt` string")
    got = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and all(tuple(r) in rows for r in got)
    assert {tuple(r) for r in simhash.keep_one(docs.repartition(3)).collect()} == {tuple(r) for r in got}


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    bits = lambda a: np.unpackbits(a.view(np.uint8), bitorder="little")
    for n in (0, 1, 30, 400, 5000):
        a = rng.integers(-(2**63), 2**63, n)
        b = np.concatenate([a[n // 5 :], rng.integers(-(2**63), 2**63, n // 3)])
        differ = int((bits(simhash.parities(a)) != bits(simhash.parities(b))).sum())
        assert differ <= len(set(a.tolist()) ^ set(b.tolist())) and (differ > 0) == (n > 2)


def test_pairs_that_cannot_be_similar_are_no_rows(spark, monkeypatch):
    """Texts of one family, most of them less similar than 0.8: only pairs that may reach it leave the meeting, and none that does is lost."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(edited(rnd, base, 0.035)) for _ in range(60)]
    met = []
    verified = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: (met.append(pairs.distinct().count()), verified(pairs, *rest))[1])
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, list(enumerate(texts)))).collect()}
    par, find = plain_groups(texts)
    assert {k for k in range(60) if find(k) == k} <= kept and len(met) == 2 and met[1] < 200, met
