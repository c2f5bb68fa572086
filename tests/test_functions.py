import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hashloom.functions import hashing, kmers, metrics, params

MASK = (1 << 64) - 1


def murmur_reference(key: bytes, seed: int = 42) -> int:
    """Plain-integer MurmurHash3 x64 128, first half."""
    rotl = lambda x, r: ((x << r) | (x >> (64 - r))) & MASK
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed
    whole = len(key) // 16 * 16
    for at in range(0, whole, 16):
        k1, k2 = (int.from_bytes(key[at + o : at + o + 8], "little") for o in (0, 8))
        h1 ^= rotl(k1 * c1 & MASK, 31) * c2 & MASK
        h1 = (rotl(h1, 27) + h2) * 5 + 0x52DCE729 & MASK
        h2 ^= rotl(k2 * c2 & MASK, 33) * c1 & MASK
        h2 = (rotl(h2, 31) + h1) * 5 + 0x38495AB5 & MASK
    tail = key[whole:]
    h2 ^= rotl(int.from_bytes(tail[8:], "little") * c2 & MASK, 33) * c1 & MASK
    h1 ^= rotl(int.from_bytes(tail[:8], "little") * c1 & MASK, 31) * c2 & MASK
    h1 ^= len(key)
    h2 ^= len(key)
    h1 = h1 + h2 & MASK
    h2 = h2 + h1 & MASK

    def mix(k):
        k = (k ^ k >> 33) * 0xFF51AFD7ED558CCD & MASK
        k = (k ^ k >> 33) * 0xC4CEB9FE1A85EC53 & MASK
        return k ^ k >> 33

    return mix(h1) + mix(h2) & MASK


@settings(deadline=None, max_examples=80)
@given(st.integers(0, 50), st.integers(0, 2**32))
def test_murmur_matches_plain_integers(length, seed):
    keys = np.random.default_rng(seed).integers(0, 256, (5, length), dtype=np.uint8)
    assert [int(h) for h in hashing.murmur64(keys)] == [murmur_reference(k.tobytes()) for k in keys]


def test_max_hash():
    assert hashing.max_hash(1) == MASK
    assert hashing.max_hash(1000) == int(float(MASK) / 1000)
    assert hashing.max_hash(10, 60) == (1 << 60) // 10


def test_at_most_is_unsigned(spark):
    values = [0, 1, (1 << 62), (1 << 63) - 1, -(1 << 63), -1]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    for scaled in (1, 2, 3, 7):
        got = {r[0] for r in df.filter(hashing.at_most(F.col("h"), scaled)).collect()}
        assert got == {v for v in values if v % (1 << 64) <= hashing.max_hash(scaled)}
    assert [int(r[0]) for r in df.select(hashing.unsigned(F.col("h"))).collect()] == [v % (1 << 64) for v in values]


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@settings(deadline=None, max_examples=60)
@given(st.text("ACGTNacgt", max_size=60), st.integers(1, 12), st.sampled_from(["DNA", "skipm1n3", "skipm2n3"]))
def test_nucleotide_kmers(seq, k, moltype):
    up, want = seq.upper(), []
    frames = [up] if moltype == "DNA" else ["".join(c for i, c in enumerate(up[f:]) if i % 3 < (1 if moltype == "skipm1n3" else 2)) for f in range(3)]
    for s in frames:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                want.append(min(w, revcomp(w)))
    got = [bytes(r).decode() for m in kmers.kmer_matrices(seq.encode(), moltype, k) for r in m]
    assert got == want


def test_protein_recoding():
    got = {m: [bytes(r).decode() for x in kmers.kmer_matrices(b"ACDEFGHIKL", m, 10) for r in x] for m in ("protein", "dayhoff", "hp")}
    assert got == {"protein": ["ACDEFGHIKL"], "dayhoff": ["baccfbdede"], "hp": ["hppphhphph"]}


def test_hashes_respect_scaled():
    seq = ("ACGT" * 50 + "GATTACA" * 20).encode()
    every = {int(v) % (1 << 64) for h, _ in kmers.hashes(seq, "DNA", 11) for v in h}
    some = {int(v) % (1 << 64) for h, _ in kmers.hashes(seq, "DNA", 11, scaled=3) for v in h}
    assert some == {h for h in every if h <= hashing.max_hash(3)}
    assert not list(kmers.hashes(b"", "DNA", 3))


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (2, 4, 0.5), (4, 4, 1.0)], "a long, b long, c double")
    got = df.select(metrics.ratio(F.col("a"), F.col("b")), metrics.ani(F.col("c"), F.lit(31)), metrics.jaccard(F.col("a"), F.col("b"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0.0, 0.5, 1.0]
    assert [r[1] for r in got] == [0.0, pytest.approx(0.5 ** (1 / 31)), 1.0]
    assert [r[2] for r in got] == [0.0, pytest.approx(2 / 6), 1.0]
    one = spark.range(1).select(metrics.angular(F.lit(25), F.lit(25), F.lit(25)), metrics.smooth_idf(F.lit(9), F.lit(4))).first()
    assert one[0] == 1.0 and one[1] == pytest.approx(math.log(2) + 1)


def test_params():
    assert params.parse("dna") == [params.SketchParams("DNA", 31, 1000)]
    got = params.parse("k=21,k=31,scaled=10,abund,dna_protein,k=7")
    assert [(p.moltype, p.ksize, p.scaled, p.abund, p.ksize_nt) for p in got] == [("DNA", 21, 10, True, 21), ("DNA", 31, 10, True, 31), ("protein", 7, 200, False, 21)]
    assert len(params.parse("dna,k=21_dna,k=21,seed=7")) == 1
    for bad in ("", "k=21", "dna,foo", "dna,k=x", "dna,scaled=1,num=5", "dna,abund,noabund", "dna,protein", "dna,scaled=1,scaled=2"):
        with pytest.raises(params.ParamError):
            params.parse(bad)
    assert params.parse("dna,scaled=1,num=0")[0].scaled == 1


def test_idents(spark):
    assert spark.createDataFrame([("a b c",), ("x",)], "n string").select(metrics.ident(F.col("n")).alias("i")).toPandas()["i"].tolist() == ["a", "x"]
    assert len(list(itertools.chain(params.DEFAULTS))) == 6


def test_md5_of_stretches():
    """First 64 bits as hashlib gives them, for every length up to two blocks."""
    import hashlib

    text = np.random.default_rng(3).integers(0, 256, 400).astype(np.uint8)
    starts, lengths = np.array([k % 270 for k in range(260)]), np.array([k % 130 for k in range(260)])
    want = [int(hashlib.md5(text[a : a + n].tobytes()).hexdigest()[:16], 16) for a, n in zip(starts, lengths, strict=True)]
    assert hashing.md5_64(text, starts, lengths, 100).tolist() == want


def test_rounded_is_round(spark):
    rng = np.random.default_rng(4)
    values = [None, math.nan, math.inf, -math.inf, -0.0, 0.0, -0.1234567895, 1e300, 12345.6789012345678, 3.0, 9.9999999999, 1 / 3, 2 / 3]
    values += [a / b for b in (1024, 2048, 5120, 10240, 51200, 999) for a in range(1, 200)] + [k / 1e10 for k in range(5, 4000, 10)] + rng.random(2000).tolist() + (rng.random(200) * 1e6).tolist()
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (6, 9):
        assert not df.select(F.round("x", digits).alias("a"), metrics.rounded(F.col("x"), digits).alias("b")).filter("not (a <=> b)").collect()
