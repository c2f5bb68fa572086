import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.llm import pivots


def brute(rows, every=5, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i in sorted({i for i, _ in ok if i % every == 0}):
        q = next(v for j, v in ok if j == i)
        got = sorted(((sum(a * b for a, b in zip(q, v, strict=True)), -j) for j, v in ok if j != i and len(v) == len(q)), reverse=True)[:k]
        out |= {(i, r + 1, -j, s) for r, (s, j) in enumerate(got)}
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string").repartition(3)
    return {tuple(r) for r in pivots.top_k(df, F.col("vec_id") % 5 == 0, **options).collect()}


def f32(x):
    return float(np.float32(x))


def vectors(seed, n, dim, spread=1.0):
    rnd = random.Random(seed)
    return [(k, [f32(rnd.gauss(0, spread)) for _ in range(dim)]) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"block": 16, "query_block": 4, "pivots": 3, "lane_blocks": 1}, {"pivots": 0}, {"block": 7, "pivots": 50}])
def test_against_brute_force(spark, options):
    rows = vectors(1, 150, 12)
    assert search(spark, rows, **options) == brute(rows)


def test_ties_copies_and_bad_vectors(spark):
    rows = [(k, [0.5, -0.25]) for k in range(20)] + [(100, None), (105, [None, 1.0]), (110, [math.nan, 1.0]), (115, [math.inf, 1.0]), (None, [1.0, 1.0]), (120, []), (121, []), (125, [1.0, 2.0, 3.0]), (126, [1.0, 2.0, 4.0])]
    assert search(spark, rows, block=4, query_block=2) == brute(rows)


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert search(spark, rows) == brute(rows) == {(0, 1, 1, 131072)}
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivots.top_k(df, F.col("vec_id") % 5 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(k, [f32(3e9 + k * 1e6), f32(-2e9), f32(1e5 * k)]) for k in range(12)]
    want = {(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in brute(rows)}
    got = search(spark, rows)
    assert {(q, s) for q, _, _, s in got} == {(q, s) for q, _, _, s in want}


def test_elimination_skips_far_rows():
    """Well separated groups: the pivot bounds leave most rows unevaluated, and the result is still exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (20, 8))
    x = np.floor((centres[:, None] + rng.normal(0, 1, (20, 100, 8))).reshape(-1, 8) * 256)
    chosen, table, radius2 = pivots.pivot_table(x, 32)
    block = pivots.Block(np.arange(len(x)), x, chosen, table, radius2)
    seen = 0
    plain = pivots.scores

    def counting(block, q, at):
        nonlocal seen
        seen += len(at)
        return plain(block, q, at)

    pivots.scores = counting
    try:
        q = x[np.argmax((x * x).sum(axis=1))]
        dq = pivots.distances(np.append(q, 0.0)[None], chosen)[0]
        best = pivots.search_block(block, -1, q, dq, [], 5)
    finally:
        pivots.scores = plain
    exact = sorted(((int(s), -k) for k, s in enumerate(x @ q)), reverse=True)[:5]
    assert best == exact and seen < len(x)


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_query_id_with_other_vectors(spark, parts):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 5.0]), (3, [1.0, 0.0]), (4, [0.0, -9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    got = sorted(tuple(r) for r in pivots.top_k(df, F.col("vec_id") == 0, k=3).collect())
    assert got == [(0, 1, 2, 5 << 16), (0, 2, 1, 3 << 16), (0, 3, 3, 1 << 16)]
