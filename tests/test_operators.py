import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hashloom.model import from_rows
from hashloom.operators import blocks as B
from hashloom.operators import gather as G
from hashloom.operators import index as X
from hashloom.operators import overlap as J
from hashloom.operators import significance as S
from hashloom.operators.cluster import cluster, members, sizes
from hashloom.plans.graph import connected_components


def make(spark, sets, abund=True, **options):
    rows = [(i, h) for i, hs in sets.items() for h in hs]
    keep = spark.createDataFrame([(i,) for i in sets], "id string")
    return from_rows(spark.createDataFrame(rows, "id string, hash long"), "id", "hash", abund=abund, keep=keep, **options)


@pytest.fixture(scope="module")
def sets():
    rnd = random.Random(5)
    return {f"s{k}": [rnd.randint(0, 60) for _ in range(rnd.choice([0, 5, 30, 80]))] for k in range(9)} | {"none": []}


def test_multisearch_against_plain_python(spark, sets):
    sk = make(spark, sets)
    for output_all in (False, True):
        got = {(r.query_name, r.match_name): r for r in J.multisearch(sk, sk, 0.3, ani=True, abund=True, output_all=output_all).collect()}
        want = {}
        for a, x in sets.items():
            for b, y in sets.items():
                q, m = Counter(x), Counter(y)
                ov = len(q.keys() & m.keys())
                c = ov / len(q) if q else 0.0
                if output_all or c > 0.3:
                    want[a, b] = (ov, c)
        assert {k: (r.intersect_hashes, pytest.approx(r.containment)) for k, r in got.items()} == want
        for (a, b), r in got.items():
            if a == b and sets[a]:
                assert r.cosine == pytest.approx(1.0, abs=1e-6) and r.jaccard == 1.0 and r.average_containment_ani == 1.0


def test_pairwise(spark, sets):
    sk = make(spark, sets)
    some = J.pairwise(sk, 0.2)
    assert all(r.query_name < r.match_name and max(r.containment, r.max_containment) > 0.2 for r in some.collect())
    n = len(sets)
    assert J.pairwise(sk, output_all=True).count() == n * (n + 1) // 2
    assert J.pairwise(sk, 2.0, write_all=True).count() == n
    assert J.pairwise(sk, 2.0).columns == some.columns
    with pytest.raises(ValueError):
        J.pairwise(make(spark, {"one": [1]}))


def test_manysearch_abundance(spark):
    q, m = make(spark, {"q": [1, 2, 3, 4]}), make(spark, {"m": [1, 1, 1, 2, 9, 9], "n": [7]})
    r = J.manysearch(q, m, 0.0).first()
    assert (r.intersect_hashes, r.n_weighted_found, r.total_weighted_hashes, r.average_abund, r.median_abund, r.std_abund) == (2, 4, 6, 2.0, 2.0, 1.0)
    assert r.containment == 0.5 and r.containment_target_in_query == pytest.approx(2 / 3) and r.f_weighted_target_in_query == pytest.approx(4 / 6)
    assert J.manysearch(q, m, 0.0, ignore_abundance=True).first().average_abund is None
    assert J.manysearch(q, m, output_all=True).count() == 2
    flat = make(spark, {"f": [1, 1, 2]}, abund=False)
    assert J.manysearch(q, flat, 0.0).first().n_weighted_found is None


def test_strict_threshold(spark):
    sk = make(spark, {"a": [1, 2], "b": [1, 3]})
    assert J.multisearch(sk, sk, 0.5).count() == 2  # only each with itself
    assert J.multisearch(sk, sk, 0.499).count() == 4


def test_protein_ani_uses_two_ks(spark):
    a = make(spark, {"a": [1, 2]}, moltype="protein", ksize=19)
    b = make(spark, {"b": [1, 3]}, moltype="protein", ksize=19)
    assert J.multisearch(a, b, ani=True).first().query_containment_ani == pytest.approx(0.5 ** (1 / 19))
    assert J.manysearch(a, b).first().query_containment_ani == pytest.approx(0.5 ** (1 / 57))
    assert J.multisearch(a, b).first().ksize == 57


def test_significance(spark):
    q = make(spark, {"q": [1, 1, 2]}, abund=True)
    freq = {r.hash: r.freq for r in S.hash_frequencies(S.merged(q)).collect()}
    assert freq == {1: pytest.approx(2 / 3), 2: pytest.approx(1 / 3)}
    assert {r.hash: r.freq for r in S.hash_frequencies(S.merged(q), "l2").collect()} == {1: 2 / 5, 2: 1 / 5}
    flat = make(spark, {"a": [1, 1], "b": [1]}, abund=False)
    assert {r.hash: r["count"] for r in S.merged(flat).collect()} == {1: 1}


def cover_reference(query, matches, threshold):
    left, out = Counter(query), []
    names = sorted(matches)
    while True:
        best = max(names, key=lambda n: (len(left.keys() & set(matches[n])), -order(matches, n)))
        got = left.keys() & set(matches[best])
        if len(got) < max(1, threshold):
            return out
        out.append((best, len(got), sum(left[h] for h in got)))
        for h in got:
            del left[h]


def order(matches, name):
    import hashlib

    return sorted(matches, key=lambda n: (hashlib.md5(n.encode()).hexdigest(), n)).index(name)


@pytest.mark.parametrize("group_rows", [5_000_000, 3])
@pytest.mark.parametrize("threshold", [0, 3])
def test_gather_against_plain_python(spark, group_rows, threshold):
    rnd = random.Random(9)
    queries = {f"q{k}": [rnd.randint(0, 80) for _ in range(60)] for k in range(3)} | {"far": [1000]}
    matches = {f"m{k}": {rnd.randint(0, 80) for _ in range(rnd.randint(2, 25))} for k in range(8)}
    got = G.gather(make(spark, queries), make(spark, matches), threshold, keep_ids=True, group_rows=group_rows).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.gather_result_rank):
        by[r.query_id].append((r.match_id, r.unique_intersect_bp, r.n_unique_weighted_found))
        assert r.remaining_bp == len(set(queries[r.query_id])) - sum(x[1] for x in by[r.query_id])
        assert r.sum_weighted_found == sum(x[2] for x in by[r.query_id])
    assert dict(by) == {q: c for q, hs in queries.items() if (c := cover_reference(hs, matches, threshold))}


def test_fastgather_takes_one_query(spark):
    m = make(spark, {"m": [1]})
    with pytest.raises(ValueError):
        G.fastgather(make(spark, {"a": [1], "b": [1]}), m)
    assert G.fastgather(make(spark, {"a": [5]}), m, 0).count() == 0
    assert G.threshold_hashes(50_000, 1000) == 50 and G.threshold_hashes(10, 1000) == 1 and G.threshold_hashes(10, 1000, 0) == 0


def test_saved_matches_and_prefetch(spark):
    q, m = make(spark, {"q": [1, 2, 3]}), make(spark, {"m": [1, 2], "n": [3]})
    assert {r.hash for r in G.saved_matches(q, m, 2).collect()} == {1, 2}
    r = G.prefetch_report(q, m, G.prefetch(q, m, 2)).first()
    assert (r.match_name, r.intersect_bp, r.intersect_hashes) == ("m", 2, 2)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(150)] + [(500, k) for k in range(501, 560)] + [(900, 900), (None, 3), (4, None)] + [(k, k + 1) for k in range(1000, 1040)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            par[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == {x: find(x) for x in par}
    assert connected_components(df.limit(0)).count() == 0


def test_cluster(spark):
    rows = [("a x", "b", 0.9, None), ("b", "c", 0.2, 0.99), ("d", "d", 1.0, 1.0), ("e", "f", 0.95, None)]
    df = spark.createDataFrame(rows, "query_name string, match_name string, jaccard double, cosine double")
    found = cluster(df, "jaccard", 0.5)
    assert {(r.cluster, r.nodes) for r in members(found).collect()} == {("Component_1", "a;b"), ("Component_2", "c"), ("Component_3", "e;f")}
    assert {(r.cluster_size, r["count"]) for r in sizes(found).collect()} == {(2, 2), (1, 1)}
    assert sizes(cluster(df, "cosine", 0.5)).count() == 2
    with pytest.raises(ValueError):
        cluster(df)
    assert cluster(df.limit(0), "jaccard", 0.5).count() == 0


def test_index(spark, sets, tmp_path):
    sk, path = make(spark, sets), str(tmp_path / "ix")
    X.build(sk, path)
    assert X.is_index(spark, path) and not X.is_index(spark, str(tmp_path))
    assert all(r.ok for r in X.check(spark, path).collect()) and X.check(spark, path, quick=True).count() == 2
    got = {(r.query_name, r.match_name) for r in X.indexed_manysearch(sk, spark, path, 0.3).collect()}
    want = {(a, b) for a in sets for b in sets if set(sets[a]) and len(set(sets[a]) & set(sets[b])) / len(set(sets[a])) >= 0.3}
    assert got == want
    assert X.indexed_gather(sk, spark, path, 1).count() > 0
    X.build(sk, str(tmp_path / "bare"), store_sketches=False)
    with pytest.raises(ValueError):
        X.indexed_gather(sk, spark, str(tmp_path / "bare"))
    with pytest.raises(ValueError):
        X.open_index(spark, path, scaled=0)
    mixed = sk.union(type(sk)(sk.manifest.withColumn("ksize", F.lit(21)), sk.postings, sk.bits))
    with pytest.raises(ValueError):
        X.build(mixed, str(tmp_path / "mixed"))
    X.upgrade(spark, path)


def test_selection(spark):
    sk = make(spark, {"a": [1, 1 << 40], "b": [-5]}, scaled=10)
    assert sk.select(scaled=5).manifest.count() == 0
    down = sk.select(ksize=31, moltype="dna", scaled=1 << 30)
    assert {r.hash for r in down.postings.collect()} == {1} and down.max_scaled() == 1 << 30
    assert sk.select(ksize=21).postings.count() == 0
    assert sk.any_of("protein").manifest.count() == 0 and sk.any_of("dna").manifest.count() == 2
    assert sk.not_in_manifest(sk.manifest.filter("name = 'a'")).manifest.count() == 1
    assert sk.in_manifest(sk.manifest.filter("name = 'a'")).postings.count() == 2
    assert sk.first().first().sketch_id == "a" and sk.min_max_scaled() == (10, 10) and sk.parameters().count() == 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_give_the_pairs_of_the_join(spark, kind, monkeypatch):
    """Searches by blocks: the rows of the joined search, and no pair is shuffled."""
    monkeypatch.setattr(B, "MET", 7)
    rng = random.Random(5)
    sets = {i * 37 % 101: [(rng.randint(0, 60) - 30) * 10**15 for _ in range(rng.randint(1, 25))] + [5] * (i % 3) for i in range(60)}
    rows = spark.createDataFrame([(i, h) for i, hs in sets.items() for h in hs], "id long, hash long").select(F.col("id").cast(kind).alias("id"), "hash")
    some, other = from_rows(rows.filter("id % 2 = 0 or id > 50"), "id", "hash"), from_rows(rows, "id", "hash")
    monkeypatch.setattr(B.overlaps, "__defaults__", (False, False, 40))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    for search in (lambda by: J.multisearch(other, other, 0.2, ani=True, abund=True, keep_ids=True, by_blocks=by), lambda by: J.multisearch(some, other, 0.2, abund=True, keep_ids=True, by_blocks=by),
                   lambda by: J.pairwise(other, 0.2, abund=True, keep_ids=True, by_blocks=by), lambda by: J.pairwise(some, 0.2, write_all=True, by_blocks=by)):
        a, b = key(search(True)), key(search(False))
        assert a == b and len(a) > 40
    empty = from_rows(rows.filter("id is null"), "id", "hash")
    assert J.multisearch(empty, other, by_blocks=True).count() == 0


@pytest.mark.parametrize("name", ["multisearch_ani", "multisearch_cosine", "pairwise", "pairwise_write_all", "cluster", "cluster_members", "cluster_sizes"])
def test_no_query_shuffles_its_pairs(spark, name, monkeypatch):
    """The overlaps of the document searches are counted in blocks; none is grouped by pair behind a shuffle."""
    from hashloom.plans.queries import QUERIES

    def joined(*_, **__):
        raise AssertionError("pairs of the whole join")

    monkeypatch.setattr(J, "overlaps", joined)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def _clique(spark, monkeypatch, names=300):
    """Clusters of a table that links every two of ``names`` texts and a chain, and how many edges they were found from."""
    from hashloom.operators import cluster as C

    rows = [(f"n{a:03} x", f"n{b:03} x", 0.9) for a in range(names) for b in range(a)] + [(f"c{k}", f"c{k + 1}", 0.7 if k % 3 else 0.1) for k in range(8)]
    random.Random(3).shuffle(rows)
    made = []
    plain = C.connected_components
    monkeypatch.setattr(C, "connected_components", lambda edges: (made.append(edges.count()), plain(edges))[1])
    table = spark.createDataFrame(rows, "query_name string, match_name string, jaccard double").repartition(2)
    return C.cluster(table, "jaccard", 0.6), made


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_members_come_from_a_forest_of_the_pairs(spark, monkeypatch, most):
    """44,850 linked pairs of 300 names: a task hands on a row for each name, and the members are those of all pairs."""
    from hashloom.operators import cluster as C

    monkeypatch.setattr(C, "NAMES", most)
    found, made = _clique(spark, monkeypatch)
    want = {";".join(f"n{k:03}" for k in range(300)), "c0", "c1;c2;c3", "c4;c5;c6", "c7;c8"}
    assert {r.nodes for r in members(found).collect()} == want and (made[0] <= 2 * 309 or most == 40)


def test_sizes_come_from_a_forest_of_the_pairs(spark, monkeypatch):
    found, made = _clique(spark, monkeypatch, 200)
    assert {(r.cluster_size, r["count"]) for r in sizes(found).collect()} == {(200, 1), (1, 1), (3, 2), (2, 1)} and made[0] <= 2 * 209


def test_sizes_keep_one_copy_of_the_postings(spark):
    """When the blocks are stored, the postings they were dealt from and the shuffle files of both writings are gone."""
    import time
    from pathlib import Path

    rows = spark.createDataFrame([(f"s{k % 40}", k // 3) for k in range(4000)], "id string, hash long")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "hashloom"
    held = lambda: {p.name for p in shared.glob("postings-*")}
    folders = [Path(f.getPath()) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p.name for f in folders for p in f.rglob("shuffle_*.data")}
    before, files = held(), shuffled()
    blocks, _ = B._stored(from_rows(rows, "id", "hash"), 500)
    for _ in range(20):  # the files go in the background
        if (left := len(shuffled() - files)) <= 2:  # of the counting, by sketch and over all
            break
        time.sleep(0.1)
    assert held() == before and left <= 2 and len({r.block for r in blocks.select("block").collect()}) > 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_few_edges_take_one_write(spark, kind, monkeypatch):
    """A small table is settled without rounds, and gives what the rounds give."""
    from hashloom.plans import graph

    rnd = random.Random(4)
    rows = [(rnd.randint(-90, 400), rnd.randint(-90, 400)) for _ in range(220)] + [(k, k + 1) for k in range(500, 600)] + [(7, 7), (1000, 1000), (None, 3)]
    df = spark.createDataFrame(rows, "src long, dst long").select(*[F.col(c).cast(kind) for c in ("src", "dst")])
    rounds = []
    plain = graph._small_star
    monkeypatch.setattr(graph, "_small_star", lambda e: (rounds.append(1), plain(e))[1])
    few = sorted(map(tuple, connected_components(df).collect()))
    assert not rounds
    monkeypatch.setattr(graph, "FEW", 0)
    assert few == sorted(map(tuple, connected_components(df).collect())) and rounds


@pytest.mark.parametrize("n", [1, 3])
def test_shingles_against_plain_python(spark, n, monkeypatch):
    """Shingles of odd texts as their definition gives them, and not one md5 expression for each use of the hash in the plan."""
    import hashlib
    import re

    from hashloom.plans import views as V

    monkeypatch.setattr(V, "BYTES", 40)
    texts = [None, "", "one", "a b", "A b C", "x" * 70 + " y " + "z" * 9, "re-peat re peat RE.peat re peat", " é1 b c_3 İK Ωd 4  ", "end", "start of the next"] * 3 + ["q w e " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    low = {r.k: r.text or "" for r in df.select("k", F.lower("text").alias("text")).collect()}
    want = Counter((k, int(hashlib.md5(" ".join(w[i : i + n]).encode()).hexdigest()[:15], 16)) for k, x in low.items() for w in [re.findall("[a-z0-9]+", x)] for i in range(len(w) - n + 1))
    got = V.shingle_rows(df, "k", n=n)
    assert Counter(map(tuple, got.collect())) == want
    assert "md5" not in got.filter("hash > 5")._jdf.queryExecution().toString()
    few = Counter(map(tuple, V.shingle_rows(df.repartition(3), "k", n=n, scaled=3).collect()))
    assert few == Counter({k: c for k, c in want.items() if k[1] <= (1 << 60) // 3})


@pytest.mark.parametrize("name", ["multisearch_ani", "multisearch_cosine", "pairwise", "pairwise_write_all"])
def test_pairs_leave_their_task_in_few_columns(spark, name, monkeypatch):
    """What a task hands on of a pair is what the query gives or measures, no names and digests."""
    from hashloom.plans.queries import QUERIES

    given = []
    plain = B.overlaps
    monkeypatch.setattr(B, "overlaps", lambda *a, **k: (given.append(plain(*a, **k)), given[0])[1])
    assert QUERIES[name](spark, "/root/testdata/sf0.001").columns[:2] == ["query_id", "match_id"]
    more = {"multisearch_ani": {"q_ksize"}, "multisearch_cosine": {"dot", "q_square", "m_square", "q_with_abundance", "m_with_abundance"}}
    assert set(given[0].columns) == {"query_id", "match_id", "ov", "q_n", "m_n"} | more.get(name, set())


@pytest.mark.parametrize("name", ["cluster", "cluster_members", "cluster_sizes"])
def test_clusters_come_without_rows_of_pairs(spark, name, monkeypatch):
    from hashloom.plans.queries import QUERIES

    monkeypatch.setattr(B, "_search", None)
    monkeypatch.setattr(J, "pairwise", None)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("column", ["jaccard", "containment", "max_containment", "average_containment", "cosine", "max_containment_ani"])
def test_clusters_of_sketches_are_those_of_their_pairs(spark, column, monkeypatch):
    from hashloom.operators.cluster import cluster_sketches

    rnd = random.Random(8)
    base = [[rnd.randint(0, 4000) for _ in range(30)] for _ in range(12)]
    sk = make(spark, {f"s{k}": rnd.sample(base[k % 12], rnd.randint(12, 30)) + [5] * (k % 4 == 0) for k in range(70)} | {"none": [], "alone": [-1]})
    monkeypatch.setattr(B, "MET", 50)
    monkeypatch.setattr(B.links, "__defaults__", (200,))
    key = lambda df: sorted(tuple(r) for r in df.select("name", "cluster", "component").collect())
    found = key(cluster_sketches(sk, column, 0.7, 0.05))
    assert found == key(cluster(J.pairwise(sk, 0.05, ani=True, abund=True), column, 0.7)) and 1 < len({c for _, c, _ in found}) < len(found)
