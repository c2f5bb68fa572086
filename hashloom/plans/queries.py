"""Registered queries over the driver's tables, each with equivalent DuckDB SQL where SQL can express it.

Doubles are rounded on both sides, since the two engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.hashing import max_hash
from hashloom.functions.metrics import rounded
from hashloom.operators import gather as G
from hashloom.operators import index as X
from hashloom.operators import overlap as J
from hashloom.operators import significance as S
from hashloom.operators.cluster import cluster_sketches, members, sizes
from hashloom.operators.sketch import sketch
from hashloom.plans import views as V
from hashloom.scratch import new_path
from hashloom.session import spread
from hashloom.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# -- SQL of the views ---------------------------------------------------------------------------------------------

BASKET = "basket as (select l_suppkey id, l_partkey hash, count(*)::bigint abund from lineitem where l_suppkey is not null and l_partkey is not null group by all)"
NATION = """nation_basket as (select c_nationkey::bigint id, l_partkey hash, count(*)::bigint abund from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey where c_nationkey is not null and l_partkey is not null group by all)"""


def _shingle_sql(name: str, table: str, key: str) -> str:
    return f"""{name} as (select id, ('0x' || substr(md5(s), 1, 15))::bigint hash, count(*)::bigint abund from (
        select id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s from (
            select {key} id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') w from {table} where {key} is not null) where len(w) >= 3) group by all)"""


DOCS = _shingle_sql("docs", "documents", "doc_id")
BENCH = _shingle_sql("bench", "benchmark", "item_id")


def _kept(scaled: int, view: str) -> str:
    return f"(select * from {view} where hash <= {max_hash(scaled, V.SHINGLE_BITS)})"


def _sized(name: str, source: str) -> str:
    return f"{name}_n as (select id, count(*)::bigint n, sum(abund)::bigint total, sum(abund * abund)::bigint square from {source} group by id)"


def _pairs(q: str, m: str, on: str = "true") -> str:
    """Pairs with overlap, sizes and the usual measures of shared hashes."""
    return f"""ov as (select q.id qid, m.id mid, count(*)::bigint ov, sum(q.abund * m.abund)::bigint dot, sum(m.abund)::bigint found, avg(m.abund) average,
        median(m.abund) med, stddev_pop(m.abund) std from {q} q join {m} m on q.hash = m.hash and {on} group by all)"""


def _query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _r(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded; every other column as it is."""
    return df.select(*[rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Common SELECT lists (q: query sizes, m: match sizes, o: overlap).
_CQ, _CM = "(o.ov / q.n)", "(o.ov / m.n)"
_ID = "o.qid query_id, o.mid match_id"
_BASE = f"""{_ID}, round({_CQ}, 9) containment, round(greatest({_CQ}, {_CM}), 9) max_containment, round(o.ov / (q.n + m.n - o.ov), 9) jaccard,
    round(({_CQ} + {_CM}) / 2, 9) average_containment, o.ov::double intersect_hashes"""


def _ani(c: str, k: int) -> str:
    return f"(case when {c} = 0 then 0.0 when {c} = 1 then 1.0 else pow({c}, 1.0 / {k}) end)"


_ANI = f"""round({_ani(_CQ, 31)}, 9) query_containment_ani, round({_ani(_CM, 31)}, 9) match_containment_ani,
    round(({_ani(_CQ, 31)} + {_ani(_CM, 31)}) / 2, 9) average_containment_ani, round(greatest({_ani(_CQ, 31)}, {_ani(_CM, 31)}), 9) max_containment_ani"""
_COS = "round(1 - 2 * acos(greatest(least(o.dot / (sqrt(q.square::double) * sqrt(m.square::double)), 1.0), -1.0)) / pi(), 6) cosine"
_COLS = ["query_id", "match_id", "containment", "max_containment", "jaccard", "average_containment", "intersect_hashes"]
_ANI_COLS = ["query_containment_ani", "match_containment_ani", "average_containment_ani", "max_containment_ani"]


def _search_sql(views: list[str], q: str, m: str, select: str, where: str, on: str = "true") -> str:
    return f"with {', '.join(views)}, {_sized('q', q)}, {_sized('m', m)}, {_pairs(q, m, on)} select {select} from ov o join q_n q on q.id = o.qid join m_n m on m.id = o.mid where {where}"


# -- sketches -----------------------------------------------------------------------------------------------------


@_query("sketch_shingle", f"with {DOCS} select id sketch_id, hash from docs")
def sketch_shingle(spark: SparkSession, sf: str) -> DataFrame:
    return V.shingles(spark, sf, "documents", abund=False).postings.select("sketch_id", "hash")


@_query("sketch_shingle_abund", f"with {DOCS} select id sketch_id, hash, abund from docs")
def sketch_shingle_abund(spark: SparkSession, sf: str) -> DataFrame:
    return V.shingles(spark, sf, "documents").postings.select("sketch_id", "hash", "abund")


@_query("downsample_scaled", f"with {DOCS} select id sketch_id, hash, abund from {_kept(10, 'docs')}")
def downsample_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return V.shingles(spark, sf, "documents").select(scaled=10).postings.select("sketch_id", "hash", "abund")


@_query("select_manifest", f"with {DOCS} select doc_id sketch_id, doc_id::varchar as name, 'DNA' moltype, 31 ksize, 10 scaled, coalesce(n, 0)::bigint n_hashes, coalesce(total, 0)::bigint sum_abund from (select distinct doc_id from documents where doc_id is not null) left join (select id, count(*) n, sum(abund) total from {_kept(10, 'docs')} group by id) on id = doc_id")
def select_manifest(spark: SparkSession, sf: str) -> DataFrame:
    sk = V.shingles(spark, sf, "documents").select(ksize=31, moltype="dna", scaled=10)
    return sk.manifest.select("sketch_id", "name", "moltype", "ksize", "scaled").join(sk.sizes().select("sketch_id", F.col("n").alias("n_hashes"), F.col("total").alias("sum_abund")), "sketch_id")


@_query("parameter_summary", "select distinct 31 ksize, 'DNA' moltype, true with_abundance, 0 num, 1 scaled from documents")
def parameter_summary(spark: SparkSession, sf: str) -> DataFrame:
    return V.shingles(spark, sf, "documents").parameters()


# -- searches -----------------------------------------------------------------------------------------------------


@_query("overlap_count", f"with {BASKET}, {_pairs('basket', 'basket')} select qid query_id, mid match_id, ov, dot from ov")
def overlap_count(spark: SparkSession, sf: str) -> DataFrame:
    sk = V.supplier_parts(spark, sf)
    return J.overlaps(sk.postings, sk.postings)


@_query("multisearch", _search_sql([BASKET], "basket", "basket", _BASE, f"{_CQ} > 0.01"))
def multisearch(spark: SparkSession, sf: str) -> DataFrame:
    sk = V.supplier_parts(spark, sf)
    return _r(J.multisearch(sk, sk, keep_ids=True).select(*_COLS))


@_query("multisearch_ani", _search_sql([DOCS], _kept(10, "docs"), _kept(10, "docs"), f"{_BASE}, {_ANI}", f"{_CQ} > 0.05"))
def multisearch_ani(spark: SparkSession, sf: str) -> DataFrame:
    sk = V.shingles(spark, sf, "documents", scaled=10)
    return _r(J.multisearch(sk, sk, threshold=0.05, scaled=10, ani=True, by_blocks=True, only=_COLS + _ANI_COLS))


@_query("multisearch_cosine", _search_sql([DOCS], _kept(10, "docs"), _kept(10, "docs"), f"{_ID}, {_COS}", f"{_CQ} > 0.05"))
def multisearch_cosine(spark: SparkSession, sf: str) -> DataFrame:
    sk = V.shingles(spark, sf, "documents", scaled=10)
    return _r(J.multisearch(sk, sk, threshold=0.05, scaled=10, abund=True, by_blocks=True, only=["query_id", "match_id", "cosine"]), 6)


@_query(
    "multisearch_all",
    f"""with {BENCH}, {DOCS}, {_sized('q', _kept(10, 'bench'))}, {_sized('m', _kept(10, 'docs'))}, {_pairs(_kept(10, 'bench'), _kept(10, 'docs'))}
    select i.item_id query_id, d.doc_id match_id, round(coalesce(o.ov / q.n, 0), 9) containment, round(coalesce(o.ov / (q.n + m.n - o.ov), 0), 9) jaccard, coalesce(o.ov, 0)::double intersect_hashes
    from (select distinct item_id from benchmark) i cross join (select distinct doc_id from documents) d left join q_n q on q.id = i.item_id left join m_n m on m.id = d.doc_id left join ov o on o.qid = i.item_id and o.mid = d.doc_id""",
)
def multisearch_all(spark: SparkSession, sf: str) -> DataFrame:
    got = J.multisearch(V.shingles(spark, sf, "benchmark"), V.shingles(spark, sf, "documents"), scaled=10, output_all=True, keep_ids=True)
    return _r(got.select("query_id", "match_id", "containment", "jaccard", "intersect_hashes"))


_SIG = f"""{BASKET},
    qf as (select hash, sum(abund)::double c from basket group by hash), tot as (select sum(c) s from qf),
    df as (select hash, count(distinct id) df from basket group by hash), nn as (select count(distinct id)::double n from basket),
    sq as (select id, sum(abund * abund)::double square from basket group by id),
    sc as (select q.id qid, m.id mid, count(*)::bigint ov, sum((f.c / s) * (f.c / s)) prob, sum((q.abund / square) * (ln((1 + n) / (1 + df)) + 1)) tfidf
        from basket q join basket m using (hash) join qf f using (hash) join df using (hash) join sq on sq.id = q.id cross join tot cross join nn group by all),
    sz as (select id, count(*)::double k from basket group by id)"""


@_query(
    "multisearch_prob_overlap",
    f"""with {_SIG} select qid query_id, mid match_id, round(prob * 1e6, 6) prob_overlap_e6, round(prob * n * n, 6) prob_overlap_adjusted, round(ov / k / (prob * n * n), 6) containment_adjusted,
    round(log10(ov / k / (prob * n * n)), 6) containment_adjusted_log10 from sc join sz on sz.id = qid cross join nn where ov / k > 0.2""",
)
def multisearch_prob_overlap(spark: SparkSession, sf: str) -> DataFrame:
    sk = V.supplier_parts(spark, sf)
    got = J.multisearch(sk, sk, threshold=0.2, prob=True, keep_ids=True)
    return _r(got.select("query_id", "match_id", (F.col("prob_overlap") * 1e6).alias("prob_overlap_e6"), "prob_overlap_adjusted", "containment_adjusted", "containment_adjusted_log10"), 6)


@_query("multisearch_tfidf", f"with {_SIG} select qid query_id, mid match_id, round(tfidf, 6) tf_idf_score from sc join sz on sz.id = qid where ov / k > 0.2")
def multisearch_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    sk = V.supplier_parts(spark, sf)
    return _r(J.multisearch(sk, sk, threshold=0.2, prob=True, keep_ids=True).select("query_id", "match_id", "tf_idf_score"), 6)


@_query("hash_idf", f"with {DOCS}, d as (select hash, count(distinct id)::bigint df from docs group by hash) select hash, df, round(ln((1.0 + n) / (1.0 + df)) + 1, 9) idf from d, (select count(distinct doc_id) n from documents)")
def hash_idf(spark: SparkSession, sf: str) -> DataFrame:
    return _r(S.idf(V.shingles(spark, sf, "documents")))


@_query("hash_l1_freq", f"with {BASKET}, m as (select hash, sum(abund)::double c from basket group by hash) select hash, round(c / (select sum(c) from m) * 1e3, 9) freq_e3 from m")
def hash_l1_freq(spark: SparkSession, sf: str) -> DataFrame:
    got = S.hash_frequencies(S.merged(V.supplier_parts(spark, sf)))
    return got.select("hash", F.round(F.col("freq") * 1e3, 9).alias("freq_e3"))


@_query("hash_l2_freq", f"with {BASKET}, m as (select hash, sum(abund)::double c from basket group by hash) select hash, round(c / (select sum(c * c) from m) * 1e6, 9) freq_e6 from m")
def hash_l2_freq(spark: SparkSession, sf: str) -> DataFrame:
    got = S.hash_frequencies(S.merged(V.supplier_parts(spark, sf)), "l2")
    return got.select("hash", F.round(F.col("freq") * 1e6, 9).alias("freq_e6"))


_PAIR_WHERE = f"greatest({_CQ}, {_CM}) > 0.05"


@_query("pairwise", _search_sql([DOCS], _kept(10, "docs"), _kept(10, "docs"), _BASE, _PAIR_WHERE, "q.id < m.id"))
def pairwise(spark: SparkSession, sf: str) -> DataFrame:
    return _r(J.pairwise(V.shingles(spark, sf, "documents", scaled=10), threshold=0.05, scaled=10, by_blocks=True, only=_COLS))


_OWN = "select doc_id, doc_id, 1.0, 1.0, 1.0, 1.0, coalesce(n, 0)::double from (select distinct doc_id from documents) left join q_n on id = doc_id"


@_query("pairwise_write_all", _search_sql([DOCS], _kept(10, "docs"), _kept(10, "docs"), _BASE, _PAIR_WHERE, "q.id < m.id") + f" union all {_OWN}")
def pairwise_write_all(spark: SparkSession, sf: str) -> DataFrame:
    return _r(J.pairwise(V.shingles(spark, sf, "documents", scaled=10), threshold=0.05, scaled=10, write_all=True, keep_ids=True, by_blocks=True, only=_COLS))


@_query(
    "pairwise_all",
    f"""with {BENCH}, {_sized('q', 'bench')}, {_pairs('bench', 'bench', 'q.id < m.id')}, i as (select distinct item_id id from benchmark)
    select a.id query_id, b.id match_id, round(coalesce(o.ov / q.n, 0), 9) containment, round(coalesce(o.ov / (q.n + m.n - o.ov), 0), 9) jaccard, coalesce(o.ov, 0)::double intersect_hashes
    from i a join i b on a.id < b.id left join q_n q on q.id = a.id left join q_n m on m.id = b.id left join ov o on o.qid = a.id and o.mid = b.id
    union all select i.id, i.id, 1.0, 1.0, coalesce(n, 0)::double from i left join q_n on q_n.id = i.id""",
)
def pairwise_all(spark: SparkSession, sf: str) -> DataFrame:
    return _r(J.pairwise(V.shingles(spark, sf, "benchmark"), output_all=True, keep_ids=True).select("query_id", "match_id", "containment", "jaccard", "intersect_hashes"))


_MANY = f"""{_ID}, round({_CQ}, 9) containment, o.ov intersect_hashes, round(o.ov / (q.n + m.n - o.ov), 9) jaccard, round(greatest({_CQ}, {_CM}), 9) max_containment,
    round({_CM}, 9) containment_target_in_query, round({_ani(_CQ, 31)}, 9) query_containment_ani, round({_ani(_CM, 31)}, 9) match_containment_ani"""
_MANY_COLS = ["query_id", "match_id", "containment", "intersect_hashes", "jaccard", "max_containment", "containment_target_in_query", "query_containment_ani", "match_containment_ani"]


@_query("manysearch", _search_sql([BENCH, DOCS], "bench", "docs", _MANY, f"{_CQ} > 0.01"))
def manysearch(spark: SparkSession, sf: str) -> DataFrame:
    got = J.manysearch(V.shingles(spark, sf, "benchmark"), V.shingles(spark, sf, "documents"), ignore_abundance=True, keep_ids=True)
    return _r(got.select(*_MANY_COLS))


@_query(
    "manysearch_abund",
    _search_sql(
        [NATION, BASKET], "basket", "nation_basket",
        f"{_ID}, round({_CQ}, 9) containment, round(o.average, 6) average_abund, o.med::double median_abund, round(o.std, 6) std_abund, o.found n_weighted_found, m.total total_weighted_hashes, round(o.found / m.total, 9) f_weighted_target_in_query",
        f"{_CQ} > 0.01",
    ),
)
def manysearch_abund(spark: SparkSession, sf: str) -> DataFrame:
    got = J.manysearch(V.supplier_parts(spark, sf), V.nation_parts(spark, sf), keep_ids=True)
    cols = [F.col(c) for c in ("query_id", "match_id")] + [F.round(c, 9).alias(c) for c in ("containment", "f_weighted_target_in_query")] + [F.round(c, 6).alias(c) for c in ("average_abund", "std_abund")]
    return got.select(*cols, "median_abund", "n_weighted_found", "total_weighted_hashes")


@_query(
    "manysearch_all",
    f"""with {BENCH}, {DOCS}, {_sized('q', _kept(10, 'bench'))}, {_pairs(_kept(10, 'bench'), _kept(10, 'docs'))}
    select i.item_id query_id, d.doc_id match_id, round(coalesce(o.ov / q.n, 0), 9) containment, coalesce(o.ov, 0)::bigint intersect_hashes, coalesce(o.found, 0)::bigint n_weighted_found
    from (select distinct item_id from benchmark) i cross join (select distinct doc_id from documents) d left join q_n q on q.id = i.item_id left join ov o on o.qid = i.item_id and o.mid = d.doc_id""",
)
def manysearch_all(spark: SparkSession, sf: str) -> DataFrame:
    got = J.manysearch(V.shingles(spark, sf, "benchmark"), V.shingles(spark, sf, "documents"), scaled=10, output_all=True, keep_ids=True)
    return _r(got.select("query_id", "match_id", "containment", "intersect_hashes", "n_weighted_found"))


@_query(
    "manysearch_indexed",
    _search_sql([BENCH, DOCS], "bench", "docs", f"o.qid::varchar query_name, o.mid::varchar match_name, round({_CQ}, 9) containment, o.ov intersect_hashes, round({_ani(_CQ, 31)}, 9) query_containment_ani", f"{_CQ} >= 0.01"),
)
def manysearch_indexed(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "index")
    X.build(V.shingles(spark, sf, "documents"), path)
    got = X.indexed_manysearch(V.shingles(spark, sf, "benchmark"), spark, path)
    return _r(got.select("query_name", "match_name", "containment", "intersect_hashes", "query_containment_ani"))


@_query(
    "pretty_manysearch",
    _search_sql([BENCH, DOCS], "bench", "docs", f"printf('%-17s %6s%%  %6s     %6s     %s', substr(o.qid::varchar, 1, 17), printf('%.1f', {_CQ} * 100), 'N/A', 'N/A', o.mid::varchar) line", f"{_CQ} > 0.01"),
)
def pretty_manysearch(spark: SparkSession, sf: str) -> DataFrame:
    got = J.manysearch(V.shingles(spark, sf, "benchmark"), V.shingles(spark, sf, "documents"), ignore_abundance=True)
    return sinks.pretty(got).select("line")


# -- gather -------------------------------------------------------------------------------------------------------


@_query("prefetch", f"with {DOCS}, {BENCH}, {_pairs('docs', 'bench')} select qid query_id, mid match_id, ov from ov where ov >= 3")
def prefetch(spark: SparkSession, sf: str) -> DataFrame:
    return G.prefetch(V.shingles(spark, sf, "documents"), V.shingles(spark, sf, "benchmark"), 3)


def _gather_sql(views: list[str], q: str, m: str, threshold: int, rounds: int, where: str = "true") -> str:
    """Greedy rounds written out: each takes the best remaining match of every query and removes its hashes."""
    steps = [f"r0 as (select q.id qid, m.id mid, q.hash, q.abund from (select * from {q} where {where}) q join {m} m using (hash))"]
    for k in range(rounds):
        steps += [
            f"s{k} as (select qid, mid, count(*) ov from r{k} group by all having count(*) >= {threshold})",
            f"b{k} as (select qid, mid, ov from (select *, row_number() over (partition by qid order by ov desc, md5(mid::varchar), mid::varchar, mid) o from s{k}) where o = 1)",
            f"t{k} as (select r.qid, r.mid, r.hash, r.abund from r{k} r join b{k} b on r.qid = b.qid and r.mid = b.mid)",
            f"g{k} as (select qid, mid, {k}::int rank, count(*)::bigint ov, sum(abund)::bigint found, avg(abund) average, median(abund) med, stddev_pop(abund) std from t{k} group by qid, mid)",
            f"r{k + 1} as (select * from r{k} r where exists (select 1 from b{k} b where b.qid = r.qid) and not exists (select 1 from t{k} t where t.qid = r.qid and t.hash = r.hash))",
        ]
    union = " union all ".join(f"select * from g{k}" for k in range(rounds))
    return f"""with {', '.join(views)}, {_sized('q', q)}, {_sized('m', m)}, {', '.join(s.replace(' as (', ' as materialized (', 1) for s in steps)}, ga as ({union}),
    orig as (select q.id qid, m.id mid, count(*)::bigint orig from {q} q join {m} m using (hash) group by all)
    select g.qid query_id, g.mid match_id, g.rank gather_result_rank, orig intersect_bp, g.ov unique_intersect_bp, round(orig / q.n, 9) f_orig_query, round(g.ov / m.n, 9) f_match, round(orig / m.n, 9) f_match_orig, round(g.ov / q.n, 9) f_unique_to_query,
        round(g.found / q.total, 9) f_unique_weighted, round(g.average, 6) average_abund, g.med::double median_abund, round(g.std, 6) std_abund, g.found n_unique_weighted_found, q.total total_weighted_hashes,
        (q.n - sum(g.ov) over w)::bigint remaining_bp, (sum(g.found) over w)::bigint sum_weighted_found
    from ga g join q_n q on q.id = g.qid join m_n m on m.id = g.mid join orig on orig.qid = g.qid and orig.mid = g.mid window w as (partition by g.qid order by g.rank rows unbounded preceding)"""


_GATHER_COLS = ["query_id", "match_id", "gather_result_rank", "intersect_bp", "unique_intersect_bp", "f_orig_query", "f_match", "f_match_orig", "f_unique_to_query", "f_unique_weighted"]
_GATHER_MORE = ["median_abund", "n_unique_weighted_found", "total_weighted_hashes", "remaining_bp", "sum_weighted_found"]


def _gathered(df: DataFrame) -> DataFrame:
    return _r(df.select(*_GATHER_COLS, *_GATHER_MORE)).join(df.select("query_id", "match_id", F.round("average_abund", 6).alias("average_abund"), F.round("std_abund", 6).alias("std_abund")), ["query_id", "match_id"])


@_query("fastmultigather", _gather_sql([DOCS, BENCH], "docs", "bench", 3, 12))
def fastmultigather(spark: SparkSession, sf: str) -> DataFrame:
    return _gathered(G.gather(V.stored(V.shingles(spark, sf, "documents")), V.shingles(spark, sf, "benchmark"), threshold_bp=3, keep_ids=True))


@_query("fastgather", _gather_sql([NATION, BASKET], "nation_basket", "basket", 30, 24, "id = 7"))
def fastgather(spark: SparkSession, sf: str) -> DataFrame:
    nations = V.stored(V.nation_parts(spark, sf))
    one = type(nations)(nations.manifest.filter("sketch_id = 7"), nations.postings.filter("sketch_id = 7"), nations.bits)
    return _gathered(G.fastgather(one, V.stored(V.supplier_parts(spark, sf)), threshold_bp=30, keep_ids=True))


@_query("fastmultigather_indexed", _gather_sql([DOCS, BENCH], "docs", "bench", 1, 16))
def fastmultigather_indexed(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "index")
    X.build(V.shingles(spark, sf, "benchmark"), path)
    return _gathered(X.indexed_gather(V.stored(V.shingles(spark, sf, "documents")), spark, path, threshold_bp=1, keep_ids=True))


@_query("save_matches", f"with {DOCS}, {BENCH}, {_pairs('docs', 'bench')} select distinct d.id query_id, d.hash from docs d join bench b using (hash) join ov on ov.qid = d.id and ov.mid = b.id and ov.ov >= 3")
def save_matches(spark: SparkSession, sf: str) -> DataFrame:
    return G.saved_matches(V.stored(V.shingles(spark, sf, "documents")), V.shingles(spark, sf, "benchmark"), threshold_bp=3)


# -- clusters -----------------------------------------------------------------------------------------------------

_CLUSTER_SQL = (
    f"with recursive {DOCS}, {_sized('q', _kept(10, 'docs'))}, {_sized('m', _kept(10, 'docs'))}, {_pairs(_kept(10, 'docs'), _kept(10, 'docs'), 'q.id < m.id')}, "
    f"pw as (select o.qid a, o.mid b, o.ov / (q.n + m.n - o.ov) jac from ov o join q_n q on q.id = o.qid join m_n m on m.id = o.mid where {_PAIR_WHERE}), "
    "nodes as (select distinct n from (select a n from pw union all select b from pw)), e as (select a x, b y from pw where jac >= 0.6 union all select b, a from pw where jac >= 0.6), "
    "walk(n, root) as (select n, n from nodes union select e.y, w.root from walk w join e on e.x = w.n), lab as (select n, min(root::varchar) component from walk group by n)"
)


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_sketches(V.shingles(spark, sf, "documents", scaled=10), "jaccard", 0.6, least=0.05, scaled=10)


@_query("cluster", _CLUSTER_SQL + " select n::varchar as name, component, 'Component_' || dense_rank() over (order by component) as cluster from lab")
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)


@_query("cluster_members", _CLUSTER_SQL + ", num as (select *, 'Component_' || dense_rank() over (order by component) cluster from lab) select cluster, string_agg(n::varchar, ';' order by n::varchar) nodes from num group by cluster")
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    return members(_clusters(spark, sf))


@_query("cluster_sizes", _CLUSTER_SQL + " select cluster_size, count(*)::bigint as count from (select component, count(*)::bigint cluster_size from lab group by component) group by cluster_size")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return sizes(_clusters(spark, sf))


# -- index and manifests ------------------------------------------------------------------------------------------


@_query("index_postings", f"with {DOCS} select hash, id sketch_id, abund from docs")
def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "index")
    X.build(V.shingles(spark, sf, "documents"), path)
    return X.open_index(spark, path).postings.select("hash", "sketch_id", "abund")


@_query("index_check", "select * from (values ('version', true, '1'), ('manifest', true, (select count(distinct doc_id) || ' sketches' from documents)), ('postings', true, '0 sketches differ')) t(\"check\", ok, detail)")
def index_check(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "index")
    X.build(V.shingles(spark, sf, "documents"), path)
    return X.check(spark, path)


@_query("manifest_semi", "select distinct doc_id sketch_id, doc_id::varchar as name from documents where lang = 'en'")
def manifest_semi(spark: SparkSession, sf: str) -> DataFrame:
    sk = V.shingles(spark, sf, "documents")
    en = spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").select(F.col("doc_id").alias("sketch_id"))
    return sk.in_manifest(sk.manifest.join(en, "sketch_id", "left_semi")).manifest.select("sketch_id", "name")


@_query("manifest_anti", "select distinct doc_id sketch_id, doc_id::varchar as name from documents where lang is distinct from 'en'")
def manifest_anti(spark: SparkSession, sf: str) -> DataFrame:
    sk = V.shingles(spark, sf, "documents")
    en = spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").select(F.col("doc_id").alias("sketch_id"))
    return sk.not_in_manifest(sk.manifest.join(en, "sketch_id", "left_semi")).manifest.select("sketch_id", "name")


@_query("dedupe_rows", "select distinct o_custkey, o_orderstatus from orders")
def dedupe_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderstatus").dropDuplicates()


@_query("dup_paths", "select url path, count(*)::bigint n from pages group by url having count(*) > 1")
def dup_paths(spark: SparkSession, sf: str) -> DataFrame:
    from hashloom.sources.fromfile import duplicates

    return duplicates(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("url").alias("path")))


@_query("merged_sketch", f"with {BASKET} select hash, sum(abund)::bigint as count from basket group by hash")
def merged_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return S.merged(V.supplier_parts(spark, sf))


@_query("sketch_sizes", f"with {BASKET} select id sketch_id, count(*)::bigint n, sum(abund)::bigint total, sum(abund * abund)::bigint square from basket group by id")
def sketch_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return V.supplier_parts(spark, sf).sizes()


@_query("collection_union", f"with {BASKET}, {NATION} select 's' || id sketch_id, hash, abund from basket union all select 'n' || id, hash, abund from nation_basket")
def collection_union(spark: SparkSession, sf: str) -> DataFrame:
    def tagged(sk, tag: str):
        name: Column = F.concat(F.lit(tag), F.col("sketch_id").cast("string"))
        return type(sk)(sk.manifest.withColumn("sketch_id", name), sk.postings.withColumn("sketch_id", name), sk.bits)

    return tagged(V.supplier_parts(spark, sf), "s").union(tagged(V.nation_parts(spark, sf), "n")).postings.select("sketch_id", "hash", "abund")


# -- sequences: the letters of the texts read as nucleotides and residues (no SQL: the hash is not one of DuckDB's) ----------


def _sequences(spark: SparkSession, sf: str, kind: str, letters: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    seq = F.regexp_replace(F.upper("text"), f"[^{letters}]", "").cast("binary")
    name = F.col("doc_id").cast("string")
    return docs.select(name.alias("name"), F.lit(kind).alias("input_moltype"), F.lit(None).cast("string").alias("filename"), name.alias("record_id"), seq.alias("seq"))


def _sketched(rows: DataFrame, params: str) -> DataFrame:
    return sketch(rows, params).manifest.select("name", "moltype", "ksize", "ksize_nt", "scaled", "num", "with_abundance", "n_hashes", "md5")


@_query("dna_sketch")
def dna_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return _sketched(_sequences(spark, sf, "dna", "ACGT"), "dna,k=11,scaled=5,abund_dna,k=15,num=50")


@_query("protein_sketch")
def protein_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return _sketched(_sequences(spark, sf, "protein", "A-Z"), "protein,k=7,scaled=5_dayhoff,k=10,scaled=5_hp,k=16,scaled=5")


@_query("skipmer_sketch")
def skipmer_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return _sketched(_sequences(spark, sf, "dna", "ACGT"), "skipm1n3,k=9,scaled=5_skipm2n3,k=11,scaled=5")
