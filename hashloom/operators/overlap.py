"""Overlap joins: all-pairs, pairwise and many-against-many search.

Sketches are compared by one equi-join of postings on the hash and one aggregation by pair; no pair without a shared hash
is ever formed.  Per-sketch sizes are aggregated once and joined to the pairs.  Both joins leave the choice of
strategy to the optimizer: adaptive execution broadcasts a side that proves small and splits the partitions of very common
hashes.  Only ``output_all`` lists pairs without overlap, as its definition asks.  With ``by_blocks`` the pairs
above the threshold come from :mod:`hashloom.operators.blocks`, which shuffles no pairs: for collections with very common hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.metrics import angular, ani, jaccard, ratio
from hashloom.model import Sketches
from hashloom.operators import blocks, significance


def common_scaled(scaled: int | None, *collections: Sketches) -> int:
    """``scaled`` if given, else the largest one of the first collection."""
    return scaled or collections[0].max_scaled() or 1


def overlaps(q: DataFrame, a: DataFrame, condition: Column | None = None, stats: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """``(query_id, match_id, ov, dot)`` of postings that share hashes; with ``stats`` also the match's abundance statistics.

    ``condition`` restricts the pairs and may use ``query_id`` and ``match_id``.  ``weights(hash, chance, idf)`` adds the sums ``chance``
    and ``terms`` (of the query's abundances times ``idf``) over the shared hashes.
    """
    left = q.select("hash", F.col("sketch_id").alias("query_id"), F.col("abund").alias("qa"))
    left = left if weights is None else left.join(weights, "hash")
    right = a.select("hash", F.col("sketch_id").alias("match_id"), F.col("abund").alias("ma"))
    met = left.join(right, "hash")
    if condition is not None:
        met = met.filter(condition)
    extra = [F.sum("ma").alias("found"), F.avg("ma").alias("average"), F.median("ma").alias("median"), F.stddev_pop("ma").alias("std")] if stats else []
    extra += [] if weights is None else [F.sum("chance").alias("chance"), F.sum(F.col("qa") * F.col("idf")).alias("terms")]
    return met.groupBy("query_id", "match_id").agg(F.count(F.lit(1)).alias("ov"), F.sum(F.col("qa") * F.col("ma")).alias("dot"), *extra)


def _side(sk: Sketches, prefix: str, letter: str) -> DataFrame:
    """Names and sizes of a collection under prefixed names, a row for each sketch."""
    m = sk.manifest.select("sketch_id", "name", "md5", "ksize", "ksize_nt", "scaled", "moltype", "with_abundance").join(sk.sizes(), "sketch_id")
    return m.select(
        F.col("sketch_id").alias(f"{prefix}_id"),
        F.col("name").alias(f"{prefix}_name"),
        F.col("md5").alias(f"{prefix}_md5"),
        *[F.col(c).alias(f"{letter}_{c}") for c in ("ksize", "ksize_nt", "scaled", "moltype", "with_abundance", "n", "total", "square")],
    )


def _pairs(found: DataFrame, q: DataFrame, m: DataFrame, output_all: bool, condition: Column | None = None) -> DataFrame:
    if not output_all:
        return found.join(q, "query_id").join(m, "match_id")
    every = q.crossJoin(m)
    if condition is not None:
        every = every.filter(condition)
    return every.join(found, ["query_id", "match_id"], "left").na.fill(0, ["ov", "dot"])


def _measures(ani_columns: bool, abund: bool) -> dict[str, Column]:
    ov, q, m = F.col("ov"), F.col("q_n"), F.col("m_n")
    cq, cm = ratio(ov, q), ratio(ov, m)
    out = {
        "containment": cq,
        "max_containment": F.greatest(cq, cm),
        "jaccard": jaccard(ov, q, m),
        "average_containment": (cq + cm) / 2,
        "intersect_hashes": ov.cast("double"),
        "ksize": F.col("q_ksize_nt"),
        "scaled": F.col("q_scaled"),
        "moltype": F.col("q_moltype"),
        "cosine": F.when(F.col("q_with_abundance") & F.col("m_with_abundance"), angular(F.col("dot"), F.col("q_square"), F.col("m_square"))) if abund else F.lit(None).cast("double"),
    }
    if ani_columns:
        qa, ma = ani(cq, F.col("q_ksize")), ani(cm, F.col("q_ksize"))  # the k of the selection, not three times it
        out |= {"query_containment_ani": qa, "match_containment_ani": ma, "average_containment_ani": (qa + ma) / 2, "max_containment_ani": F.greatest(qa, ma)}
    return out


def _needed(columns: list[str]) -> set[str]:
    """The columns of :func:`blocks.overlaps` that give ``columns`` of a search."""
    own = {"ksize": ["q_ksize_nt"], "scaled": ["q_scaled"], "moltype": ["q_moltype"], "cosine": ["dot", *(f"{s}_{c}" for s in "qm" for c in ("with_abundance", "square"))]}
    return {"ov", "q_n", "m_n"} | {x for c in columns for x in own.get(c, ["q_ksize"] if c.endswith("_ani") else [c])}


IDENTITY = ["query_name", "query_md5", "match_name", "match_md5"]


def _given(rows: DataFrame, columns: dict[str, Column], keep_ids: bool, only: list[str] | None) -> DataFrame:
    ids = ["query_id", "match_id"] if keep_ids else []
    return rows.select(*[columns.get(c, F.col(c)).alias(c) for c in only or [*ids, *IDENTITY, *columns]])


def multisearch(queries: Sketches, against: Sketches, threshold: float = 0.01, scaled: int | None = None, ani: bool = False, prob: bool = False, output_all: bool = False, abund: bool = False, keep_ids: bool = False, by_blocks: bool = False, only: list[str] | None = None) -> DataFrame:
    """Every query against every match: rows whose containment of the query is above ``threshold`` (strictly).

    ``ani`` adds identity estimates, ``prob`` the overlap probability and TF-IDF columns, ``abund`` the angular similarity of abundances;
    ``output_all`` reports every pair.  Both sides are downsampled to the common ``scaled``.  ``only`` names the columns to give.
    """
    s = common_scaled(scaled, queries)
    q = queries.select(scaled=s)
    a = q if against is queries else against.select(scaled=s)
    rows = blocks.overlaps(q, a, threshold, dot=abund, columns=_needed(only) if only else None) if by_blocks and not (prob or output_all) else None
    if rows is None:
        rows = _pairs(overlaps(q.postings, a.postings, weights=significance.weights(q, a) if prob else None), _side(q, "query", "q"), _side(a, "match", "m"), output_all)
    columns = _measures(ani, abund)
    if not output_all:
        rows = rows.filter(columns["containment"] > threshold)
    if prob:
        rows = rows.na.fill(0.0, ["chance", "terms"])
        n = significance.comparisons(q, a)
        adjusted = F.col("chance") * F.lit(n)
        columns |= {
            "prob_overlap": F.col("chance"),
            "prob_overlap_adjusted": adjusted,
            "containment_adjusted": ratio(columns["containment"], adjusted),
            "containment_adjusted_log10": F.log10(F.nullif(ratio(columns["containment"], adjusted), F.lit(0.0))),
            "tf_idf_score": F.coalesce(ratio(F.col("terms"), F.col("q_square")), F.lit(0.0)),
        }
    return _given(rows, columns, keep_ids, only)


def pairwise(sketches: Sketches, threshold: float = 0.01, scaled: int | None = None, ani: bool = False, write_all: bool = False, output_all: bool = False, abund: bool = False, keep_ids: bool = False, by_blocks: bool = False, only: list[str] | None = None) -> DataFrame:
    """Unordered pairs of one collection: rows where either containment is above ``threshold``.

    ``write_all`` and ``output_all`` add a row of ones for each sketch with itself; ``output_all`` reports every pair.
    ``only`` names the columns to give.  A collection of fewer than two sketches is an error.
    """
    s = common_scaled(scaled, sketches)
    sk = sketches.select(scaled=s)
    if len(sk.manifest.limit(2).collect()) < 2:
        raise ValueError("pairwise requires two or more sketches")
    ordered = F.col("query_id") < F.col("match_id")
    q, m = _side(sk, "query", "q"), _side(sk, "match", "m")
    rows = blocks.overlaps(sk, sk, threshold, ordered=True, dot=abund, columns=_needed(only) if only else None) if by_blocks and not output_all else None
    if rows is None:
        rows = _pairs(overlaps(sk.postings, sk.postings, ordered), q, m, output_all, ordered)
    columns = _measures(ani, abund)
    if not output_all:
        rows = rows.filter((columns["containment"] > threshold) | (ratio(F.col("ov"), F.col("m_n")) > threshold))
    out = _given(rows, columns, keep_ids, only)
    if not (write_all or output_all):
        return out
    one = {name: F.lit(1.0) for name in columns} | {
        "intersect_hashes": F.col("q_n").cast("double"),
        "ksize": F.col("q_ksize_nt"),
        "scaled": F.col("q_scaled"),
        "moltype": F.col("q_moltype"),
        "cosine": F.lit(1.0) if abund else F.lit(None).cast("double"),
    }
    self_ids = [F.col("query_id"), F.col("query_id").alias("match_id")] if keep_ids else []
    own = q.select(*self_ids, "query_name", "query_md5", F.col("query_name").alias("match_name"), F.col("query_md5").alias("match_md5"), *[one[name].alias(name) for name in columns])
    return out.unionByName(own.select(*only) if only else own)


def manysearch(queries: Sketches, against: Sketches, threshold: float = 0.01, scaled: int | None = None, ignore_abundance: bool = False, output_all: bool = False, keep_ids: bool = False) -> DataFrame:
    """Containment of queries in (many, large) matches, with the match's abundances over what is shared.

    Rows whose containment of the query is above ``threshold``.  Abundance columns are null where the match has none
    or ``ignore_abundance`` is set.  Identity estimates use the match's nucleotide k.
    """
    s = common_scaled(scaled, queries)
    q, a = queries.select(scaled=s), against.select(scaled=s)
    found = overlaps(q.postings, a.postings, stats=not ignore_abundance)
    rows = _pairs(found, _side(q, "query", "q"), _side(a, "match", "m"), output_all)
    ov, cq, cm = F.col("ov"), ratio(F.col("ov"), F.col("q_n")), ratio(F.col("ov"), F.col("m_n"))
    if not output_all:
        rows = rows.filter(cq > threshold)
    tracked = F.col("m_with_abundance") & F.lit(not ignore_abundance)

    def weighted(c: Column | str, kind: str = "double") -> Column:
        return F.when(tracked, F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast(kind)) if not ignore_abundance else F.lit(None).cast(kind)

    qa, ma = ani(cq, F.col("m_ksize_nt")), ani(cm, F.col("m_ksize_nt"))
    columns = {
        "containment": cq,
        "intersect_hashes": ov,
        "ksize": F.col("m_ksize_nt"),
        "scaled": F.col("m_scaled"),
        "moltype": F.col("m_moltype"),
        "match_md5": F.col("match_md5"),
        "jaccard": jaccard(ov, F.col("q_n"), F.col("m_n")),
        "max_containment": F.greatest(cq, cm),
        "average_abund": weighted("average"),
        "median_abund": weighted("median"),
        "std_abund": weighted("std"),
        "query_containment_ani": qa,
        "match_containment_ani": ma,
        "average_containment_ani": (qa + ma) / 2,
        "max_containment_ani": F.greatest(qa, ma),
        "n_weighted_found": weighted("found", "bigint"),
        "total_weighted_hashes": weighted("m_total", "bigint"),
        "containment_target_in_query": cm,
        "f_weighted_target_in_query": weighted(ratio(F.coalesce(F.col("found"), F.lit(0)), F.col("m_total"))) if not ignore_abundance else F.lit(None).cast("double"),
    }
    ids = ["query_id", "match_id"] if keep_ids else []
    return rows.select(*ids, "query_name", "query_md5", "match_name", *[c.alias(name) for name, c in columns.items()])
