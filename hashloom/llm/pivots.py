"""Exact top-k inner-product search with a pivot table.

Integer vectors get one more coordinate, ``sqrt(R^2 - |x|^2)`` with R the largest norm of their block, and
queries a zero there; then the inner product is ``(|q|^2 + R^2 - d^2) / 2`` for the Euclidean distance d,
and nearest means largest.  A table holds each vector's distances to many pivots.  For a query the
triangle inequality gives a lower bound ``max |d(q, p) - d(x, p)|`` over the pivots, hence an upper bound of
the inner product.  Candidates are evaluated exactly, in the order of their bounds, until the next bound
cannot reach the k-th best score found so far.  Scores are integers and computed exactly.

Rows are packed into blocks without a shuffle.  Candidate blocks are dealt to lanes once; a lane, whose size is bounded, stays in its
task while the query blocks, a copy for each lane, pass through it: this is the stated query set against all rows, in blocks.
A query block's best scores are kept from block to block of the lane, so later blocks stop earlier, and k rows for each query leave the lane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashloom.scratch import materialize

LOW = -(1 << 63)
EXACT = 1 << 53


class Block:
    """Vectors of one dimension and their table of distances to the block's pivots; float64 arithmetic is exact below 2^53."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, table: np.ndarray, radius2: float):
        self.ids, self.x, self.pivots, self.table, self.radius2 = ids, vectors, pivots, table, radius2
        self.largest = float(np.abs(vectors).max(initial=0.0))


def pivot_table(vectors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Pivots, the vectors' distances to them, and the squared radius, with the extra coordinate in place."""
    square = (vectors * vectors).sum(axis=1)
    radius2 = float(square.max(initial=0.0))
    longer = np.concatenate([vectors, np.sqrt(np.maximum(radius2 - square, 0.0))[:, None]], axis=1)
    chosen = longer[spread(vectors, n)]
    return chosen, distances(longer, chosen), radius2


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows at even steps through the block ordered by its widest coordinate: a fixed choice that any data allow."""
    if not len(x) or not n:
        return np.zeros(0, np.int64)
    if not x.shape[1]:
        return np.zeros(1, np.int64)
    order = np.argsort(x[:, int(np.argmax(x.var(axis=0)))], kind="stable")
    return order[np.unique(np.linspace(0, len(x) - 1, min(n, len(x))).astype(np.int64))]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0.0))


def scores(block: Block, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact inner products with the rows ``at``, held to the range of a long."""
    if block.largest * np.abs(q).max(initial=0.0) * max(1, len(q)) < EXACT:
        return (block.x[at] @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([max(LOW, min(-LOW - 1, sum(int(v) * w for v, w in zip(row, whole, strict=True)))) for row in block.x[at]], np.int64)


def search_block(block: Block, qid: int, q: np.ndarray, dq: np.ndarray, best: list[tuple[int, int]], k: int, step: int = 64) -> list[tuple[int, int]]:
    """``best`` (score, -id) with the block's rows taken in; rows whose id is ``qid`` are left out."""
    whole = float(q @ q) + block.radius2
    if len(dq):
        bound = np.abs(block.table[:, 0] - dq[0])
        for p in range(1, len(dq)):
            np.maximum(bound, np.abs(block.table[:, p] - dq[p]), out=bound)
    else:
        bound = np.zeros(len(block.ids))
    upper = (whole - bound * bound) / 2 + 1e-6 * (1 + whole)  # rounding in distances, squared, stays below 2e-7 of the whole
    keep = np.flatnonzero(upper >= best[-1][0]) if len(best) == k else np.arange(len(upper))
    order = keep[np.argsort(-upper[keep], kind="stable")]
    at = 0
    while at < len(order):
        part = order[at : at + step]
        if len(best) == k and upper[part[0]] < best[-1][0]:
            break
        got, ids = scores(block, q, part), block.ids[part]
        use = ids != qid
        if len(best) == k:
            use &= got >= best[-1][0]
        got, ids = got[use], ids[use]
        top = np.lexsort((ids, -got))[:k]
        best = sorted(best + [(int(got[t]), -int(ids[t])) for t in top], reverse=True)[:k]
        at, step = at + len(part), min(4 * step, 4096)
    return best


def quantized(vec: Column, scale: int = 256) -> Column:
    """Components as ``floor(scale * x)``; null where the vector is null or holds null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vec.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _blocks(vectors: DataFrame, size: int, pivots: int = 0) -> DataFrame:
    """Rows packed where they are, at most ``size`` rows of one dimension to a block, with a pivot table if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        serial = TaskContext.get().partitionId() << 32

        def close(dim: int) -> pa.RecordBatch:
            nonlocal serial
            part = held.pop(dim)
            serial += 1
            ids, data = np.array([p[0] for p in part], "<i8"), np.array([p[1] for p in part], "<f8").reshape(len(part), dim)
            chosen, table, radius2 = pivot_table(data, pivots)
            values = [serial, dim, len(part), ids.tobytes(), data.tobytes(), chosen.tobytes(), table.tobytes(order="F"), radius2]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["block", "dim", "n", "ids", "data", "pivots", "table", "radius2"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield close(len(v))
        for dim in list(held):
            yield close(dim)

    return vectors.mapInArrow(run, "block long, dim long, n long, ids binary, data binary, pivots binary, table binary, radius2 double")


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, pivots: int = 32, block: int = 8192, query_block: int = 1024, lane_blocks: int = 8) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products for each query row against every other row.

    ``is_query`` is a condition on ``id_col``.  Ties go to the smaller id.  A row is no candidate of queries with its own id.  Vectors that
    are null or hold null or non-finite components, and null ids, take no part; vectors of different lengths have no product and are not
    compared; an empty vector scores 0 with other empty ones.  Repeated ids are searched each (a query id repeated with one vector counts once; with
    different vectors the k largest products of all of them are given).  Products beyond a long are
    held at its limits.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col).cast("long").alias(id_col), quantized(F.col(vec_col), scale).alias("v")).filter(F.col(id_col).isNotNull() & F.col("v").isNotNull())
    cand, _ = materialize(_blocks(usable, block, pivots), "candidates")
    query, _ = materialize(_blocks(usable.filter(is_query).dropDuplicates([id_col, "v"]).coalesce(max(1, spark.sparkContext.defaultParallelism)), query_block), "queries")
    cores, blocks = spark.sparkContext.defaultParallelism, cand.count()
    lanes = max(1, min(cores, blocks), -(-blocks // lane_blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane")
    columns = ["dim", "n", "ids", "data", "pivots", "table", "radius2"]
    # lanes of even size: the blocks, one row for many vectors each, are numbered in order
    numbers = cand.select("block", (F.row_number().over(Window.orderBy("block")) % lanes).cast("long").alias("lane"))
    dealt = cand.join(numbers, "block").select("lane", F.lit(0).alias("kind"), "block", *columns)
    asked = query.select(every, F.lit(1).alias("kind"), "block", *columns)
    # a task has whole lanes: each lane's candidate blocks come first, then all query blocks
    met = dealt.unionByName(asked).repartition(4 * lanes, "lane").sortWithinPartitions("lane", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, held = None, {}
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(j)[r].as_py() for j, n in enumerate(b.schema.names)}
                if row["lane"] != lane:
                    lane, held = row["lane"], {}
                dim, ids = row["dim"], np.frombuffer(row["ids"], "<i8")
                data = np.frombuffer(row["data"], "<f8").reshape(row["n"], dim)
                if not row["kind"]:
                    marks = np.frombuffer(row["pivots"], "<f8").reshape(-1, dim + 1)
                    held.setdefault(dim, []).append(Block(ids, data, marks, np.frombuffer(row["table"], "<f8").reshape(row["n"], len(marks), order="F"), row["radius2"]))
                    continue
                best: list[list[tuple[int, int]]] = [[] for _ in ids]
                longer = np.concatenate([data, np.zeros((len(data), 1))], axis=1)
                for c in held.get(dim, []):
                    to_pivots = distances(longer, c.pivots)
                    best = [search_block(c, int(i), data[j], to_pivots[j], best[j], k) for j, i in enumerate(ids)]
                flat = [(int(i), s, -v) for i, found in zip(ids, best, strict=True) for s, v in found]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], pa.int64()) for j in range(3)], ["query_id", "score", "vec_id"])

    found = met.select("lane", "kind", *columns).mapInArrow(run, "query_id long, score long, vec_id long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
           where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
p as (select q.vec_id query_id, c.vec_id vec_id, cast(list_dot_product(q.e, c.e) as bigint) score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5"""
