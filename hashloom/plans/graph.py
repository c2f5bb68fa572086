"""Connected components of an edge table.

Alternating star contraction: in each round every node points its larger neighbours at the
smallest node it knows (large star), then every node points its smaller neighbours and itself at
the smallest of them (small star).  The edge count never grows beyond the first symmetrised
table, the number of rounds is logarithmic in practice, and the minima are plain ``groupBy``
aggregates with map-side combination, so a hub with a third of all edges costs one row per map
task.  The join that spreads the minima deals the edges of such a hub to several tasks.

Each round is some ten shuffles, whose plans and tasks cost the driver time and memory however few edges there are.  So a table of
at most ``FEW`` edges, which are counted, is settled in numpy by one task; a larger one takes the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.plans.hot import join_salted
from hashloom.scratch import materialize, remove


FEW = 1 << 17  # edges that one task settles


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For all edges of a table one row ``(src, dst)`` for each node but the smallest of its component, which is ``dst``."""
    held = list(batches)
    if not held:
        return
    edges = pa.Table.from_batches(held)
    nodes = pc.unique(pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    x, y = (pc.index_in(edges[c], nodes).to_numpy() for c in ("src", "dst"))
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, higher := root[root]):
            root = higher
    low = np.flatnonzero(root != np.arange(len(nodes)))
    for at in range(0, len(low), 50_000):
        part = low[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(part)), nodes.take(pa.array(root[part]))], ["src", "dst"])


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = sym.groupBy("src").agg(F.min("dst").alias("low"), F.count(F.lit(1)).alias("n"))
    moved = join_salted(sym.filter("dst > src"), least.select("src", F.least("src", "low").alias("low")), "src", "dst", least.select("src", "n"))
    return moved.select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("low"), F.count(F.lit(1)).alias("n"))
    low = least.select("src", "low")
    moved = join_salted(edges, low, "src", "dst", least.select("src", "n")).filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(low.select("src", F.col("low").alias("dst"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("src", "dst")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of an edge, ``component`` being the smallest node reachable.

    Self loops give a component of their own node; repeated and reversed edges count once; edges with a
    null end are ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null")
    start, first = materialize(both.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    current, path = start.filter("src <> dst"), first
    mark = _mark(current)
    kind = dict(current.dtypes)["src"]
    if 0 < mark[0] <= FEW and kind in ("bigint", "int", "string"):
        current, _ = materialize(current.coalesce(1).mapInArrow(_settled, f"src {kind}, dst {kind}"), "stars")
        mark = (0,)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        nxt, nxt_path = materialize(_small_star(_large_star(current)), "stars")
        nxt_mark = _mark(nxt)
        if path != first:
            remove(spark, path)
        current, path = nxt, nxt_path
        if nxt_mark == mark:
            break
        mark = nxt_mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    alone = start.filter("src = dst").select(F.col("src").alias("node")).join(stars.select("node"), "node", "left_anti")
    roots = current.select(F.col("dst").alias("node")).distinct()
    return stars.unionByName(roots.unionByName(alone).distinct().select("node", F.col("node").alias("component")))
