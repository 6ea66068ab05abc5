"""Connected components of an edge table by alternating large-star and small-star steps.

The published two-step contraction (Kiveris et al., 2014), phrased as minima and equi-joins: no
adjacency list is ever gathered, so a vertex with a third of all edges costs a partial aggregate
and a join whose hot side Spark can split.

A graph that was counted to be small is joined by one task instead of rounds of many small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import cut, dealt_anew, fewer, narrow, worth

MAX_ROUNDS = 60
#: Edges from which on a vertex with a third of them is worth the exchanges that split it.
SPLIT_EDGES = 2_000_000
#: Edges up to which one task joins the whole graph; it holds about a hundred bytes for each.
LOCAL_EDGES = 500_000


def _smallest(pairs: DataFrame) -> DataFrame:
    """For pairs (u, v) the least of v and of u itself for each u."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges (u, v) that one task is given.

    Each root that has a smaller neighbour is tied to one, and all paths are shortened, until no
    edge leads to another root; two rounds leave at most half of the roots that have neighbours.
    """
    ends = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches if batch.num_rows]
    if not ends:
        return
    ids, at = np.unique(np.concatenate(ends, 1), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(ids))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root != (up := root[root])).any():
            root = up
        u, v = root[u], root[v]
        u, v = u[far := u != v], v[far]
    yield pa.record_batch([pa.array(ids), pa.array(ids[root])], ["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has an edge; component is the smallest id reachable.

    Edges may be repeated, reversed or loops; rows with a null end are ignored.  An empty table
    gives an empty result.
    """
    now = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    rows = edges.count()
    if rows <= LOCAL_EDGES:
        return cut(cut(now, worth(rows)).coalesce(1).mapInArrow(narrow(_joined), "id long, component long"))
    now = cut(now.distinct(), worth(rows))
    state = None
    split = dealt_anew if rows > SPLIT_EDGES else lambda side: side
    for _ in range(MAX_ROUNDS):
        tasks = worth(2 * rows)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of u is tied to u's smallest neighbour.
        large = both.join(split(_smallest(both)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = fewer(large, tasks)
        # Small star: u and all its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(split(low), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = cut(fewer(small.select("e.u", "e.v").where("u > v"), tasks).distinct(), tasks)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state, rows = seen, seen[0]
    else:
        raise RuntimeError("the components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return cut(stars.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), worth(2 * rows))
