"""Connected components: of pairs in memory, and of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def local_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (index of each item's smallest known member, fully compressed) after joining the pairs a, b."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


#: Edges that one task joins at once: a few MB. More take the rounds.
AT_ONCE = 1 << 17


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: each node but the smallest of its component, with that one; of all edges in one task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])


def _low(edges: DataFrame, at: str, to: str) -> DataFrame:
    """For each node in column at, the smallest of itself and its partners. The minimum is taken before the shuffle."""
    return edges.groupBy(F.col(at).alias("u")).agg(F.least(F.min(to), F.first(at)).alias("m"))


def stars(edges: DataFrame) -> DataFrame:
    """a, b: each node of edges (columns a, b) but the smallest of its component, with that smallest one.

    Large stars tie a node's larger neighbours to its smallest one, small stars tie its
    smaller neighbours there; alternated, they leave one star for each component after
    O(log^2 n) rounds. Only minima (pre-aggregated) and joins run, so a node with very many
    neighbours gathers nowhere; each round is written to the shared folder. At most AT_ONCE
    edges are joined in one task instead, with the same result.
    """
    now = C.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or (state.n, state.h) == seen:
            return now
        if state.n <= AT_ONCE:
            before, now = now, C.written(now.coalesce(1).mapInArrow(_joined, "a long, b long"))
            C.used_up(before)
            return now
        seen = (state.n, state.h)
        both = now.union(now.select("b", "a"))
        large = both.withColumnRenamed("a", "u").join(_low(both, "a", "b"), "u").where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = _low(large, "a", "b")
        small = large.withColumnRenamed("a", "u").join(low, "u").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, C.written(small.union(low.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        C.used_up(before)


def components(edges: DataFrame, nodes: DataFrame, key: str = "fp", low: str = "low") -> DataFrame:
    """nodes (key, low) with low replaced by the smallest one of the node's component; nodes without an edge keep theirs."""
    tied = stars(edges)
    of = tied.select(F.col("a").alias(key), F.col("b").alias("root")).union(tied.select(F.col("b").alias(key), F.col("b").alias("root")).distinct())
    of = C.written(of.join(nodes.select(key, low), key))
    C.used_up(tied)
    least = of.groupBy("root").agg(F.min(low).alias("least"))
    named = of.join(least, "root").select(key, "least")
    return nodes.join(named, key, "left").select(key, F.coalesce("least", low).alias(low))
