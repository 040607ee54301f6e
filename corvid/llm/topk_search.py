"""Exact top-k inner products with a bit-sliced index.

Vectors are dealt into blocks. A block holds its quantised attributes bit by bit: slice j
of attribute d is a bitmap with one bit for each row. For a query, every attribute is
weighed by the query's own value: a set bit i of that value adds the attribute's slices,
i places higher, so the scores of all rows are summed by full adders on whole bitmaps
(three slices of a place become one and a carry). A negative value adds complements.

The lowest slices of the attributes are left out of the sums. From the most significant
slice of the sum downward the k-th best sum is found; rows that could still reach it, given
what the missing slices can add, form the boundary, and only they are scored exactly.
Queries are sent to every block; each block answers with its k best rows and the best of
these are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

K, SCALE, EVERY = 5, 256, 50
#: Rows of a block at most and at least; slices that sums leave out; queries that a block answers in one task, about.
LARGE, SMALL, DROPPED, ASKED = 1 << 15, 1 << 11, 2, 1 << 16


class BitSlicedIndex:
    """Bit slices of integer attributes (rows x attributes)."""

    def __init__(self, codes: np.ndarray, dropped: int = DROPPED):
        self.codes, self.n = codes, len(codes)
        self.low = codes.min(axis=0)
        raised = (codes - self.low).astype(np.uint64)
        self.bits = max(1, int(raised.max()).bit_length())
        self.dropped = min(dropped, self.bits - 1)
        words = -(-self.n // 64)
        self.slices = np.zeros((codes.shape[1], self.bits - self.dropped, words * 8), np.uint8)
        for j in range(self.dropped, self.bits):
            packed = np.packbits(((raised >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little").T
            self.slices[:, j - self.dropped, : packed.shape[1]] = packed
        self.slices = self.slices.view(np.uint64)
        self.rows = self._bitmap(np.ones(self.n, bool))

    def _bitmap(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(-(-self.n // 64) * 8, np.uint8)
        packed = np.packbits(rows, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the weighted sum of all rows, without the dropped slices."""
        size = np.abs(weights)
        place: list[list[np.ndarray]] = []
        high = self.bits - self.dropped
        for i in range(int(size.max(initial=0)).bit_length()):
            some = np.flatnonzero((size >> i) & 1)
            part = self.slices[some]
            part[weights[some] < 0] ^= np.uint64(0xFFFFFFFFFFFFFFFF)
            for j in range(high):
                while len(place) <= i + j:
                    place.append([])
                place[i + j].append(part[:, j])
        out, at = [], 0
        while at < len(place):
            held = np.concatenate(place[at]) if place[at] else np.zeros((0, len(self.rows)), np.uint64)
            while len(held) > 1:
                three = len(held) // 3 * 3
                if three:
                    a, b, c = held[:three:3], held[1:three:3], held[2:three:3]
                    ab = a ^ b
                    kept, carry = ab ^ c, (a & b) | (ab & c)
                    held = np.concatenate([kept, held[three:]])
                else:
                    carry = (held[0] & held[1])[None]
                    held = (held[0] ^ held[1])[None]
                if len(place) <= at + 1:
                    place.append([])
                place[at + 1].append(carry)
            out.append(held[0] if len(held) else np.zeros(len(self.rows), np.uint64))
            at += 1
        return out

    def top(self, weights: np.ndarray, k: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) among which the k best are, ties included; ``but``: rows left out."""
        able = self.rows if but is None else self.rows & ~self._bitmap(but)
        if int(np.bitwise_count(able).sum()) > k:
            slices = self.sums(weights)
            # The k-th best sum, from the most significant slice downward.
            sure, open_, kth = np.zeros_like(able), able, 0
            for i in range(len(slices) - 1, -1, -1):
                more = sure | (open_ & slices[i])
                if int(np.bitwise_count(more).sum()) >= k:
                    open_, kth = open_ & slices[i], kth | (1 << i)
                else:
                    sure, open_ = more, open_ & ~slices[i]
            # The boundary: rows that reach it with what the dropped slices can add.
            reach = max(0, kth - int(np.abs(weights).sum()) * ((1 << self.dropped) - 1) // (1 << self.dropped))
            above, equal = np.zeros_like(able), able
            for i in range(len(slices) - 1, -1, -1):
                if reach >> i & 1:
                    equal = equal & slices[i]
                else:
                    above, equal = above | (equal & slices[i]), equal & ~slices[i]
            able = above | equal
        rows = np.flatnonzero(np.unpackbits(able.view(np.uint8), bitorder="little")[: self.n])
        return rows, self.codes[rows] @ weights


def _codes(table: pa.Table, width: int) -> np.ndarray:
    x = table.column("x").combine_chunks()
    x = x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)
    return np.floor(SCALE * x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, width)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``every``, the k others with the highest scores.

    A score is the inner product of the components' floor(256 x); ties go to the smaller
    vec_id. Vectors that are null or empty, or hold null or non-finite components, take no
    part, nor does a null vec_id; zero vectors do. Only vectors with as many components
    meet. A row that repeats both vec_id and vector counts once, as query and as candidate;
    other rows with the query's vec_id are no candidates. Components must keep |256 x| under 2^28, so that
    scores fit 64 bits. Other columns are not read. An empty table gives an empty result.
    """
    x = F.col("x")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x")).where("vec_id is not null and x is not null and size(x) > 0").where(fine).dropDuplicates()
    base = C.written(base.withColumn("width", F.size("x")))
    out = None
    for r in base.groupBy("width").agg(F.count("*").alias("n")).collect():
        found = _search(base.where(F.col("width") == r.width), r.width, r.n, k, every)
        out = found if out is None else out.union(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(base: DataFrame, width: int, n: int, k: int, every: int) -> DataFrame:
    blocks = max(-(-n // LARGE), min(C.partitions(base.sparkSession), -(-n // SMALL)))
    batches = max(1, -(-n // (every * ASKED)))
    batch = F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")
    placed = base.select(F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int").alias("block"), batch, "vec_id", "x")
    asked = base.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(batches)).cast("int").alias("batch"), "vec_id", "x")

    def answer(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("vec_id")
            ids = rows.column("vec_id").to_numpy()
            index = BitSlicedIndex(_codes(rows, width))
            for q, weights in zip(queries.column("vec_id").to_pylist(), _codes(queries, width), strict=True):
                lo, hi = np.searchsorted(ids, [q, q + 1])
                own = None
                if hi > lo:
                    own = np.zeros(len(ids), bool)
                    own[lo:hi] = True
                at, score = index.top(weights, k, own)
                best = np.lexsort((ids[at], -score))[:k]
                for held, x in zip(out, (np.full(len(best), q), ids[at[best]], score[best]), strict=True):
                    held.append(x)
        return pa.table({name: np.concatenate(x).astype(np.int64) for name, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return placed.groupBy("block", "batch").cogroup(asked.groupBy("block", "batch")).applyInArrow(answer, "query_id long, vec_id long, score long")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all of ``embeddings``."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB's form of the query.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
