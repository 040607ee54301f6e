"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are made in one pass over the texts, without a shuffle. Distinct fingerprints
are then sorted by Gray rank (neighbours in that order differ in few bits) and cut into
blocks. A block's index is a tree over its sorted fingerprints: each node stands for a run
of them and holds the bits they all share as a mask and a pattern. A search walks down
from the top and counts, in each node, the shared bits in which the query differs; a
child's mask holds its parent's, so the count only grows, and a node above the allowed
distance drops its whole group.

Before that, an exact sieve drops fingerprints that cannot link: with the bits cut into two
more fields than may differ, a linked pair agrees in two fields, so a fingerprint that
shares no pair of fields with another one is left out.

The same pruning deals queries to blocks: the tops of the blocks form the upper levels,
and a fingerprint visits only later blocks whose top it does not exceed. A block keeps a
union-find of what links, and passes on one edge for each member (to the smallest of its
local component), so a group of n copies costs n rows, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from ._graph import components, local_roots

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: Fingerprints in a block, leaves below a node, and children of a node.
BLOCK, LEAF, FANOUT = 1 << 15, 16, 8


def _fingerprints(data: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each row of text."""
    lower = data.copy()
    lower[(data >= 0x41) & (data <= 0x5A)] += 32
    starts, ends, first = C.word_spans(lower, offs)
    # All words joined by single spaces: a shingle is then one slice.
    width = ends - starts + 1
    end = np.cumsum(width)
    text = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    edge = np.zeros(len(lower) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    spots = np.ones(len(text), bool)
    spots[end - 1] = False
    text[spots] = lower[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    raw = text.tobytes()
    begin, stop = end - width, end - 1
    counts = np.diff(first)
    # First words of shingles: all but the last two of a row, or the first alone in a short row.
    row = np.repeat(np.arange(len(counts)), counts)
    last = np.repeat(first[1:], counts)
    i = np.arange(len(row))
    head = np.flatnonzero((i + size <= last) | (i == np.repeat(first[:-1], counts)))
    tail = np.minimum(head + size, last[head]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin[head].tolist(), stop[tail].tolist(), strict=True)), np.uint64, len(head))
    out = np.zeros(len(counts), np.uint64)
    if len(h):
        rows = row[head]
        some = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        n = np.diff(np.r_[some, len(h)])
        for k in range(0, len(some), 256):  # bits of some rows at a time
            a, b = some[k], len(h) if k + 256 >= len(some) else some[k + 256]
            bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, some[k : k + 256] - a, axis=0, dtype=np.int32)
            major = np.packbits(ones * 2 > n[k : k + 256, None], axis=1, bitorder="little")
            out[rows[some[k : k + 256]]] = major.reshape(-1).view(np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = C.text_buffer(batch.column(1))
            got = [_fingerprints(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size) for i, j in C.row_slices(offs, C.CHUNK_BYTES // 2)]
            fp = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in Gray-code order."""
    x = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A tree over fingerprints sorted by Gray rank; a node holds the mask and pattern of the bits its run shares."""

    def __init__(self, fps: np.ndarray, leaf: int = LEAF):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.leaf = leaf
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the bottom: mask, pattern
        cut = np.arange(0, len(self.fps), leaf)
        all_, any_ = np.bitwise_and.reduceat(self.fps, cut), np.bitwise_or.reduceat(self.fps, cut)
        while True:
            self.levels.append((~(all_ ^ any_), all_))
            if len(all_) == 1:
                break
            cut = np.arange(0, len(all_), FANOUT)
            all_, any_ = np.bitwise_and.reduceat(all_, cut), np.bitwise_or.reduceat(any_, cut)

    def top(self) -> tuple[np.uint64, np.uint64]:
        mask, pattern = self.levels[-1]
        return mask[0], pattern[0]

    def search(self, queries: np.ndarray, most: int, wide: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) indices within ``most`` bits, some at a time so that the arrays stay small."""
        step = max(1, min(len(queries), 1 << 12))
        for lo in range(0, len(queries), step):
            yield from self._down(np.arange(lo, min(lo + step, len(queries))), np.zeros(min(step, len(queries) - lo), np.int64), len(self.levels) - 1, queries, most, wide)

    def _down(self, q: np.ndarray, node: np.ndarray, level: int, queries: np.ndarray, most: int, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        mask, pattern = self.levels[level]
        near = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node]) <= most
        q, node = q[near], node[near]
        below = FANOUT if level else self.leaf
        for lo in range(0, len(q), max(1, wide // below)):
            a, b = q[lo : lo + wide // below], node[lo : lo + wide // below]
            child = (b[:, None] * below + np.arange(below)).reshape(-1)
            a = np.repeat(a, below)
            if level:
                ok = child < len(self.levels[level - 1][0])
                yield from self._down(a[ok], child[ok], level - 1, queries, most, wide)
            else:
                ok = child < len(self.fps)
                a, child = a[ok], child[ok]
                near = np.bitwise_count(queries[a] ^ self.fps[child]) <= most
                yield a[near], child[near]


def _link_block(fps: np.ndarray, guests: np.ndarray, most: int) -> pa.Table:
    """Edges from members and guests of a block to the smallest fingerprint of their local component."""
    index = GrayIndex(fps)
    own = index.fps
    both = np.concatenate([own, guests]) if len(guests) else own
    root = np.arange(len(both))
    for q, m in index.search(both, most):
        apart = q != m
        root = local_roots(root, q[apart], m[apart])
    moved = np.flatnonzero(root != np.arange(len(both)))
    return pa.table({"a": both[moved].view(np.int64), "b": both[root[moved]].view(np.int64)})


def near(distinct: DataFrame, most: int) -> DataFrame:
    """The fingerprints (column fp, distinct) that agree with another one in two of most + 2 fields."""
    fields = most + 2
    cuts = [64 * k // fields for k in range(fields + 1)]
    field = [F.shiftleft(F.shiftrightunsigned("fp", cuts[k]), 64 - cuts[k + 1] + cuts[k]) for k in range(fields)]
    keys = [F.xxhash64(field[i], field[j], F.lit(i * fields + j)) for i in range(fields) for j in range(i)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keyed.join(shared, "key").select("fp").distinct()


def links(distinct: DataFrame, most: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges a, b (fingerprints) whose components are those of all pairs within ``most`` bits; distinct: column fp."""
    spark = distinct.sparkSession
    distinct = C.written(near(distinct, most))
    n = distinct.count()
    parts = max(1, min(n // 256, max(C.partitions(spark), -(-n // block))))
    # Gray rank in SQL: a prefix xor of the bits; blocks are ranges of it (sign bit flipped: unsigned order).
    x = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    ranked = distinct.select("fp", x.bitwiseXOR(F.lit(-(2**63))).alias("rank"))
    cuts = sorted({int(c) for c in ranked.select(F.percentile_approx("rank", [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("c")).first().c or []}) if parts > 1 else []
    edges = np.array(cuts, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(edges, b.column("rank").to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(at)], ["fp", "block"])

    placed = ranked.mapInArrow(place, "fp long, block int")
    # The upper levels: what all fingerprints of a block share. One row for each block.
    tops = placed.groupBy("block").agg(F.expr("bit_and(fp)").alias("all"), F.expr("bit_or(fp)").alias("any")).collect()
    tops.sort(key=lambda r: r.block)
    ids = np.array([r.block for r in tops], np.int32)
    all_ = np.array([r["all"] for r in tops], np.int64).view(np.uint64)
    any_ = np.array([r["any"] for r in tops], np.int64).view(np.uint64)
    mask = ~(all_ ^ any_)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, at = b.column("fp").to_numpy().view(np.uint64), b.column("block").to_numpy()
            for lo in range(0, len(fp), 1 << 10):
                f, a = fp[lo : lo + (1 << 10)], at[lo : lo + (1 << 10)]
                later, who = [np.zeros(0, int)], [np.zeros(0, int)]
                for s in range(0, len(ids), 1 << 10):
                    near = (np.bitwise_count((f[:, None] ^ all_[s : s + 1024]) & mask[s : s + 1024]) <= most) & (ids[s : s + 1024] > a[:, None])
                    w, k = np.nonzero(near)
                    who.append(w)
                    later.append(k + s)
                w, k = np.concatenate(who), np.concatenate(later)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f, f[w]]).view(np.int64)), pa.array(np.concatenate([a, ids[k]]).astype(np.int32)), pa.array(np.arange(len(f) + len(w)) >= len(f))], ["fp", "block", "guest"])

    def link(table: pa.Table) -> pa.Table:
        fp, guest = table.column("fp").to_numpy().view(np.uint64), table.column("guest").to_numpy(zero_copy_only=False)
        return _link_block(fp[~guest], fp[guest], most)

    return placed.mapInArrow(deal, "fp long, block int, guest boolean").groupBy("block").applyInArrow(link, "a long, b long")


def cluster(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, most: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id reachable over links of at most ``most`` bits).

    Texts that are null or blank have fingerprint zero and link like any other. Rows that
    repeat a doc_id or a text fall into one component. A null doc_id stays null and never
    names a component unless all of its rows are null. Other columns are not read. An
    empty table gives an empty result.
    """
    fps = C.written(fingerprints(docs, text, doc_id, size))
    distinct = C.written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = C.written(links(distinct.select("fp"), most))
    of = components(edges, distinct)
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every whole text of ``documents``."""
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"))
