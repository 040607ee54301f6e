"""Near copies by the similarity of their word shingles, for the corpus pipeline.

Two texts link where the sets of their five-word shingles have a Jaccard similarity of 0.8
or more, compared in whole numbers on the sets themselves. Pairs to compare are proposed by
minhash: 24 bands of 4; a pair at exactly 0.8 is missed with a chance of (1 - 0.8^4)^24, or
3 in a million, more similar ones less often.

Texts with the same set are one node. Members of a bucket are first compared with its
smallest one. Where a bucket still holds several components, all nodes that are tied by such
buckets form a block and all its pairs are compared: large blocks are dealt to tiles, and
pairs of tiles meet. Tasks emit one edge for each linked node, never pairs.

Links of op5 (3-word fingerprints within 2 bits) count as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import simhash_dedup
from ._graph import local_roots, stars

#: Words of a shingle; bands and minima in each.
SIZE, BANDS, ROWS = 5, 24, 4
#: Nodes and shingles in a tile, about; members that meet a bucket's smallest node in one group.
TILE, TILE_SHINGLES, STAR = 256, 1 << 18, 1024
#: Bytes of sketches whose rows go to one file.
ROWS_OF = 128 << 20
#: A shingle is a hash of so many bytes.
BYTES = 5

_RNG = np.random.Generator(np.random.PCG64(50_808))
_FLIP, _ODD, _PLACE = (_RNG.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, SIZE))


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, one row after the other, and the row offsets. A row of fewer words has one of all."""
    lower = data.copy()
    lower[(data >= 0x41) & (data <= 0x5A)] += 32
    starts, ends, first = C.word_spans(lower, offs)
    words = C.word_hashes(lower, starts, ends)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    i = np.arange(len(row))
    head = np.flatnonzero((i + SIZE <= first[row + 1]) | (i == first[row]))
    h = np.zeros(len(head), np.uint64)
    for k in range(SIZE):
        ok = head + k < first[row[head] + 1]
        h[ok] += words[head[ok] + k] * _PLACE[k]
    key = np.unique((row[head].astype(np.uint64) << np.uint64(8 * BYTES)) | (C.mix(h) >> np.uint64(64 - 8 * BYTES)))
    at = np.searchsorted(key >> np.uint64(8 * BYTES), np.arange(len(offs), dtype=np.uint64))
    return key & np.uint64((1 << 8 * BYTES) - 1), at


def _sketch(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each set, and the keys of its bands (only of sets that are not empty)."""
    node = np.zeros(len(at) - 1, np.int64)
    some = np.flatnonzero(np.diff(at))
    keys = np.zeros((len(some), BANDS), np.uint64)
    if len(some):
        h, cut = C.mix(sets), at[some]
        node[some] = C.mix(np.add.reduceat(C.mix(h), cut) + np.diff(at)[some].astype(np.uint64)).view(np.int64)
        for k in range(BANDS * ROWS):
            keys[:, k // ROWS] = C.mix(keys[:, k // ROWS] + np.minimum.reduceat((h ^ _FLIP[k]) * _ODD[k], cut) + np.uint64(k))
    return node, keys.view(np.int64)


def sketches(docs: DataFrame, text: str, doc_id: str, row: str) -> DataFrame:
    """doc_id, row, fp (op5's), node (a hash of the set), n (its size), keys of its bands, shingles (the set) of each row."""
    names = ["doc_id", "row", "fp", "node", "n", "keys", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = C.text_buffer(batch.column(2))
            for i, j in C.row_slices(offs, C.CHUNK_BYTES // 2):
                part, cut = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                fp = simhash_dedup._fingerprints(part, cut, simhash_dedup.SHINGLE).view(np.int64)
                sets, at = shingles(part, cut)
                node, keys = _sketch(sets, at)
                n = np.diff(at)
                raw = np.ascontiguousarray(sets.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES])
                held = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * BYTES).astype("<i4").tobytes()), pa.py_buffer(raw.tobytes())])
                bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((n > 0) * BANDS)].astype(np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(fp), pa.array(node), pa.array(n.astype(np.int64)), bands, held], names)

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, row long, fp long, node long, n long, keys array<long>, shingles binary")


def _compare(node: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one group: nodes of side 0 or 2 meet those of side 1 or 2."""
    n = np.array([len(x) for x in sets])
    at = np.r_[0, np.cumsum(n)]
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    right = np.flatnonzero(side >= 1)
    of = ids[np.repeat(side >= 1, n)]
    cut = np.r_[0, np.cumsum(n[right])][:-1]
    mark, root = np.zeros(len(distinct), bool), np.arange(len(node))
    for i in np.flatnonzero(side != 1).tolist():
        own = ids[at[i] : at[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[of], cut, dtype=np.int64)
        mark[own] = False
        # both / (n + n' - both) >= 4 / 5
        near = right[both * 9 >= (n[i] + n[right]) * 4]
        root = local_roots(root, np.full(len(near), i), near)
    moved = np.flatnonzero(root != np.arange(len(node)))
    return node[moved], node[root[moved]]


def verify(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges a, b of the groups (block, part, other) of asked, which has node, n and side besides; sets: node, shingles."""
    spark = asked.sparkSession
    size = asked.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    bins = max(1, -(-size.rows // 4096), -(-(size.n or 0) // (4 * TILE_SHINGLES)), min(C.partitions(spark), size.rows // 64))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("block", "part", "other", "node")])
        block, part, other, node, side = (table.column(c).to_numpy() for c in ("block", "part", "other", "node", "side"))
        raw = table.column("shingles").to_pylist()
        new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (other[1:] != other[:-1])])
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(node)], strict=True):
            if (side[lo:hi] != 1).any() and (side[lo:hi] >= 1).any():
                sets_ = []
                for x in raw[lo:hi]:
                    wide = np.zeros((len(x) // BYTES, 8), np.uint8)
                    wide[:, :BYTES] = np.frombuffer(x, np.uint8).reshape(-1, BYTES)
                    sets_.append(wide.view("<u8").reshape(-1))
                for held, x in zip(out, _compare(node[lo:hi], side[lo:hi], sets_), strict=True):
                    held.append(x)
        return pa.table({"a": np.concatenate(out[0]), "b": np.concatenate(out[1])})

    dealt = asked.withColumn("bin", F.pmod(F.xxhash64("block", "part", "other"), F.lit(bins)).cast("int"))
    return dealt.join(sets, "node").groupBy("bin").applyInArrow(run, "a long, b long")


def _star(members: DataFrame) -> DataFrame:
    """asked: each member of a bucket meets its smallest node."""
    pairs = members.where("node <> low").select("low", "low_n", "node", "n").distinct()
    sizes = pairs.groupBy("low", "low_n").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    there = pairs.join(sizes.drop("low_n"), "low").select(F.col("low").alias("block"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(0).alias("other"), "node", "n", F.lit(1).alias("side"))
    low = sizes.select(F.col("low").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("other"), F.col("low").alias("node"), F.col("low_n").alias("n"), F.lit(0).alias("side"))
    return there.union(low)


def _tiles(members: DataFrame) -> DataFrame:
    """asked: all pairs of the nodes that are tied by buckets."""
    tied = stars(members.select(F.col("node").alias("a"), F.col("low").alias("b")))
    nodes = members.select("node", "n").distinct().join(tied.withColumnsRenamed({"a": "node", "b": "block"}), "node", "left").withColumn("block", F.coalesce("block", "node"))
    sizes = nodes.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    placed = nodes.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    met = placed.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1)
    return met.select("block", F.least("own", "met").alias("part"), F.greatest("own", "met").alias("other"), "node", "n", side.alias("side"))


def _named(of: DataFrame, edges: DataFrame) -> DataFrame:
    """of (node, label) with its labels joined along edges a, b of nodes; both are used up."""
    a, b = of.withColumnsRenamed({"node": "a", "label": "x"}), of.withColumnsRenamed({"node": "b", "label": "y"})
    tied = stars(edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = C.written(of.join(tied.withColumnsRenamed({"a": "label", "b": "to"}), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    C.used_up(of, edges, tied)
    return out


def _open(members: DataFrame, of: DataFrame) -> DataFrame:
    """The members (used up) of buckets with nodes of several labels, each with the bucket's smallest node."""
    named = members.join(of, "node")
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min(F.struct("node", "n")).alias("low")).where("x <> y")
    out = C.written(members.select("node", "n", "key").join(mixed.select("key", F.col("low.node").alias("low"), F.col("low.n").alias("low_n")), "key"))
    C.used_up(members)
    return out


def cluster(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str = "row") -> DataFrame:
    """doc_id, row and component (a number) of each row; row: a hash of the whole row, which tells rows apart that share a doc_id.

    Words and case are op5's. Texts without words are copies of each other.
    """
    made = C.written(sketches(docs, text, doc_id, row))
    # A few bytes of each row: one task for each ROWS_OF bytes of made, or there are as many tiny files as splits.
    rows = C.written(made.select("doc_id", "row", "node").coalesce(max(1, -(-C.plan_bytes(made) // ROWS_OF))))
    # Labels: op5's components, by their smallest fingerprint.
    edges = C.written(simhash_dedup.links(made.select("fp").distinct(), simhash_dedup.DISTANCE))
    near = stars(edges)
    pairs = C.written(made.select("node", "fp").distinct().join(near.withColumnsRenamed({"a": "fp", "b": "to"}), "fp", "left").select("node", F.coalesce("to", "fp").alias("label")).distinct())
    C.used_up(edges, near)
    least = pairs.groupBy("node").agg(F.min("label").alias("low"))
    same = stars(pairs.join(least, "node").select(F.col("label").alias("a"), F.col("low").alias("b")))
    of = C.written(least.join(same.withColumnsRenamed({"a": "low", "b": "to"}), "low", "left").select("node", F.coalesce("to", "low").alias("label")))
    C.used_up(pairs, same)
    # Buckets of two or more nodes: their smallest and largest node differ.
    keyed = made.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
    # Few bytes are left of each partition, here and of edges: rebalanced, or each writes a tiny file.
    members = _open(C.written(keyed.join(shared, "key").select("node", "n", "key").distinct().hint("rebalance")), of)
    # The sets of their nodes, each from the row with the smallest hash.
    one = made.select("node", "row").join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    one = C.written(one)
    sets = C.written(C.sieved(made.select("node", "row", "shingles"), one, "row").join(one, ["node", "row"], "left_semi").select("node", "shingles").dropDuplicates(["node"]))
    C.used_up(one)
    C.used_up(made)
    of = _named(of, C.written(verify(_star(members), sets).hint("rebalance")))
    members = _open(members, of)
    asked = C.written(_tiles(members))
    of = _named(of, C.written(verify(asked, sets).hint("rebalance")))
    C.used_up(members, asked, sets)
    return rows.join(of, "node").select("doc_id", "row", F.col("label").alias("component"))
