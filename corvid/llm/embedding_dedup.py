"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

1. Exact copies (same label, same components) become one vector with a count.
2. A hash turns a vector by three rounds of random signs and a fast Hadamard transform and
   takes its largest coordinate, with its sign, as the code: the nearest corner of the
   cross-polytope. A bucket is a table's codes of several hashes together; multiprobe adds
   the buckets with the runner-up corner in one hash, nearest first.
3. Buckets of many vectors are cut into tiles, and each pair of tiles meets in one task, so
   a bucket with a third of all vectors is spread over many tasks.
4. All candidates are verified by cosine in double precision; a pair that meets in several
   buckets counts only in the first that both are in. A task keeps counts of links and a
   union-find, never pairs: it passes on one row for each vector that links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from ._graph import components, local_roots

#: Least cosine of a link.
LEAST = 0.98
#: Tables; buckets that a vector is in, in each; vectors in a tile of a large bucket.
TABLES, PROBES, TILE = 8, 4, 256
#: Pairs that a task joins at a time, and rows of tiles that it holds.
PAIRS, HELD = 1 << 18, 1 << 16
SEED = 97


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each column; the height is a power of two."""
    d, n = x.shape
    h = 1
    while h < d:
        y = x.reshape(d // (2 * h), 2, h, n)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(d, n)
        h *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, hashes: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """rows x tables x probes: bucket codes of unit vectors, the nearest first; each row's codes in a table differ."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((width, len(x)))  # a vector is a column: all steps run along rows
    padded[: x.shape[1]] = x.T
    rng = np.random.Generator(np.random.PCG64(SEED))
    out = np.zeros((len(x), tables, probes), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        first, second, loss = [], [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width)[:, None])
            size = np.abs(y)
            a = size.argmax(axis=0)
            top = size[a, rows]
            size[a, rows] = -1
            b = size.argmax(axis=0)
            code = lambda k, y=y: 2 * k + (y[k, rows] < 0)
            first.append(code(a))
            second.append(code(b))
            loss.append(top - size[b, rows])
        # Probe 0 is the nearest corner of all hashes; others change the hashes with the least loss, one or two at a time.
        changes = [(0,) * hashes] + [tuple(int(i == k) for i in range(hashes)) for k in range(hashes)] + [tuple(int(i in (j, k)) for i in range(hashes)) for k in range(hashes) for j in range(k)]
        cost = np.stack([sum((np.where(c, gap, 0.0) for c, gap in zip(change, loss, strict=True)), np.zeros(len(x))) for change in changes], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        choice = np.array(changes)
        for p in range(probes):
            picked = choice[order[:, min(p, order.shape[1] - 1)]]
            total = np.zeros(len(x), np.int64)
            for i in range(hashes):
                total = total * (2 * width) + np.where(picked[:, i], second[i], first[i])
            out[:, t, p] = total
    return out


def _valid(column: str) -> F.Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _first_shared(codes_a: np.ndarray, codes_b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """a x b: whether this bucket is the first, in order of tables and then codes, that both are in."""
    before = np.zeros((len(codes_a), len(codes_b)), bool)
    for t in range(table + 1):
        for p in range(codes_a.shape[2]):
            for q in range(codes_b.shape[2]):
                same = codes_a[:, t, p][:, None] == codes_b[:, t, q][None, :]
                before |= same if t < table else same & (codes_a[:, t, p] < bucket)[:, None]
    return ~before


class _Links:
    """Link counts and local components of the vectors that a task sees."""

    def __init__(self, keys: np.ndarray, copies: np.ndarray):
        self.keys, one, self.back = np.unique(keys, return_index=True, return_inverse=True)
        self.copies = copies[one]
        self.count = np.zeros(len(self.keys), np.int64)
        self.root = np.arange(len(self.keys))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.pairs = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of row numbers; many are joined at a time."""
        self.held.append((self.back[a], self.back[b]))
        self.pairs += len(a)
        if self.pairs >= PAIRS:
            self._join()

    def _join(self) -> None:
        if self.pairs:
            a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
            np.add.at(self.count, a, self.copies[b])
            np.add.at(self.count, b, self.copies[a])
            self.root = local_roots(self.root, a, b)
        self.held, self.pairs = [], 0

    def batch(self) -> pa.RecordBatch:
        self._join()
        some = np.flatnonzero(self.count)
        return pa.RecordBatch.from_arrays([pa.array(self.keys[some]), pa.array(self.count[some]), pa.array(self.keys[self.root[some]])], ["key", "links", "root"])


def _verify(batches: Iterator[pa.RecordBatch], width: int, least: float, hashes: int, tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    """The tile pairs of a partition that is sorted by them, some whole ones at a time: links of each vector."""
    for t in C.groups(batches, "met", HELD):
        yield from _verify_some(t.combine_chunks(), width, least, hashes, tables, probes)


def _verify_some(t: pa.Table, width: int, least: float, hashes: int, tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    col = lambda n: t.column(n).to_numpy()
    bucket, one, two, mine = col("bucket"), col("one"), col("two"), col("mine")
    tile = np.lexsort((mine, two, one, bucket, col("table_"), col("label")))
    t = t.take(pa.array(tile))
    label, table, bucket, one, two, mine, keys = (col(n) for n in ("label", "table_", "bucket", "one", "two", "mine", "key"))
    unit = _unit(_matrix(t.column("x").combine_chunks() if t.column("x").num_chunks > 1 else t.column("x").chunk(0), width))
    found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    cut = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (table[1:] != table[:-1]) | (bucket[1:] != bucket[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    for lo, hi in zip(cut.tolist(), np.r_[cut[1:], len(keys)].tolist(), strict=True):
        if hi - lo < 2:
            continue
        if one[lo] == two[lo]:
            a = b = np.arange(lo, hi)
        else:
            a, b = lo + np.flatnonzero(mine[lo:hi] == one[lo]), lo + np.flatnonzero(mine[lo:hi] == two[lo])
        near = unit[a] @ unit[b].T >= least
        if one[lo] == two[lo]:
            near = np.triu(near, 1)
        i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if len(i):
            found.append((lo, a[i], b[j], near[np.ix_(i, j)]))
    # Only vectors that are near another one need all their buckets, to count each pair once.
    links = _Links(keys, col("copies"))
    some = np.unique(np.concatenate([links.back[x] for f in found for x in f[1:3]])) if found else np.zeros(0, int)
    one_row = np.zeros(len(links.keys), np.int64)
    one_row[links.back] = np.arange(len(keys))
    codes = buckets(unit[one_row[some]], hashes, tables, probes)
    for lo, a, b, near in found:
        ca, cb = (codes[np.searchsorted(some, links.back[x])] for x in (a, b))
        x, y = np.nonzero(near & _first_shared(ca, cb, int(table[lo]), int(bucket[lo])))
        links.add(a[x], b[y])
    yield links.batch()


def deduplicate(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST, tables: int = TABLES, probes: int = PROBES, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Links join vectors with equal non-null labels, as many components and a cosine of at
    least ``least``. Null, empty and zero vectors, and those with null or non-finite
    components, link with nothing: 0 links, a component of their own, kept. Rows that
    repeat a vec_id are separate vectors under one name. A row with a null vec_id counts
    as a link of others but names no component unless it stands alone; its kept is null.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x"), F.col(label).alias("label"))
    able = F.coalesce(F.col("label").isNotNull() & _valid("x"), F.lit(False))
    # One row for each distinct vector; its key is fixed by being written.
    classes = base.where(able).groupBy("label", "x").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = C.written(classes.withColumn("key", F.monotonically_increasing_id()).withColumn("width", F.size("x")))
    found = [_links_of(classes.where(F.col("width") == r.width), r.width, r.n, least, tables, probes, tile) for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()]
    out = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found:
        links = found[0]
        for more in found[1:]:
            links = links.union(more)
        links = C.written(links)
        low = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")), classes.select("key", "low"), "key", "low")
        named = classes.select("key", "label", "x", "copies").join(low, "key").join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
        named = named.select(F.col("label").alias("l"), F.col("x").alias("y"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "low")
        joined = base.withColumn("able", able).join(named, F.col("able") & (F.col("label") == F.col("l")) & (F.col("x") == F.col("y")), "left")
        out = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links_of(classes: DataFrame, width: int, n: int, least: float, tables: int, probes: int, tile: int) -> DataFrame:
    """key, links, root of the distinct vectors of one width that link."""
    corners = 2 << max(1, (width - 1).bit_length())
    hashes = max(1, min(4, round(np.log(max(n, 2)) / np.log(corners))))  # about as many buckets as vectors
    slim = classes.select("key", "x", F.xxhash64("label").alias("label"), "copies")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = buckets(_unit(_matrix(b.column("x"), width)), hashes, tables, probes)
            k, t, p = np.indices(codes.shape).reshape(3, -1)
            first = np.ones(len(k), bool)  # a bucket that several probes name counts once
            for q in range(1, probes):
                again = (codes[:, :, :q] == codes[:, :, q : q + 1]).any(axis=2)
                first.reshape(codes.shape)[:, :, q] = ~again
            k, t, c = k[first], t[first], codes.reshape(-1)[first]
            rows = b.take(pa.array(k))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(t.astype(np.int32)), pa.array(c)], ["key", "x", "label", "copies", "table_", "bucket"])

    schema = slim.withColumn("table_", F.lit(0)).withColumn("bucket", F.lit(0).cast("long")).schema
    placed = slim.mapInArrow(place, schema)
    at = ["label", "table_", "bucket"]
    sizes = placed.groupBy(*at).agg(F.count("*").alias("size")).where("size > 1")
    tiles = F.ceil(F.col("size") / tile).cast("int")
    mine = F.pmod(F.xxhash64("key", F.lit(3)), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = placed.join(sizes.withColumn("tiles", tiles), at).withColumn("mine", mine).select("key", "x", "copies", *at, "mine", other)
    dealt = dealt.select("key", "x", "copies", *at, "mine", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
    met = dealt.withColumn("met", F.xxhash64(*at, "one", "two"))
    return met.repartition("met").sortWithinPartitions("met").mapInArrow(lambda b: _verify(b, width, least, hashes, tables, probes), "key long, links long, root long")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all of ``embeddings``."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB's form of the query.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM e GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
