"""What the operators share: written tables, word spans, words and their 64-bit hashes on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..storage import scratch, shared_dir, used_up, written  # noqa: F401 - the operators' names for them

#: Bytes of text that are hashed at once; bounds the arrays of a Python worker.
CHUNK_BYTES = 2 << 20

#: The word pattern of the contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# ---------------------------------------------------------------- sizes


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size (file sizes for plain scans); only sizes groups, never drops rows."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


# ---------------------------------------------------------------- texts as bytes


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and the n + 1 row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_slices(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row comes alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and for each row the index of its first word (n + 1 values)."""
    n = len(data)
    solid = ~_SPACE[data]
    brk = np.zeros(n + 1, bool)
    brk[offs] = True
    prev = np.zeros(n, bool)
    prev[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~prev | brk[:-1]))
    nxt = np.zeros(n, bool)
    nxt[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~nxt | brk[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


# ---------------------------------------------------------------- hashes

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    """1, x, x^2 ... modulo 2^64 for the base or its inverse."""
    held = _POWERS.get(kind)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _BASE if kind == "up" else _INV, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if size <= CHUNK_BYTES * 2:
            _POWERS[kind] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base^i modulo 2^64; see range_hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers("up", len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The polynomial hash of values[lo:hi], the same wherever the range stands."""
    return (prefix[hi] - prefix[lo]) * _powers("down", len(prefix))[lo]


#: Longer words are hashed and compared one by one.
LONG = 64
_LANES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each byte, zeros after the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)


def _lane(windows: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number; what stands after the next ``left`` bytes counts as zero."""
    return np.ascontiguousarray(windows[at]).view("<u8").reshape(-1) & _LANES[np.minimum(left, 8)]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its length and bytes, eight at a time through mix; XXH3 for words of over LONG bytes.

    Equal words have equal hashes. Different ones may share a hash, so what decides a result compares the words too.
    """
    size = ends - starts
    h, windows = mix(size.astype(np.uint64) + _BASE), _windows(data)
    for k in range(0, LONG, 8):
        some = np.flatnonzero((size > k) & (size <= LONG))
        if not len(some):
            break
        h[some] = mix(h[some] ^ _lane(windows, starts[some] + k, size[some] - k))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each word data[starts:ends] has the bytes of other[at:stop]."""
    size = ends - starts
    same = size == stop - at
    here, there = _windows(data), _windows(other)
    for k in range(0, LONG, 8):
        some = np.flatnonzero(same & (size > k) & (size <= LONG))
        if not len(some):
            break
        left = size[some] - k
        same[some] = _lane(here, starts[some] + k, left) == _lane(there, at[some] + k, left)
    for i in np.flatnonzero(same & (size > LONG)).tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], other[at[i] : stop[i]])
    return same


# ---------------------------------------------------------------- groups in sorted partitions


def groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 1) -> Iterator[pa.Table]:
    """Whole groups of equal keys, in sorted batches, some at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))  # the last group may go on
        if cut == 0 and held and held[-1].column(key)[-1].as_py() == k[0]:
            held.append(b)
            rows += b.num_rows
            continue
        if rows + cut >= least:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, rows = [b.slice(cut)], b.num_rows - cut
        else:
            held += [b.slice(0, cut), b.slice(cut)]
            rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- a sieve before a join

#: Bits of a sieve: for each key, and at most in all; bits in a slice of it.
SIEVE_BITS, SIEVE_MOST, SIEVE_SLICE = 16, 1 << 28, 1 << 16


def _spots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each key."""
    h = mix(keys.view(np.uint64))
    return np.stack([h % np.uint64(bits), mix(h + _BASE) % np.uint64(bits)]).astype(np.int64)


def sieved(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of table whose long ``key`` is in keys, and a few others: a semi-join on what is left gives the exact rows.

    A Bloom filter of keys, built slice by slice and bounded by SIEVE_MOST bits (32 MB),
    goes to the tasks, so rows that no key has stay where they are. With more keys than it
    is made for it lets more rows pass, never fewer than all that match.
    """
    spark = table.sparkSession
    n = keys.count()
    bits = min(SIEVE_MOST, max(SIEVE_SLICE, -(-n * SIEVE_BITS // SIEVE_SLICE) * SIEVE_SLICE))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_spots(b.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at // SIEVE_SLICE).astype(np.int32)), pa.array((at % SIEVE_SLICE).astype(np.int32))], ["slice", "at"])

    def fill(t: pa.Table) -> pa.Table:
        held = np.zeros(SIEVE_SLICE, bool)
        held[t.column("at").to_numpy()] = True
        return pa.table({"slice": t.column("slice")[:1], "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    whole = np.zeros(bits // 8, np.uint8)
    for r in keys.select(key).mapInArrow(spots, "slice int, at int").groupBy("slice").applyInArrow(fill, "slice int, held binary").collect():  # SIEVE_MOST bits in all
        whole[r.slice * SIEVE_SLICE // 8 :][: SIEVE_SLICE // 8] = np.frombuffer(bytes(r.held), np.uint8)
    shared = spark.sparkContext.broadcast(np.unpackbits(whole).view(bool) if bits <= 1 << 24 else whole)
    at = table.columns.index(key)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in batches:
            spot = _spots(b.column(at).to_numpy(), bits)
            fine = held[spot] if held.dtype == bool else (held[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)
            yield b.filter(pa.array(fine.all(axis=0)))

    return table.mapInArrow(pick, table.schema)
