"""Best-fit packing of token pieces into sequences, by patterns fitted with non-negative least squares.

1. One pass over the texts tokenizes them and cuts what is longer than a sequence; pieces
   (a few numbers each) are written, texts are not read again.
2. The histogram of piece lengths (at most ``capacity`` rows, however large the corpus)
   goes to the driver. Lengths are classed by 32 tokens; all patterns of at most three
   pieces whose classes fill a sequence are enumerated; Lawson-Hanson NNLS fits their
   repeat counts to the histogram; counts are rounded down.
3. The pieces left over go, longest first, where they fit best: into the room the patterns
   left, else into new sequences. All this works on counts of lengths, so its cost depends
   on the number of lengths, not of documents.
4. The plan is a list of ranges "the r-th to s-th piece of length n take sequences q, q+1,
   ... at offset o". Pieces are numbered within their length by salted prefix counts (a
   length that a third of all rows have is split among many tasks) and look up their range.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C
from ._tokens import WORD_TOKENIZER, word_ids

CAPACITY, END = 4096, 1
#: Classes of lengths in a sequence, and most pieces in a pattern.
CLASSES, DEPTH = 128, 3


def patterns(units: int, depth: int) -> np.ndarray:
    """All multisets of at most ``depth`` class numbers that sum to ``units``, as counts: one column each."""
    out: list[tuple[int, ...]] = []

    def grow(held: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            out.append(held)
        elif len(held) < depth:
            for k in range(min(most, left), 0, -1):
                if k * (depth - len(held)) < left:
                    break
                grow((*held, k), left - k, k)

    grow((), units, units)
    counts = np.zeros((units, len(out)))
    for c, p in enumerate(out):
        for k in p:
            counts[k - 1, c] += 1
    return counts


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least |ax - b| (Lawson and Hanson's active sets)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    floor = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= floor:
            break
        active[k] = True
        while True:
            on = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[on] = s
                break
            bad = s <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-300))
            x[on] += step * (s - x[on])
            active[on[x[on] <= floor]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


class _Plan:
    """Ranges of pieces of one length that take consecutive sequences at one offset."""

    def __init__(self, hist: np.ndarray):
        self.left = hist.astype(np.int64).copy()
        self.given = np.zeros(len(hist), np.int64)
        self.ranges: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.rooms: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room: (first sequence, count, used)
        self.sizes: list[int] = []  # rooms that exist, ascending
        self.sequences = 0

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.ranges.append((length, int(self.given[length]), count, sequence, offset))
        self.given[length] += count
        self.left[length] -= count

    def room(self, size: int, sequence: int, count: int, used: int) -> None:
        if size > 0 and count:
            if not self.rooms[size]:
                insort(self.sizes, size)
            self.rooms[size].append((sequence, count, used))


def make_plan(hist: np.ndarray, capacity: int, classes: int = CLASSES, depth: int = DEPTH) -> tuple[np.ndarray, int]:
    """(ranges, number of sequences) for hist[n] pieces of each length n from 1 to capacity."""
    plan = _Plan(hist)
    unit = -(-capacity // classes)
    units = capacity // unit
    kind = -(-np.arange(capacity + 1) // unit)  # class of each length, 0 for none
    if hist.sum():
        table = patterns(units, depth)
        by_class = np.bincount(kind, weights=hist, minlength=units + 2)[1 : units + 1]
        fit = np.floor(nnls(table, by_class) + 1e-6).astype(np.int64)
        for c in np.argsort(-fit, kind="stable"):
            if not fit[c]:
                break
            need = table[:, c].astype(int)
            slots = [k for k in range(units, 0, -1) for _ in range(need[k - 1])]
            have = {k: int(plan.left[(k - 1) * unit + 1 : k * unit + 1].sum()) for k in set(slots)}
            times = min(int(fit[c]), *(have[k] // need[k - 1] for k in set(slots)))
            _repeat(plan, slots, times, unit, capacity)
    _best_fit(plan, capacity)
    return np.array(plan.ranges, np.int64).reshape(-1, 5), plan.sequences


def _repeat(plan: _Plan, slots: list[int], times: int, unit: int, capacity: int) -> None:
    """Fill a pattern's slots at most ``times`` over, in runs of equal lengths.

    Slots take the longest pieces of their class; the last slot of several takes the
    longest piece that the sequence still holds, down to its class: classes bound lengths
    from above, so it makes up for what the others fall short.
    """
    while times:
        lengths: list[int] = []
        taken: dict[int, int] = {}
        used = 0
        for s, k in enumerate(slots):
            most = capacity - used if s and s == len(slots) - 1 else k * unit
            n = next((n for n in range(min(most, capacity), (k - 1) * unit, -1) if plan.left[n] > taken.get(n, 0)), 0)
            if not n:
                return
            lengths.append(n)
            taken[n] = taken.get(n, 0) + 1
            used += n
        run = min(times, *(int(plan.left[n]) // t for n, t in taken.items()))
        used = 0
        for n in lengths:
            plan.put(n, run, plan.sequences, used)
            used += n
        plan.room(capacity - used, plan.sequences, run, used)
        plan.sequences += run
        times -= run


def _best_fit(plan: _Plan, capacity: int) -> None:
    """The pieces left over, longest first, each into the smallest room that holds it."""
    for n in range(len(plan.left) - 1, 0, -1):
        while plan.left[n]:
            count = int(plan.left[n])
            at = bisect_left(plan.sizes, n)
            if at == len(plan.sizes):  # no room: new sequences, as many of this length in each as fit
                each = min(capacity // n, count)
                new = count // each
                for k in range(each):
                    plan.put(n, new, plan.sequences, k * n)
                plan.room(capacity - each * n, plan.sequences, new, each * n)
                plan.sequences += new
                continue
            size = plan.sizes[at]
            sequence, have, used = plan.rooms[size].pop()
            if not plan.rooms[size]:
                plan.sizes.pop(at)
            some = min(have, count)
            plan.put(n, some, sequence, used)
            plan.room(size - n, sequence, some, used + n)
            plan.room(size, sequence + some, have - some, used)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, text: str, doc_id: str, tokenizer: str, end: int, with_ids: bool) -> DataFrame:
    """The token pieces of each row, cut at ``capacity``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            docs_, (data, offs) = batch.column(0).to_pylist(), C.text_buffer(batch.column(1))
            for i, j in C.row_slices(offs):
                flat, at = words.ids(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                out: list[list] = [[] for _ in names]
                for k in range(j - i):
                    ids = np.append(flat[at[k] : at[k + 1]], np.uint32(end)).astype("<u4")
                    for p, lo in enumerate(range(0, len(ids), capacity)):
                        part = ids[lo : lo + capacity]
                        row = (docs_[i + k], p, lo, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None)
                        for held, x in zip(out, row, strict=False):
                            held.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=False)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, _PIECE + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", tokenizer: str = WORD_TOKENIZER, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its text's, followed by ``end``. A document of at most
    ``capacity`` ids stays whole; a longer one is cut into full pieces and a rest. A null
    or empty text is one piece, the end id alone. Rows that repeat a doc_id are packed
    each for itself; a null doc_id stays null; both are spread by their ids. ``with_ids`` adds the ids (see sequences).
    Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    salts = max(1, C.partitions(spark))
    names = [x.split()[0] for x in _PIECE.split(", ")] + ["ids"] * with_ids
    made = C.written(pieces(docs, capacity, text, doc_id, tokenizer, end, with_ids).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    counts = C.written(made.groupBy("length", "salt").agg(F.count("*").alias("n")))
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        hist[r.length] = r.n
    ranges, _ = make_plan(hist, capacity)
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    key = ranges[:, 0] * (1 << 48) + ranges[:, 1]
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = made.withColumn("rank", rank).join(before, ["length", "salt"]).select(*names, (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            i = np.searchsorted(key, b.column("length").to_numpy() * (1 << 48) + rank, "right") - 1
            out = [b.column(n) for n in names]
            out += [pa.array(ranges[i, 3] + rank - ranges[i, 1]), pa.array(ranges[i, 4])]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, _PIECE + ", ids array<long>" * with_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from pack(..., with_ids=True); a sequence holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every whole text of ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
