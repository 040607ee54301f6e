"""Substring dedup by prefix-partitioned suffix trees.

A suffix starts at a word and is cut after ``window`` words: inner nodes at that depth with
several leaves are repeated passages, and runs of such nodes are the maximal repeats.

1. Documents are dealt into blobs, once; all later steps reuse that exchange. Each window
   has an anchor: the first of its 6-word grams with the smallest hash. Equal windows have
   equal anchors at equal places, so suffixes are indexed only where an anchor starts, with
   the words before it that its windows reach (a sparse suffix tree): about one suffix for
   every four windows. Anchors that occur in one document alone have no repeats and go.
2. Variable-length prefixes split the suffixes into groups. A gram below which at most
   ``GROUP`` suffixes stand is a group by itself. Under a more frequent one each window is a
   suffix of its own and its whole path of ``window`` words is the prefix, so such a group
   is one node and is read as a stream. A blob sends each distinct suffix once, with its
   smallest doc_id.
3. A task sorts its groups on disk and holds a few whole ones at a time. In each, suffixes
   stand in the order of their words, and the common prefix of neighbours gives the inner
   nodes at every depth; the words before the anchors, read backward, form a second tree. A
   window that starts d words before its anchor is a node at depth ``window`` - d of the one
   and at depth d of the other. Words are compared by their bytes, so no hash decides.
4. Blobs hear which windows of which leaf hang on a node with a smaller document; the words
   of those windows go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Words in a window and in an anchor's gram.
WINDOW, GRAM = 13, 6
#: Most suffixes below one gram; suffixes whose trees are built at once, about.
GROUP, BUILD = 1 << 17, 1 << 15
#: Text of a blob, in bytes of the input's estimated size.
BLOB_BYTES = 4 << 20
_NULL_ID = np.iinfo(np.int64).max

_ANCHORS = "anchor long, blob int, n int"
_LEAVES = "prefix long, words binary, before int, blob int, leaf int, low long"


class _Words:
    """Words, windows and anchors of some rows of text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int):
        self.data = data
        self.starts, self.ends, self.first = C.word_spans(data, offs)
        self.window, self.gram = window, min(GRAM, window)
        counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.at = np.flatnonzero(np.arange(len(self.row)) + window <= np.repeat(self.first[1:], counts))  # where windows start
        self.grams = np.zeros(0, np.uint64)
        if len(self.at):
            prefix = C.prefix_hash(C.word_hashes(data, self.starts, self.ends))
            lo = np.arange(len(prefix) - self.gram)
            self.grams = C.mix(C.range_hash(prefix, lo, lo + self.gram))
            self.anchor = self._anchors()[self.at]

    def _anchors(self) -> np.ndarray:
        """For each word, where the first smallest gram of the window that starts there begins."""
        best, low, width, done = np.arange(len(self.grams)), self.grams, self.window - self.gram + 1, 1
        while done < width:
            step = min(done, width - done)
            after, its = best[step:], low[step:]
            take = its < low[: len(its)]
            best, low = best.copy(), low.copy()
            best[: len(its)][take], low[: len(its)][take] = after[take], its[take]
            done += step
        return best

    def runs(self, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, anchor), as word numbers, of the runs of windows that share an anchor (one whose hash is in near)."""
        if not len(self.at):
            return (np.zeros(0, np.int64),) * 3
        new = np.flatnonzero(np.r_[True, (self.anchor[1:] != self.anchor[:-1]) | (self.row[self.at][1:] != self.row[self.at][:-1])])
        last = np.r_[new[1:], len(self.at)] - 1
        if near is not None:
            held = _member(self.grams[self.anchor[new]], near)
            new, last = new[held], last[held]
        return self.at[new], self.at[last], self.anchor[new]

    def spelled(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """The words lo to hi (exclusive) of each pair, joined by single spaces."""
        n = hi - lo
        upto = np.cumsum(n)
        word = np.repeat(lo - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)
        size = self.ends[word] - self.starts[word] + 1
        end = np.cumsum(size)
        place = np.repeat(self.starts[word] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        text = np.append(self.data, np.uint8(0x20))[np.minimum(place, len(self.data))]
        text[end - 1] = 0x20
        cut = np.r_[0, end][np.r_[0, upto]]
        return pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())])


class _Blob:
    """A blob's rows by doc_id (null last), a chunk of text at a time."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").fill_null(_NULL_ID).to_numpy() if table.column("doc_id").null_count else table.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.window = ids[order].astype(np.int64), window
        self.doc_id = table.column("doc_id").take(pa.array(order)).combine_chunks()
        self.data, self.offs = C.text_buffer(table.column("text").take(pa.array(order)))
        self.number = table.column("blob")[0].as_py()

    def parts(self) -> Iterator[tuple[int, int, _Words]]:
        for i, j in C.row_slices(self.offs):
            yield i, j, _Words(self.data[self.offs[i] : self.offs[j]], self.offs[i : j + 1] - self.offs[i], self.window)

    def anchors(self) -> pa.Table:
        """Each anchor of the blob and how many suffixes it has, as a negative number if all are of one document."""
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, _, w in self.parts():
            lo, _, anchor = w.runs()
            if len(lo):
                hashes.append(w.grams[anchor])
                docs.append(self.ids[i + w.row[lo]])
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(h, kind="stable")  # rows stand by doc_id
        h, d = h[order], d[order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        last = np.r_[new[1:], len(h)][: len(new)] - 1
        n = np.where(d[new] == d[last], -1, 1) * (last - new + 1)
        return pa.table({"anchor": h[new].view(np.int64), "blob": np.full(len(new), self.number, np.int32), "n": n.astype(np.int32)})

    def leaves(self, anchors: pa.Table) -> tuple[pa.Table, list[tuple]]:
        """(distinct leaves in order, and for each part its runs: first window, last window, leaf of the first one, leaves a run has).

        A run under a frequent anchor (n < 0) has a leaf for each window, any other one leaf in all.
        """
        order = np.argsort(anchors.column("anchor").to_numpy().view(np.uint64))
        near, often = anchors.column("anchor").to_numpy().view(np.uint64)[order], anchors.column("n").to_numpy()[order] < 0
        words, before, prefix, low, held = [], [], [], [], []
        for i, _, w in self.parts():
            lo, hi, anchor = w.runs(near)
            single = often[np.searchsorted(near, w.grams[anchor])] if len(lo) else np.zeros(0, bool)
            n = np.where(single, hi - lo + 1, 1)
            end = np.cumsum(n)
            first = np.repeat(lo, n) + np.where(np.repeat(single, n), np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - n, n), 0)
            stop = np.where(np.repeat(single, n), first, np.repeat(hi, n)) + self.window
            held.append((lo, hi, n, single))
            words.append(w.spelled(first, stop))
            before.append(np.where(np.repeat(single, n), -1, np.repeat(anchor, n) - first))
            prefix.append(np.repeat(w.grams[anchor], n) if len(lo) else np.zeros(0, np.uint64))
            low.append(self.ids[i + w.row[first]] if len(first) else np.zeros(0, np.int64))
        text = pa.concat_arrays(words).cast(pa.large_binary()) if words else pa.array([], pa.large_binary())
        back, prior = np.concatenate([*before, np.zeros(0, np.int64)]), np.concatenate([*prefix, np.zeros(0, np.uint64)])
        # One leaf for each distinct (words, words before); the first row has the smallest document.
        coded = text.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64) * (self.window + 2) + back + 1
        distinct, one, of = np.unique(code, return_index=True, return_inverse=True)
        rank = np.empty(len(distinct), np.int64)  # by their words, so that it does not depend on the order of rows
        spelled = text.take(pa.array(one))
        by = pc.sort_indices(pa.table({"w": spelled, "b": back[one]}), sort_keys=[("w", "ascending"), ("b", "ascending")]).to_numpy()
        rank[by] = np.arange(len(by))
        docs = np.concatenate([*low, np.zeros(0, np.int64)])
        table = pa.table({"words": spelled.take(pa.array(by)), "before": back[one][by], "anchor": prior[one][by], "low": docs[one][by]})
        leaf, out, at = rank[of], [], 0
        for lo, hi, n, single in held:
            out.append((lo, hi, n, single, leaf[at : at + int(n.sum())], docs[at : at + int(n.sum())]))
            at += int(n.sum())
        return table, out


def _member(values: np.ndarray, within: np.ndarray) -> np.ndarray:
    if not len(within):
        return np.zeros(len(values), bool)
    return within[np.minimum(np.searchsorted(within, values), len(within) - 1)] == values


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=100_000)


def _shared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Anchors with two suffixes or more, of two documents; n is negative where there are more than ``most``. A group has a row for each blob at most."""
    for t in C.groups(batches, "anchor", 1 << 16):
        anchor, n = t.column("anchor").to_numpy(), t.column("n").to_numpy()
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        blobs = np.diff(np.r_[new, len(anchor)])
        total = np.repeat(np.add.reduceat(np.abs(n.astype(np.int64)), new), blobs)
        keep = np.repeat((blobs > 1) | (n[new] > 0), blobs)
        yield from _batches(pa.table({"anchor": anchor[keep], "blob": t.column("blob").to_numpy()[keep], "n": np.where(total > most, -1, 1)[keep].astype(np.int32)}))


class Tree:
    """Paths (rows of word numbers, -1 where a path ends) of some groups in depth-first order; node(k): each path's node at depth k."""

    def __init__(self, group: np.ndarray, paths: np.ndarray):
        order = np.lexsort((*paths.T[::-1], group))
        apart = paths[order][1:] != paths[order][:-1]
        #: Words that neighbours have in common; -1 where a group ends.
        self.common = np.where(apart.any(axis=1), apart.argmax(axis=1), paths.shape[1])
        self.common[group[order][1:] != group[order][:-1]] = -1
        self.order = order

    def node(self, depth: int) -> np.ndarray:
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(np.r_[True, self.common < depth]) - 1
        return out


def _paths(words: pa.Array, before: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words from the anchor on, words before it read backward, number of words from the anchor on) of each leaf; words are numbered in byte order."""
    data, offs = C.text_buffer(words.cast(pa.large_binary()).view(pa.large_string()))
    starts, ends, first = C.word_spans(data, offs)
    # A word with its space; all distinct ones numbered.
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    coded = spans.dictionary_encode()
    number = np.empty(len(coded.dictionary), np.int32)
    number[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(number), dtype=np.int32)
    ids = np.append(number[coded.indices.to_numpy()], np.int32(-1))
    head = first[:-1] + np.maximum(before, 0)
    on = first[1:] - head
    k = np.arange(window)
    forth = ids[np.where(k < on[:, None], head[:, None] + k, len(ids) - 1)]
    k = np.arange(1, window - min(GRAM, window) + 1)
    back = ids[np.where(k <= before[:, None], head[:, None] - k, len(ids) - 1)]
    return forth, back, on


def subtrees(group: np.ndarray, words: pa.Array, before: np.ndarray, low: np.ndarray, window: int) -> np.ndarray:
    """For each leaf a bit d for each of its windows (d words before the anchor) that hangs on a node with a smaller document."""
    forth, back, on = _paths(words, before, window)
    right, left = Tree(group, forth), Tree(group, back)
    late = np.zeros(len(low), np.int64)
    for d in range(back.shape[1] + 1):
        has = np.flatnonzero((np.maximum(before, 0) >= d) & (on >= window - d))
        if len(has):
            node = right.node(window - d)[has] * (len(low) + 1) + left.node(d)[has]
            order = np.argsort(node, kind="stable")
            new = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]])
            least = np.repeat(np.minimum.reduceat(low[has][order], new), np.diff(np.r_[new, len(order)]))
            late[has[order]] |= (low[has][order] > least).astype(np.int64) << d
    return late


def _late(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Leaves with windows that a smaller document has, from leaves sorted by prefix and document."""
    kept: pa.Table | None = None  # of a frequent path that goes on: the first leaf of each node, its smallest document
    for t in C.groups(_split(batches), "part", BUILD):
        own = t.num_rows
        if kept is not None:
            t = pa.concat_tables([kept.filter(pc.is_in(kept.column("prefix"), t.column("prefix").unique())), t.drop_columns(["part"])])
        else:
            t = t.drop_columns(["part"])
        group, before, low = (t.column(c).to_numpy() for c in ("prefix", "before", "low"))
        words = t.column("words").combine_chunks()
        words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
        late = subtrees(group, words, before.astype(np.int64), low, window)
        some = np.flatnonzero(late[-own:]) + len(late) - own
        yield from _batches(pa.table({"blob": t.column("blob").to_numpy()[some], "leaf": t.column("leaf").to_numpy()[some], "late": late[some]}))
        ends = np.flatnonzero((late == 0) & (before < 0) & (group == group[-1]))
        kept = t.take(pa.array(ends)).combine_chunks() if len(ends) else None


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with part: a number for each group, and a new one after BUILD rows of a frequent path."""
    part, last, rows = 0, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        prefix, often = b.column("prefix").to_numpy(), b.column("before").to_numpy() < 0
        new = np.r_[prefix[0] != last, prefix[1:] != prefix[:-1]]
        rows = 0 if new[0] else rows
        if not new.any() and often[0] and rows >= BUILD:
            new[0], rows = True, 0
        numbers = part + np.cumsum(new)
        part, last, rows = int(numbers[-1]), prefix[-1], rows + b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers)], [*b.schema.names, "part"])


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Remove every word covered by a ``window``-word passage that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text (the kept
    words joined by single spaces) and removed (array of word spans [start, end), merged:
    the maximal repeats of this document).

    A null or blank text has no words and hashes as the empty string. Documents of fewer
    than ``window`` words stay whole. Rows that repeat a doc_id never remove each other's
    words (no smaller id). A null doc_id counts as larger than all others. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    blobs = max(4 * C.partitions(spark), min(C.plan_bytes(docs) // BLOB_BYTES, 1 << 22))
    # By id and text, so that rows without an id, or with one id, are spread too.
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blobs)).cast("int").alias("blob"), "doc_id", "text")
    found = dealt.groupBy("blob").applyInArrow(lambda t: _Blob(t, window).anchors(), _ANCHORS)
    anchors = found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _shared(b, GROUP), _ANCHORS)

    def leaves(left: pa.Table, right: pa.Table) -> pa.Table:
        blob = _Blob(left, window)
        table, _ = blob.leaves(right)
        # A frequent path is its own prefix; any other group is a gram's.
        whole = table.column("before").to_numpy() < 0
        prefix = table.column("anchor").to_numpy().copy()
        if whole.any():
            paths = table.column("words").combine_chunks()
            data, offs = C.text_buffer(paths.view(pa.large_string()) if isinstance(paths, pa.Array) else pa.concat_arrays(paths.chunks).view(pa.large_string()))
            prefix[whole] = C.mix(C.word_hashes(data, offs[:-1], offs[1:])[whole] + np.uint64(1))
        n = table.num_rows
        return pa.table({"prefix": prefix.view(np.int64), "words": table.column("words").cast(pa.binary()), "before": table.column("before").cast(pa.int32()), "blob": np.full(n, blob.number, np.int32), "leaf": np.arange(n, dtype=np.int32), "low": table.column("low")})

    def cut(left: pa.Table, right: pa.Table, late: pa.Table) -> pa.Table:
        return _cut(_Blob(left, window), right, late, texts)

    by_blob = dealt.groupBy("blob").cogroup(anchors.groupBy("blob"))
    tree = by_blob.applyInArrow(lambda left, right: leaves(left, right) if left.num_rows else _none(_LEAVES), _LEAVES)
    tree = tree.repartition("prefix").sortWithinPartitions("prefix", "low").mapInArrow(lambda b: _late(b, window), "blob int, leaf int, late long")
    # The blob's anchors and what the trees say of its leaves, told apart by n.
    told = anchors.select("blob", "anchor", "n", F.lit(0).cast("long").alias("late")).union(tree.select("blob", F.col("leaf").cast("long"), F.lit(0), "late"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _none(schema)
        is_anchor = np.asarray(right.column("n").to_numpy() != 0)
        return cut(left, right.filter(pa.array(is_anchor)), right.filter(pa.array(~is_anchor)))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, removed array<struct<start:long,end:long>>" * texts
    return dealt.groupBy("blob").cogroup(told.groupBy("blob")).applyInArrow(finish, schema)


def _none(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split(" ") for x in schema.replace("array<struct<start:long,end:long>>", "spans").split(", ")]
    return pa.table({n: pa.array([], kinds.get(t, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))) for n, t in fields})


def _cut(blob: _Blob, anchors: pa.Table, late: pa.Table, texts: bool) -> pa.Table:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text", "removed"] * texts
    out: dict[str, list] = {n: [] for n in names}
    table, runs = blob.leaves(anchors)
    told = np.zeros(table.num_rows, np.int64)
    told[late.column("anchor").to_numpy()] = late.column("late").to_numpy()
    low, before = table.column("low").to_numpy(), table.column("before").to_numpy()
    for (i, j, w), (lo, hi, n, single, leaf, doc) in zip(blob.parts(), runs, strict=True):
        # Every window of a leaf that a smaller document of this blob has, else what the trees say.
        size = np.where(single, 1, hi - lo + 1)[np.repeat(np.arange(len(n)), n)] if len(n) else np.zeros(0, np.int64)
        end = np.cumsum(n)
        first = np.repeat(lo, n) + np.where(np.repeat(single, n), np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - n, n), 0)
        upto = np.cumsum(size)
        which = np.repeat(np.arange(len(size)), size)
        k = np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - size, size)
        at = first[which] + k
        d = np.maximum(before[leaf[which]], 0) - k
        gone = (doc > low[leaf])[which] | (told[leaf[which]] >> d & 1).astype(bool)
        edge = np.zeros(len(w.row) + 1, np.int64)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + w.window, -1)
        _rows(out, blob, i, j, w, np.cumsum(edge[:-1]) > 0, texts)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    cols = [pa.array(out[n], t) for n, t in zip(names, kinds, strict=False)]
    cols[0] = blob.doc_id if isinstance(blob.doc_id, pa.Array) else pa.concat_arrays(blob.doc_id.chunks)
    return pa.Table.from_arrays(cols, names)


def _rows(out: dict[str, list], blob: _Blob, i: int, j: int, w: _Words, removed: np.ndarray, texts: bool) -> None:
    """Add the rows i to j of a blob to out; removed: which of their words go."""
    data = blob.data[blob.offs[i] : blob.offs[j]]
    keep = ~removed
    # Bytes of kept words, each followed by one space in place of what stood there.
    size = w.ends - w.starts + 1
    size = np.where(keep, size, 0)
    end = np.cumsum(size)
    text = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[w.starts[keep]] += 1
    edge[w.ends[keep]] -= 1
    spots = np.ones(len(text), bool)
    spots[end[keep] - 1] = False
    text[spots] = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    upto = np.r_[0, end]
    bytes_ = text.tobytes()
    n_removed = np.diff(np.r_[0, np.cumsum(removed)][w.first])
    for k in range(j - i):
        a, b = w.first[k], w.first[k + 1]
        kept = bytes_[upto[a] : max(upto[a], upto[b] - 1)]
        out["n_words"].append(int(b - a))
        out["n_removed"].append(int(n_removed[k]))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        if texts:
            out["kept_text"].append(kept.decode("utf-8", "replace"))
            flips = np.flatnonzero(np.diff(np.r_[False, removed[a:b], False].astype(np.int8)))
            out["removed"].append([{"start": int(s), "end": int(e)} for s, e in zip(flips[::2], flips[1::2], strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every whole text of ``documents``."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


#: DuckDB's form of the query: all windows grouped by their word sequence.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), t AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k, len(w) AS n FROM d
), g AS (
  SELECT doc_id, k, n, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), ' ') AS s FROM t
), h AS (
  SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS low FROM g WHERE k + 12 <= n
), gone AS (
  SELECT DISTINCT doc_id, k + j AS k, true AS gone FROM h, range(0, 13) r(j) WHERE low < doc_id
)
SELECT d.doc_id, count(t.k) AS n_words, count(gone.gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY t.k) FILTER (WHERE gone.gone IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.k = t.k GROUP BY d.doc_id
"""
