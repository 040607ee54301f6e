"""Token counts by a separator scan of flat, unindexed token files.

A token file is a run of fixed-width ids without an index; documents end with an
end-of-document id and may lie across any number of blocks. Each block is searched for that
id in one vectorised comparison and reports how many ends it has and where the last one
lies. A prefix scan over these few numbers gives, for each block, the number of documents
that ended before it and the place where the open one began; with that, every end becomes
a document's number, start and length. The scan runs in two levels (stretches of blocks,
then the stretches of a file), so one very large file spreads over many tasks.

Tasks open a file and read one block's bytes, so files may be of any size. Only where tasks
cannot open the store (one that Spark alone reaches) do tables of blocks stand in for files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C
from ._tokens import WORD_TOKENIZER, word_ids

#: The end-of-document id of the word tokenizer; ids fit 16 bits.
END, WIDTH = 49407, 2
#: Tokens in a block; blocks in a stretch of the prefix scan.
BLOCK, STRETCH = 1 << 16, 256


def _opened(uri: str) -> tuple[fs.FileSystem, str] | None:
    """The store and the path in it; None for a store that only Spark reads."""
    try:
        return fs.FileSystem.from_uri(uri.replace("file:/", "/", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def blocks_of_ranges(files: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """file, block, data of flat token files (file, size in bytes): tasks read each block by its range of bytes."""
    step = block * width
    whole = F.when(F.col("size") % width == 0, F.col("size")).otherwise(F.raise_error(F.concat("file", F.lit(f": not a whole number of {width}-byte ids"))).cast("long"))
    ranges = files.select("file", whole.alias("size")).select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / step) - 1, F.lit(0)))).alias("block"))
    spread = ranges.repartition(C.partitions(files.sparkSession), "file", F.floor(F.col("block") / 16)).sortWithinPartitions("file", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["file"] != name:
                        if held is not None:
                            held.close()
                        name = r["file"]
                        store, path = _opened(name)
                        held = store.open_input_file(path)
                    data = held.read_at(min(step, r["size"] - r["block"] * step), r["block"] * step) if r["size"] else b""
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r["block"]], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])
        finally:
            if held is not None:
                held.close()

    return spread.mapInArrow(read, "file string, block long, data binary")


def blocks_of_files(spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """file, block, data of the flat token files under path.

    Spark lists them. Where tasks cannot open the store, Spark reads each file whole, and a
    file must be under 2 GB.
    """
    found = spark.read.format("binaryFile").load(path)
    if _opened(path) is not None:
        return blocks_of_ranges(found.select(F.url_decode("path").alias("file"), F.col("length").alias("size")), width, block)
    step = block * width
    whole = F.when(F.col("length") % width == 0, F.col("content")).otherwise(F.raise_error(F.concat("path", F.lit(f": not a whole number of {width}-byte ids"))).cast("binary"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.length("data") / step) - 1, F.lit(0)))).alias("block")
    return found.select(F.col("path").alias("file"), whole.alias("data")).select("file", at, "data").select("file", "block", F.substring("data", (F.col("block") * step + 1).cast("int"), F.lit(step)).alias("data"))


def scan(blocks: DataFrame, end: int = END, width: int = WIDTH) -> DataFrame:
    """file, document (from 0), start, n_tokens of every document of token blocks (file, block from 0, data).

    n_tokens leaves out the end id. Ids after a file's last end form a last document.
    Empty blocks and files are allowed; a file without ids has no documents. Blocks of a
    file may differ in size. Bytes are little-endian.
    """
    kind = np.dtype(f"<u{width}")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for file, block, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ids = np.frombuffer(data.as_buffer(), kind) if data.is_valid else np.zeros(0, kind)
                ends = np.flatnonzero(ids == end)
                for held, x in zip(out, (file.as_py(), block.as_py(), len(ids), len(ends), int(ends[-1]) if len(ends) else None, ends.astype("<u4").tobytes()), strict=True):
                    held.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["file", "block", "size", "n", "last", "ends"])

    found = blocks.select("file", "block", "data").mapInArrow(search, "file string, block long, size long, n long, last long, ends binary")
    found = C.written(found.withColumn("stretch", F.floor(F.col("block") / STRETCH)))
    brief = found.drop("ends")
    # Within a stretch: ids and ends before each block, and the last end so far, counted from the stretch's start.
    inner = Window.partitionBy("file", "stretch").orderBy("block")
    upto = inner.rowsBetween(Window.unboundedPreceding, -1)
    local = brief.withColumn("ids_before", F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumn("n_before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    local = local.withColumn("end_here", F.col("ids_before") + F.col("last")).withColumn("end_before", F.max("end_here").over(upto))
    # The stretches of a file.
    whole = local.groupBy("file", "stretch").agg(F.sum("size").alias("s_size"), F.sum("n").alias("s_n"), F.max("end_here").alias("s_end"), F.max("block").alias("s_last"))
    outer = Window.partitionBy("file").orderBy("stretch")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("s_ids", F.coalesce(F.sum("s_size").over(before), F.lit(0))).withColumn("s_ends", F.coalesce(F.sum("s_n").over(before), F.lit(0)))
    whole = whole.withColumn("s_open", F.max(F.col("s_ids") + F.col("s_end")).over(before)).withColumn("final", F.col("stretch") == F.max("stretch").over(Window.partitionBy("file")))
    whole = whole.select("file", "stretch", "s_ids", "s_ends", "s_open", F.when(F.col("final"), F.col("s_last")).alias("s_last"))
    state = local.join(whole, ["file", "stretch"]).select(
        "file", "block", (F.col("s_ids") + F.col("ids_before")).alias("first"), (F.col("s_ends") + F.col("n_before")).alias("number"),
        F.coalesce(F.col("s_ids") + F.col("end_before") + 1, F.col("s_open") + 1, F.lit(0)).alias("open"), F.coalesce(F.col("block") == F.col("s_last"), F.lit(False)).alias("final"),
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, ends, size, first, number, open_, final in zip(*(batch.column(n) for n in ("file", "ends", "size", "first", "number", "open", "final")), strict=True):
                stop = np.frombuffer(ends.as_buffer(), "<u4").astype(np.int64) + first.as_py()
                if final.as_py():  # what stands after the last end of a file
                    stop = np.append(stop, first.as_py() + size.as_py())
                start = np.append(open_.as_py(), stop[:-1] + 1)[: len(stop)]
                if final.as_py() and start[-1] == stop[-1]:
                    start, stop = start[:-1], stop[:-1]
                number_ = number.as_py() + np.arange(len(stop))
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(stop), pa.string()), pa.array(number_), pa.array(start.astype(np.int64)), pa.array(stop - start)], ["file", "document", "start", "n_tokens"])

    return found.select("file", "block", "size", "ends").join(state, ["file", "block"]).mapInArrow(documents, "file string, document long, start long, n_tokens long")


def write_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = WORD_TOKENIZER, end: int = END, folder: str | None = None) -> DataFrame:
    """Flat token files of docs in a folder (by default a new one in the shared folder), one for each task, an end id after each document.

    Returns the written table file, chunk (its parts in order), size (bytes), data and
    doc_ids (the documents that end in it, in order). data is null, but holds the ids where
    tasks cannot open the store, which then has no files. A task that runs again writes
    another file; only those in the table count.
    """
    folder = folder or C.scratch(docs.sparkSession)
    flat = _opened(folder) is not None

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, k, out = word_ids(tokenizer, True), 0, None
        if len(words.ends) > 1 << 8 * WIDTH:
            raise ValueError(f"{tokenizer}: its ids do not fit {WIDTH} bytes")
        name = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.ids"
        try:
            for batch in batches:
                docs_, (data, offs) = batch.column(0), C.text_buffer(batch.column(1))
                for i, j in C.row_slices(offs):
                    ids, at = words.ids(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    raw = np.insert(ids, at[1:], end).astype(f"<u{WIDTH}").tobytes()
                    if flat:
                        if out is None:
                            store, path = _opened(name)
                            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                            out = store.open_output_stream(path)
                        out.write(raw)
                    listed = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), docs_.slice(i, j - i))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([None if flat else raw], pa.binary()), listed], ["file", "chunk", "size", "data", "doc_ids"])
                    k += 1
        finally:
            if out is not None:
                out.close()

    return C.written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(stream, "file string, chunk long, size long, data binary, doc_ids array<long>"))


def count(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, file, document, start, n_tokens of each row, by a scan of the rows' flat token files.

    A null or empty text has no tokens. Text that looks like a special token is tokenized
    as ordinary text, so an end id only ends documents. Rows that repeat a doc_id are
    counted each for itself; a null doc_id stays null. An empty table gives an empty result.
    """
    folder = C.scratch(docs.sparkSession)
    made = write_tokens(docs, text, doc_id, folder=folder)
    flat = _opened(folder) is not None
    blocks = blocks_of_ranges(made.groupBy("file").agg(F.sum("size").alias("size"))) if flat else made.select("file", F.col("chunk").alias("block"), "data")
    counted = scan(blocks)
    # A document's number in its file: the doc_ids listed before it.
    order = made.select("file", "chunk", "doc_ids", F.size("doc_ids").alias("n"), F.floor(F.col("chunk") / STRETCH).alias("stretch"))
    inner = Window.partitionBy("file", "stretch").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = order.groupBy("file", "stretch").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(outer), F.lit(0))).select("file", "stretch", "base")
    listed = order.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(sums, ["file", "stretch"])
    ids = listed.select("file", (F.col("base") + F.col("before")).alias("first"), F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("document"), "doc_id")
    return ids.join(counted, ["file", "document"]).select("doc_id", "file", "document", "start", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every whole text of ``documents``, written as flat token files and scanned."""
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_tokens")
