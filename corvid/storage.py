"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a temporary one on a single machine, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvid-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/corvid-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder belongs to the cluster's own clean-up
        pass


#: Spark's setting by which a query's shuffle files go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later stages start from files that any executor reads.

    The shuffle files behind it are deleted at once. The table stays until used_up, or until the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def used_up(*tables: DataFrame) -> None:
    """Delete written tables from which nothing is read any more: all that was made of them is written too."""
    for t in tables:
        _delete(t.sparkSession, t._written)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small text file under any path that Spark can reach."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def path_hash(path: str) -> str | None:
    """16 hex digits of the SHA-256 of a file's bytes, or of a folder's relative paths and bytes in order; None where there is nothing. Streamed on the driver."""
    top, total = Path(path), hashlib.sha256()
    if not top.exists():
        return None
    for p in [top] if top.is_file() else sorted(x for x in top.rglob("*") if x.is_file()):
        if p != top:
            total.update(str(p.relative_to(top)).encode())
        with p.open("rb") as f:
            while part := f.read(1 << 20):
                total.update(part)
    return total.hexdigest()[:16]
