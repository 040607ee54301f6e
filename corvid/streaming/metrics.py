"""Metric logs as streams. The file source reads whole new files, so a writer rolls its log into parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.training import curve, normalize_metrics
from ..schema import METRICS, struct


def follow(spark: SparkSession, folder: str, total_steps: int, parameters: int, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming frame step, train_loss, grad, val_loss, progress over the log's parts; lines that are no JSON are passed over."""
    reader = spark.readStream.schema(struct(METRICS).add("_bad", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.json(folder).where(F.col("_bad").isNull()).drop("_bad")
    return curve(normalize_metrics(rows), total_steps, parameters)


def on_progress(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Calls handler with each new batch; with a checkpoint folder a restart goes on where it stopped."""
    writer = stream.writeStream.foreachBatch(handler)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()
