"""Evaluation: samples, prompts, verdicts, metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_fields(samples: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """samples with each expected field (key) taken from its source (value), where that is a column; originals stay."""
    return samples.withColumns({to: F.col(f"`{source}`") for to, source in mapping.items() if source in samples.columns})


def prompt_column(template: str, columns: list[str]) -> Column:
    """The prompt of a template with {field} places ({{ and }} for braces); a lone column name gives that column."""
    if template in columns:
        return F.col(f"`{template}`").cast("string")
    parts: list[Column] = []
    for text, place in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{([^{}]*)\}", template):
        if text:
            parts.append(F.lit(text.replace("{{", "{").replace("}}", "}")))
        else:
            name, _, form = place.partition(":")
            if name not in columns:
                raise ValueError(f"Missing field '{name}' for the prompt; available: {sorted(columns)}")
            parts.append(F.format_string(f"%{form}", F.col(f"`{name}`")) if form else F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def require_fields(samples: DataFrame, *fields: str) -> DataFrame:
    missing = [f for f in fields if f not in samples.columns]
    if missing:
        raise ValueError(f"Samples lack {missing}")
    return samples


def sample_ids(samples: DataFrame, pos: str = "pos") -> DataFrame:
    """samples with sample_id: their id, else sample-{pos}."""
    given = F.col("id").cast("string") if "id" in samples.columns else F.lit(None).cast("string")
    return samples.withColumn("sample_id", F.coalesce(given, F.concat(F.lit("sample-"), F.col(pos))))


def times(rows: DataFrame, n: int, name: str = "run") -> DataFrame:
    """Each row n times, numbered from 1."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def accuracy() -> list[Column]:
    """Aggregates over error, correct: total, completed, failed, correct, accuracy."""
    done, right = F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNull() & F.col("correct"))
    return [
        F.count("*").alias("total"), done.alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"), right.alias("correct"),
        F.coalesce(F.try_divide(right, done), F.lit(0.0)).alias("accuracy"),
    ]


def library_scored() -> list[Column]:
    """Aggregates over error, score: mean over the scores that completed rows have."""
    fine = F.col("error").isNull()
    return [F.count("*").alias("total"), F.count_if(fine).alias("completed"), F.count_if(~fine).alias("failed"), F.coalesce(F.avg(F.when(fine, F.col("score"))), F.lit(0.0)).alias("mean_score")]


def runner_scored(max_score: int) -> list[Column]:
    """Aggregates over error, score: a completed row without a score counts with the least one, and as a parse failure."""
    fine, least = F.col("error").isNull(), 0.0 if max_score == 1 else 1.0
    lost = F.count_if(fine & F.col("score").isNull())
    return [
        F.count("*").alias("total"), F.count_if(fine).alias("completed"), F.count_if(~fine).alias("failed"), lost.alias("parse_failures"),
        (F.count_if(fine) - lost).alias("scored_count"), F.coalesce(F.avg(F.when(fine, F.coalesce("score", F.lit(least)))), F.lit(0.0)).alias("mean_score"),
    ]


def histogram(rows: DataFrame, max_score: int, score: str = "score", whole_only: bool = False) -> DataFrame:
    """bin 1..max_score and n (0 where there are none) of completed rows; halves round to even, or whole_only drops what is not whole."""
    s = F.col(score)
    binned = F.when(s == F.floor(s), s) if whole_only else F.bround(s)
    counts = rows.where(F.col("error").isNull()).select(binned.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    bins = rows.sparkSession.range(1, max_score + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def as_map(histogram_: DataFrame) -> DataFrame:
    return histogram_.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("score_distribution"))


def final_score(judgments: Column) -> Column:
    """The mean of a generation's judge scores, without nulls."""
    scores = F.filter(F.transform(judgments, lambda j: j["score"]), lambda s: s.isNotNull())
    return F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, s: a + s), F.size(scores))


def index_scores(runs: DataFrame) -> DataFrame:
    """runs (records, runs, dataset_size, accuracy, mean_score, bins) with score, n_samples, complete as an index row has them."""
    n = F.floor(F.try_divide(F.col("records"), F.col("runs"))).cast("int")
    return runs.withColumn("score", F.when(F.col("bins") > 0, F.col("mean_score")).otherwise(F.col("accuracy"))).withColumn("n_samples", n).withColumn("complete", F.col("n_samples") >= F.col("dataset_size"))


def errors_by_type(rows: DataFrame, kind: str = "error_type") -> DataFrame:
    """error_type, n."""
    return rows.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("error_type")).agg(F.count("*").alias("n"))


def finished(output: DataFrame, error: str = "__ERROR__") -> DataFrame:
    """A task's output as samples; an error record raises when it is read."""
    kind = F.col(f"`{error}`")["error"]
    return output.withColumn("id", F.when(kind.isNotNull(), F.raise_error(F.concat(F.lit("Error record: "), kind)).cast("string")).otherwise(F.col("id"))).drop(error)


def split_errors(output: DataFrame, error: str = "__ERROR__") -> tuple[DataFrame, DataFrame]:
    """(finished rows, error rows) of a task's output."""
    return output.where(F.col(f"`{error}`").isNull()), output.where(F.col(f"`{error}`").isNotNull())
