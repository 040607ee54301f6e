"""The results index: visibility, ids, ranking, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_short_id, short_id

#: Columns that make two runs comparable.
CONFIG = ("eval", "dataset_sha", "judge_prompt_sha", "judge", "temperature", "max_tokens", "runs_per_sample", "judge_temperature", "judges_per_run", "n_samples")


def visible(results: DataFrame, include_all: bool = False, model: str | None = None, evaluation: str | None = None, training_run: str | None = None) -> DataFrame:
    """Complete rows that are not archived (or all), of one model, eval or training run if given."""
    out = results if include_all else results.where("complete and not archived")
    for name, value in (("model", model), ("eval", evaluation), ("training_run", training_run)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def hidden_counts(overlapping: bool = False) -> list[Column]:
    """Aggregates: how many rows the default view hides, archived first; overlapping counts a row for both reasons."""
    partial = ~F.col("complete") if overlapping else ~F.col("complete") & ~F.col("archived")
    return [F.count_if("archived").alias("archived"), F.count_if(partial).alias("partial")]


def by_id(results: DataFrame, wanted: str) -> DataFrame:
    """The rows that an id, full or short, names: none, one, or several if it is ambiguous."""
    short = results.sparkSession.range(1).select(is_short_id(F.lit(wanted)).alias("s")).first().s
    return results.where(short_id(F.col("id")) == wanted) if short else results.where(F.col("id") == wanted).limit(1)


def of_experiment(results: DataFrame, experiment: str, alias: str = "alias") -> DataFrame:
    """Rows whose alias is the experiment's name or starts with it and a dash, in any case."""
    a, e = F.lower(F.col(alias)), experiment.lower()
    return results.where((a == e) | F.startswith(a, F.lit(f"{e}-")))


def run_numbers(results: DataFrame, by: list[str]) -> DataFrame:
    """results with run: the chronological number of each run within by, and runs: how many there are.

    Runs that share timestamp and id stand by pos, their place in the index, where results has it; nulls come last.
    """
    w = Window.partitionBy(*by)
    order = [F.col(c).asc_nulls_last() for c in ("timestamp", "id", "pos") if c != "pos" or c in results.columns]
    return results.withColumn("run", F.row_number().over(w.orderBy(*order))).withColumn("runs", F.count("*").over(w))


def compare(results: DataFrame, models: list[str], config: list[str]) -> DataFrame:
    """For each configuration and run number, a column of scores for each model, and delta (last less first): a full outer join on run numbers."""
    runs = run_numbers(results.where(F.col("model").isin(models)), [*config, "model"])
    table = runs.groupBy(*config, "run").pivot("model", models).agg(F.first("score"))
    return table.withColumn("delta", F.col(f"`{models[-1]}`") - F.col(f"`{models[0]}`"))


def latest(results: DataFrame, n: int, by: str) -> DataFrame:
    """The n most recent rows of each group, with rank and earlier: how many more there are."""
    w = Window.partitionBy(by)
    ranked = results.withColumn("rank", F.row_number().over(w.orderBy(F.col("timestamp").desc(), F.col("id").desc())))
    sums = results.groupBy(by).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("earlier"))
    return ranked.where(F.col("rank") <= n).join(sums, by)  # the rank filter runs before and after the shuffle


def newest_first(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("timestamp").desc(), "id")


def groups_in_order(results: DataFrame, config: list[str], name: str = "eval") -> DataFrame:
    """One row for each configuration, by eval, then by first appearance."""
    return results.groupBy(*config).agg(F.count("*").alias("runs"), F.min("pos").alias("first_pos")).orderBy(name, "first_pos")


def pair_diff(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """field, a, b where two single rows differ (as text)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("v")) for f in fields])
    side = lambda df, name: df.limit(1).select(F.inline(pairs)).withColumn("side", F.lit(name))
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("v"))).alias(name)
    both = side(a, "a").union(side(b, "b")).groupBy("field").agg(of("a"), of("b"))
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("field", "a", "b")


def latest_versions(index: DataFrame) -> DataFrame:
    """The last version of each id in an append-only index (columns id, updated_at, pos)."""
    w = Window.partitionBy("id").orderBy(F.col("updated_at").desc(), F.col("pos").desc())
    return index.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
