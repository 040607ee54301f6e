"""Training sets and experiment logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.messages import chat_row_error, is_multi_turn
from ..functions.names import experiment_number, normalized_grad, progress, validation_loss

GRAD = "optim/unclipped_grad_l2:mean"


def chat_rows(rows: DataFrame) -> DataFrame:
    """rows (messages) with error: why one cannot train; null if it can."""
    return rows.withColumn("error", chat_row_error(F.col("messages")))


def has_multi_turn(rows: DataFrame) -> DataFrame:
    """One row, multi_turn: whether any row has more than one assistant turn."""
    return rows.agg(F.coalesce(F.bool_or(is_multi_turn(F.col("messages"))), F.lit(False)).alias("multi_turn"))


def steps(rows: int, test_size: int, batch_size: int, epochs: int, at_least_one: bool = False) -> dict[str, int]:
    """Step arithmetic of a run: whole batches; with at_least_one an epoch of less than one batch is one step."""
    if batch_size <= 0 or epochs <= 0:
        raise ValueError("batch_size and epochs must be positive")
    train = rows - test_size
    each = train // batch_size
    if at_least_one:
        each = max(1, each)
    return {"train_rows": train, "steps_per_epoch": each, "total_steps": each * epochs}


def steps_columns(counts: DataFrame, test_size: int, batch_size: int, epochs: int, at_least_one: bool = False) -> DataFrame:
    """counts (rows) with train_rows, steps_per_epoch, total_steps."""
    each = F.floor(F.col("train_rows") / batch_size)
    out = counts.withColumn("train_rows", F.col("rows") - test_size).withColumn("steps_per_epoch", F.greatest(each, F.lit(1)) if at_least_one else each)
    return out.withColumn("total_steps", F.col("steps_per_epoch") * epochs)


def normalize_metrics(log: DataFrame) -> DataFrame:
    """log with the names that reports use; a name is filled only from columns that are there."""
    have = set(log.columns)
    pick = lambda *names: [F.col(f"`{n}`") for n in names if n in have]
    wanted = {"step": pick("step", "index"), "train_mean_nll": pick("train_mean_nll", "loss"), "val_mean_nll": pick("val_mean_nll", "eval_loss"), "test/nll": pick("test/nll", "eval_loss"), GRAD: pick(GRAD, "grad_norm")}
    return log.withColumns({n: F.coalesce(*c) for n, c in wanted.items() if c})


def curve(metrics: DataFrame, total_steps: int, parameters: int) -> DataFrame:
    """step, train_loss, grad, val_loss, progress of normalised metrics."""
    return metrics.select(
        "step", F.col("train_mean_nll").alias("train_loss"), normalized_grad(F.col(f"`{GRAD}`"), F.lit(parameters)).alias("grad"),
        validation_loss(F.col("val_mean_nll"), F.col("`test/nll`")).alias("val_loss"), progress(F.col("step"), F.lit(total_steps)).alias("progress"),
    )


def final_values(curve_: DataFrame) -> DataFrame:
    """One row: the last non-null value of each series."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step"))).alias(f"final_{c}")
    return curve_.agg(F.max("step").alias("last_step"), last("train_loss"), last("val_loss"), last("grad"))


def last_checkpoints(checkpoints: DataFrame, n: int = 5) -> DataFrame:
    """The last n checkpoints of each experiment, in file order, with earlier: how many more there are."""
    w = Window.partitionBy("experiment")
    ranked = checkpoints.withColumn("_rank", F.row_number().over(w.orderBy(F.col("pos").desc())))
    sums = checkpoints.groupBy("experiment").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("earlier"))
    return ranked.where(F.col("_rank") <= n).drop("_rank").join(sums, "experiment")


def experiment_status(experiments: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """experiments (experiment) with status: done if the last checkpoint line holds "final", in progress with any, else not started."""
    last = checkpoints.groupBy("experiment").agg(F.max_by("line", "pos").alias("_line"))
    status = F.when(F.col("_line").isNull(), "not started").when(F.contains("_line", F.lit("final")), "done").otherwise("in progress")
    return experiments.join(last, "experiment", "left").withColumn("status", status).drop("_line")


def next_experiment(names: DataFrame) -> DataFrame:
    """One row, name: the next experiment's (e001 if there is none); names that are no experiments are passed over."""
    return names.agg(F.format_string("e%03d", F.coalesce(F.max(experiment_number(F.col("name"))), F.lit(0)) + 1).alias("name"))


def recent_experiments(names: DataFrame, n: int, newest_first: bool) -> DataFrame:
    """The last n experiments by name, newest first or oldest first."""
    last = names.orderBy(F.col("name").desc()).limit(n)
    return last if newest_first else last.orderBy("name")


# Defaults of a training run.
DEFAULTS = {"batch_size": 32, "lora_rank": 32, "max_length": 8192, "epochs": 1, "lr_schedule": "linear", "test_size": 0}
POSITIVE = ("epochs", "batch_size", "lora_rank", "max_length")


def config_from(values: dict, overrides: dict | None = None) -> dict:
    """A run's configuration: dashes in names become underscores, non-null overrides win, then rules are checked."""
    plain = lambda d: {k.replace("-", "_"): v for k, v in (d or {}).items()}
    out = DEFAULTS | plain(values) | {k: v for k, v in plain(overrides).items() if v is not None}
    for name in POSITIVE:
        if not isinstance(out[name], int) or out[name] <= 0:
            raise ValueError(f"{name} must be a positive integer")
    for name in ("base_model", "data"):
        if not out.get(name):
            raise ValueError(f"{name} must not be empty")
    if out["test_size"] < 0:
        raise ValueError("test_size must not be negative")
    return out
