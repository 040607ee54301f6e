"""Dataset preparation: combine sources, validate, balance by category, sample, shuffle."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.messages import sample_validity
from ..functions.names import shuffle_key
from ..storage import written


@dataclass(frozen=True)
class Recipe:
    """Categories and their sources; mode "simple" (all of everything) or "weighted"; weights by category."""

    categories: dict[str, dict]
    mode: str = "simple"
    weights: dict[str, float] = field(default_factory=dict)
    shuffle_seed: int = 42

    def __post_init__(self):
        if not self.categories:
            raise ValueError("Recipe needs at least one category")
        if self.mode not in ("simple", "weighted"):
            raise ValueError(f"Unknown mode '{self.mode}'; valid: simple, weighted")
        for name, c in self.categories.items():
            if not has_source(c):
                raise ValueError(f"Category '{name}' has no pipelines or files")
        if self.mode == "weighted":
            missing, unknown = set(self.categories) - set(self.weights), set(self.weights) - set(self.categories)
            if missing or unknown:
                raise ValueError(f"Weights must name each category once; missing: {sorted(missing)}, unknown: {sorted(unknown)}")
            if any(w <= 0 for w in self.weights.values()):
                raise ValueError("Weights must be positive")


def has_source(category: dict) -> bool:
    return category.get("pipelines") == "all" or bool(category.get("pipelines")) or bool(category.get("files"))


def resolve_sources(wanted: DataFrame, discovered: DataFrame) -> DataFrame:
    """category, source (wanted) with path (discovered: source, path); a name that was not discovered raises when it is read."""
    found = wanted.join(discovered, "source", "left")
    return found.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("Unknown source: "), F.col("source"))).cast("string")))


def expand_all(categories: DataFrame, discovered: DataFrame) -> DataFrame:
    """category, source rows in which the source "all" stands for every discovered one."""
    # One list of names, as long as a project has sources, for the few categories that take all.
    names = discovered.agg(F.collect_set("source").alias("names"))
    every = categories.where("source = 'all'").agg(F.collect_set("category").alias("categories")).withColumn("names", names.scalar())
    every = every.select(F.explode("categories").alias("category"), "names").select("category", F.explode("names").alias("source"))
    return categories.where("source <> 'all'").select("category", "source").union(every).distinct()


def combine(sources: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """The union of (category, source, samples), in that order: order of the source, then id."""
    out = None
    for k, (category, source, df) in enumerate(sources):
        part = df.select(F.lit(category).alias("category"), F.lit(source).alias("source"), F.lit(k).alias("source_pos"), *df.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def minimal(samples: DataFrame) -> DataFrame:
    """id and messages; a row without one of them raises when it is read, with its place where samples have a pos."""
    at = F.concat(F.lit(" at "), F.col("pos")) if "pos" in samples.columns else F.lit("")
    fault = F.raise_error(F.concat(F.lit("Sample without id or messages"), at, F.lit(": "), F.coalesce(F.col("id"), F.lit("null"))))
    lacks = F.col("id").isNull() | F.col("messages").isNull()
    return samples.select(F.when(lacks, fault).otherwise(F.col("id")).alias("id"), F.when(lacks, fault).otherwise(F.col("messages")).alias("messages"))


def missing_fields(samples: DataFrame) -> DataFrame:
    """The rows that lack id or messages."""
    return samples.where("id is null or messages is null")


def numbered(df: DataFrame, order: list[Column], start: int = 0, name: str = "pos") -> DataFrame:
    """df with the place of each row in the given order.

    A range-partitioned sort, written once with each row's part and place in it; the rows
    before a part come from one count for each part, so no task sees all rows.
    """
    part, place, before = (free(df.columns, n) for n in ("part", "place", "before"))
    here = F.monotonically_increasing_id()
    ranged = df.orderBy(*order).withColumns({part: F.shiftright(here, 33), place: here.bitwiseAND(F.lit((1 << 33) - 1))})
    held = written(ranged)
    counts = held.groupBy(part).agg(F.count("*").alias(before))
    upto = counts.select(part, (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before))  # one row for each part
    return held.join(upto, part).withColumn(name, F.col(place) + F.col(before) + start).select(*[F.col(f"`{c}`") for c in df.columns], name)


def free(taken: list[str], name: str) -> str:
    """name, with as many underscores before it as no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def fill_ids(records: DataFrame, pos: str = "pos", prefix: str = "record") -> DataFrame:
    """records whose missing ids are prefix-{pos}."""
    return records.withColumn("id", F.coalesce(F.col("id").cast("string"), F.concat(F.lit(f"{prefix}-"), F.col(pos))))


def validate(samples: DataFrame, think_tags: bool = True) -> DataFrame:
    """samples with reason: why one does not fit, null if it does. Without think_tags all fit."""
    return samples.withColumn("reason", sample_validity(F.col("messages")) if think_tags else F.lit(None).cast("string"))


def rejections(validated: DataFrame) -> DataFrame:
    """reason, n, in order of reasons."""
    return validated.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def zero_yield(validated: DataFrame, *by: str) -> DataFrame:
    """Sources that had rows of which none fits."""
    counts = validated.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("valid"))
    return counts.where("n > 0 and valid = 0")


def category_totals(counts: DataFrame) -> DataFrame:
    """category, total from category, n (one row for each source)."""
    return counts.groupBy("category").agg(F.sum("n").alias("total"))


def balance(totals: DataFrame) -> DataFrame:
    """category, total, weight, target: as many of each category as the scarcest, in proportion to the weights, allows.

    Weights are normalised first, in doubles, and targets are truncated. One row for each
    category, so the windows over all rows are small.
    """
    every = Window.partitionBy()
    share = F.col("weight") / F.sum("weight").over(every)
    least = totals.withColumn("share", share).withColumn("least", F.min(F.col("total") / F.col("share")).over(every))
    return least.select("category", "total", "weight", (F.col("least") * F.col("share")).cast("int").alias("target"))


def sample_exactly(rows: DataFrame, targets: DataFrame, seed: int, key: str = "id", by: str = "category", buckets: int = 256) -> DataFrame:
    """Exactly target rows (all, if fewer) of each category, the first by the seed's order.

    The order is the hash shuffle_key; a null id counts as the empty text, rows with one id
    stand in the order of their other values. A null category is one like any other. Rank
    windows run within a category's hash buckets; bucket counts before the shuffle tell
    which buckets are in, out, or cut, so no category is ever sorted in one task.
    """
    ranked, chosen = _chosen(rows, targets, seed, key, by, buckets)
    return ranked.where(F.col(chosen)).select(*[F.col(f"`{c}`") for c in rows.columns])


def _chosen(rows: DataFrame, targets: DataFrame, seed: int, key: str, by: str, buckets: int) -> tuple[DataFrame, str]:
    """rows of the categories of targets with a boolean column, and its name: whether a row is one of the target first of its category."""
    at, bucket, rank, n, before, target, plan_by, chosen = (free([*rows.columns, *targets.columns], x) for x in ("at", "bucket", "rank", "n", "before", "goal", "plan_by", "chosen"))
    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    hashed = rows.withColumn(at, shuffle_key(seed, named)).withColumn(bucket, F.floor(F.conv(F.substring(at, 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))
    sums = hashed.groupBy(F.col(f"`{by}`").alias(plan_by), F.col(bucket).alias(f"{bucket}_")).agg(F.count("*").alias(n))
    sums = sums.withColumn(before, F.sum(n).over(Window.partitionBy(plan_by).orderBy(f"{bucket}_")) - F.col(n))
    goal = targets.select(F.col(f"`{by}`").alias(f"{plan_by}_"), F.col("target").alias(target))
    plan = sums.join(goal, F.col(plan_by).eqNullSafe(F.col(f"{plan_by}_"))).drop(f"{plan_by}_", n)
    rest = F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t and "variant" not in t])
    ranked = hashed.withColumn(rank, F.row_number().over(Window.partitionBy(F.col(f"`{by}`"), bucket).orderBy(at, F.col(f"`{key}`"), rest)))
    joined = ranked.join(plan, F.col(f"`{by}`").eqNullSafe(F.col(plan_by)) & (F.col(bucket) == F.col(f"{bucket}_")))
    return joined.withColumn(chosen, F.col(before) + F.col(rank) <= F.col(target)), chosen


def shuffled(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """rows in the seed's order (a range-partitioned sort)."""
    return rows.orderBy(shuffle_key(seed, F.col(key)), key)


def first_shuffled(rows: DataFrame, seed: int, n: int, key: str = "id") -> DataFrame:
    """The first n rows in the seed's order."""
    return shuffled(rows, seed, key).limit(n)


def train_val_split(rows: DataFrame, test_size: int, seed: int, key: str = "id") -> DataFrame:
    """rows with split: val for the first test_size in the seed's order, else train.

    At least one row must remain to train on. Rows are split each for itself: repeated ids
    stand in the order of their other values, a null id counts as the empty text.
    """
    if test_size < 0:
        raise ValueError("test_size must not be negative")
    if test_size and test_size >= (n := rows.count()):
        raise ValueError(f"test_size {test_size} leaves no row of {n} to train on")
    every = free(rows.columns, "every")
    one = rows.withColumn(every, F.lit("all"))
    goal = rows.sparkSession.range(1).select(F.lit("all").alias(every), F.lit(test_size).alias("target"))
    ranked, chosen = _chosen(one, goal, seed, key, every, 256)
    return ranked.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col(chosen), "val").otherwise("train").alias("split"))


def exact_sample_positions(total: int, k: int, seed: int) -> list[int]:
    """Positions that Python's own generator samples; for sets small enough for the driver."""
    return random.Random(seed).sample(range(total), min(k, total))


def exact_shuffle_positions(total: int, seed: int) -> list[int]:
    order = list(range(total))
    random.Random(seed).shuffle(order)
    return order


def prepare(combined: DataFrame, recipe: Recipe, think_tags: bool = True, balance_on: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(samples in order, report by category) of combined rows (category, source, id, messages).

    Targets follow raw counts (before validation) or, with balance_on="valid", counts of
    fitting rows.
    """
    checked = validate(combined, think_tags)
    counts = checked.groupBy("category").agg(F.count("*").alias("raw"), F.count_if(F.col("reason").isNull()).alias("valid"))
    kept = checked.where("reason is null").drop("reason")
    if recipe.mode == "weighted":
        weights = combined.sparkSession.createDataFrame(list(recipe.weights.items()), "category string, weight double")
        targets = balance(counts.withColumnRenamed(balance_on, "total").join(weights, "category"))
        kept = sample_exactly(kept, targets, recipe.shuffle_seed)
        report = counts.join(targets.select("category", "weight", "target"), "category")
    else:
        report = counts.withColumn("weight", F.lit(None).cast("double")).withColumn("target", F.col("raw").cast("int"))
    return shuffled(kept, recipe.shuffle_seed).select("id", "messages"), report
