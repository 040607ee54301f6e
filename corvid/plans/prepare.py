"""A dataset from its recipe: sources, checks, balancing, order, manifest; skipped while nothing has changed."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage as L
from ..operators import prep as P
from ..sources import readers as R
from ..sources import writers as W


def _sources(spark: SparkSession, recipe: P.Recipe, outputs: dict[str, str]) -> list[tuple[str, str, str]]:
    """category, source, path: pipelines by name among outputs ("all" stands for each), files as they are."""
    rows = R.recipe_rows(spark, recipe)
    found = spark.createDataFrame(list(outputs.items()) or [("", "")], "source string, path string")
    pipelines = P.resolve_sources(P.expand_all(rows.where("kind = 'pipeline'").select("category", "source"), found), found).select("category", "source", "path")
    files = rows.where("kind = 'file'").select("category", "source", F.col("source").alias("path"))
    return [tuple(r) for r in pipelines.union(files).orderBy("category", "source").collect()]


def _hashes(spark: SparkSession, sources: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """category, name, hash; a source's hash is its file's, or that of its files' names and hashes. One job for all."""
    files = None
    for category, name, path in sources:
        one = R.file_hashes(spark, path).select(F.lit(category).alias("category"), F.lit(name).alias("name"), F.substring_index("path", "/", -1).alias("file"), "hash")
        files = one if files is None else files.union(one)
    if files is None:
        return []
    whole = F.when(F.count("*") == 1, F.first("hash")).otherwise(W.multiset_hash(F.concat_ws("/", "file", "hash")))
    return [tuple(r) for r in files.groupBy("category", "name").agg(whole.alias("hash")).collect()]  # one row for each source


def status(spark: SparkSession, recipe_path: str, outputs: dict[str, str], target: str, pipelines: DataFrame | None = None) -> dict:
    """Whether the dataset at target is current, and if not, why; with the status of pipelines (owner, status) also which sources upstream are not current."""
    manifest = Path(f"{target}.manifest.json")
    old = json.loads(manifest.read_text()) if manifest.exists() else {"categories": {}, "recipe_hash": None}
    sources = _sources(spark, R.load_recipe(recipe_path), outputs)
    now = spark.createDataFrame(_hashes(spark, sources), "category string, name string, hash string")
    diff = L.manifest_diff(R.manifest_rows(spark, old), now)
    none = spark.createDataFrame([], "owner string")
    used = spark.createDataFrame([(s,) for _, s, _ in sources if s in outputs], "source string")
    stale = none if pipelines is None else L.upstream(used, pipelines)
    return L.dataset_status(manifest.exists(), Path(target).exists(), old.get("recipe_hash") != _recipe_hash(recipe_path), diff, stale)


def _recipe_hash(path: str) -> str:
    from hashlib import sha256

    return sha256(Path(path).read_bytes()).hexdigest()[:16]


def prepare_dataset(spark: SparkSession, recipe_path: str, outputs: dict[str, str], target: str, force: bool = False, think_tags: bool = True) -> tuple[bool, DataFrame]:
    """(made, report by category): writes samples in order and the manifest beside them, unless the dataset is current."""
    recipe = R.load_recipe(recipe_path)
    sources = _sources(spark, recipe, outputs)
    if not L.must_prepare(status(spark, recipe_path, outputs, target), force):
        return False, spark.createDataFrame([], "category string")
    combined = P.combine([(c, s, P.minimal(R.read_samples(spark, path))) for c, s, path in sources])
    samples, report = P.prepare(combined, recipe, think_tags)
    W.write_ordered(samples, target)
    counts = {(r.category, r.source): r["count"] for r in combined.groupBy("category", "source").count().collect()}
    rows = [(c, s, h, counts.get((c, s), 0)) for c, s, h in _hashes(spark, sources)]
    listed = spark.createDataFrame(rows, "category string, source string, hash string, n long")
    W.write_json(f"{target}.manifest.json", W.dataset_manifest(report, listed, _recipe_hash(recipe_path), recipe.mode, recipe.weights, recipe.shuffle_seed, spark.read.json(target).count()))
    return True, report


def project_status(latest_release: str | None, pipelines: DataFrame, datasets: DataFrame, experiments: DataFrame, recent: int = 3) -> DataFrame:
    """section, name, status: the release, pipelines and datasets (name, status), the most recent experiments (name, status)."""
    spark = pipelines.sparkSession
    release = spark.createDataFrame([("release", latest_release or "none", "")], "section string, name string, status string")
    part = lambda section, df: df.select(F.lit(section).alias("section"), "name", "status")
    return release.union(part("pipeline", pipelines)).union(part("dataset", datasets)).union(part("experiment", experiments.orderBy(F.col("name").desc()).limit(recent)))
