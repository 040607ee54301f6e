"""Readers: JSON lines, manifests, registries, experiment logs, recipes, Markdown, hashes."""

from __future__ import annotations

import importlib.util
import os
import sys
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.names import short_hash
from ..operators.prep import Recipe, numbered
from ..storage import path_hash, written


def read_strict(spark: SparkSession, path, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_samples(spark: SparkSession, path) -> DataFrame:
    return read_strict(spark, path, S.TRAIN_SAMPLE)


def read_task_output(spark: SparkSession, path) -> DataFrame:
    return read_strict(spark, path, S.TASK_OUTPUT)


def read_lenient(spark: SparkSession, path, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON lines; malformed ones are kept apart, as text in column raw."""
    schema = S.struct(schema) if isinstance(schema, str) else T.StructType(list(schema.fields))
    both = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("raw"), F.from_json("value", schema.add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    fine = F.col("row").isNotNull() & F.col("row._bad").isNull()
    return both.where(fine).select("row.*").drop("_bad"), both.where(~fine).select("raw")


def read_results(spark: SparkSession, path, include_raw: bool = False) -> DataFrame:
    """Index rows of the supported version; with include_raw all lines, raw beside them, and valid."""
    schema = S.struct(S.EVAL_RESULT)
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("raw"), F.from_json("value", schema).alias("row"))
    valid = F.coalesce((F.col("row.version") == S.RESULT_VERSION) & F.col("row.id").isNotNull() & F.col("row.eval.name").isNotNull(), F.lit(False))
    typed = lines.withColumn("valid", valid)
    return typed.select("row.*", "raw", "valid") if include_raw else typed.where("valid").select("row.*")


def count_lines(spark: SparkSession, path) -> int:
    """All lines, blank and malformed ones included."""
    return spark.read.text(path).count()


def read_eval_samples(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Samples from JSON lines or Parquet; the hub's data sets are read from a local copy."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)


def file_hashes(spark: SparkSession, path) -> DataFrame:
    """path, hash (16 hex digits of the SHA-256 of the bytes) of each file; the executors read."""
    return spark.read.format("binaryFile").load(path).select("path", short_hash(F.col("content")).alias("hash"))


def directory_hash(folder: str) -> str:
    """One hash over relative paths and contents, in order of paths."""
    return path_hash(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """name (path below folder without .md), text of all Markdown files."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    top = f"{os.path.abspath(folder).rstrip('/')}/"
    name = F.regexp_replace(F.substring_index(F.url_decode("_metadata.file_path"), top, -1), r"\.md$", "")
    return files.select(name.alias("name"), F.col("value").alias("text"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """name, provider, model, temperature, sysprompt of a registry file."""
    entry = "struct<provider:string,model:string,params:struct<temperature:double>,sysprompt:string>"
    whole = spark.read.text(path, wholetext=True)
    models = whole.select(F.explode(F.map_entries(F.from_json("value", f"version int, models map<string,{entry}>")["models"])).alias("e"))
    return models.select("e.key", "e.value.provider", "e.value.model", "e.value.params.temperature", "e.value.sysprompt").withColumnRenamed("key", "name")


def read_metrics(spark: SparkSession, path, schema: T.StructType | str = S.METRICS) -> DataFrame:
    return spark.read.schema(schema).json(path)


_CHECKPOINT = "name string, path string, sampler_path string, batch long, epoch long"
_REGISTRY_ENTRY = "struct<provider:string,model:string,temperature:double>"


def _experiment() -> Column:
    return F.regexp_extract(F.url_decode("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("experiment")


def _documents(spark: SparkSession, logs: str, name: str, schema: str) -> DataFrame:
    """experiment and the fields of each experiment's JSON document of that name; none where no experiment has one."""
    files = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", name).option("recursiveFileLookup", True).json(logs)
    return files.select(_experiment(), "*")


def read_experiments(spark: SparkSession, logs: str) -> DataFrame:
    """experiment, checkpoint, path, base_model, renderer, provider, model, temperature, pos: the checkpoints of all experiments.

    An experiment counts if it has checkpoints and a training configuration with a base
    model. The renderer is the one of its builder's configuration (config.json), else the
    training configuration's. Trained by another backend, it gives one row, "final", with
    the model that its options or artifacts.json register, and none without one.
    """
    points = spark.read.schema(_CHECKPOINT).option("pathGlobFilter", "checkpoints.jsonl").option("recursiveFileLookup", True).json(logs)
    points = points.select(_experiment(), F.col("name").alias("checkpoint"), F.coalesce("sampler_path", "path").alias("path"), F.coalesce("batch", "epoch").alias("pos"))
    config = _documents(spark, logs, "train-config.json", f"base_model string, renderer string, backend string, backend_options struct<registry:{_REGISTRY_ENTRY}>").where("base_model <> ''")
    builder = _documents(spark, logs, "config.json", "dataset_builder struct<common_config:struct<renderer_name:string>>").select("experiment", F.col("dataset_builder.common_config.renderer_name").alias("built"))
    artifacts = _documents(spark, logs, "artifacts.json", f"registry {_REGISTRY_ENTRY}").select("experiment", F.col("registry").alias("made"))
    known = config.join(builder, "experiment", "left").join(artifacts, "experiment", "left").withColumn("own", F.coalesce("backend", F.lit("tinker")) == "tinker").withColumn("entry", F.coalesce("backend_options.registry", "made"))
    none = lambda t: F.lit(None).cast(t)
    trained = points.join(known.where("own"), "experiment").select("experiment", "checkpoint", "path", "base_model", F.coalesce("built", "renderer").alias("renderer"), none("string").alias("provider"), none("string").alias("model"), none("double").alias("temperature"), "pos")
    other = known.where("not own and entry.model <> ''").join(points.select("experiment").distinct(), "experiment", "left_semi")
    return trained.union(other.select("experiment", F.lit("final"), none("string"), "base_model", none("string"), F.coalesce("entry.provider", F.lit("local")), "entry.model", "entry.temperature", none("long")))


def read_chat_rows(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1 in each file), messages, valid of each non-blank line; line counts blank ones."""
    here = F.monotonically_increasing_id()
    lines = written(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), here.alias("here")))
    # One row for each block of a file: its first number, and the lines of the blocks before it.
    blocks = lines.groupBy("file", "block").agg(F.min("here").alias("first"), F.count("*").alias("n"))
    upto = blocks.select("file", "block", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    parsed = F.from_json("value", f"messages array<{S.MESSAGE_DDL}>")
    placed = lines.join(upto, ["file", "block"]).where("trim(value) <> ''")
    return placed.select((F.col("here") - F.col("first") + F.col("before") + 1).alias("line"), parsed["messages"].alias("messages"), F.try_parse_json("value").isNotNull().alias("valid"))


def load_recipe(path: str) -> Recipe:
    """A dataset recipe from YAML."""
    raw = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(raw.get("categories"), dict):
        raise ValueError(f"{path}: 'categories' must be a mapping")
    return Recipe(raw["categories"], raw.get("mode", "simple"), raw.get("weights") or {}, raw.get("shuffle_seed", 42))


def recipe_rows(spark: SparkSession, recipe: Recipe) -> DataFrame:
    """category, kind, source."""
    rows = []
    for category, c in recipe.categories.items():
        pipelines = ["all"] if c.get("pipelines") == "all" else c.get("pipelines") or []
        rows += [(category, "pipeline", p) for p in pipelines] + [(category, "file", f) for f in c.get("files") or []]
    return spark.createDataFrame(rows, "category string, kind string, source string")


def list_recipes(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.yaml"))


def find_project(start: str, name: str = "corvid.yaml") -> Path | None:
    """The nearest folder upward that holds the project file."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        if (folder / name).exists():
            return folder
    return None


def project_models(path: str) -> list[dict]:
    """The models of a project file with their defaults; variants given as a list or a mapping."""
    raw = yaml.safe_load(Path(path).read_text()) or {}
    out = []
    for name, m in (raw.get("models") or {}).items():
        prompt = m.get("sysprompt")
        if prompt is None and m.get("sysprompt_file"):
            prompt = (Path(path).parent / m["sysprompt_file"]).read_text()
        variants = m.get("variants") or {}
        variants = {v: {} for v in variants} if isinstance(variants, list) else variants
        out.append({"name": name, "provider": m.get("provider", "openrouter"), "model": m["model"], "temperature": float(m.get("temperature", 0.7)), "sysprompt": prompt, "variants": sorted(variants)})
    return out


def merged(defaults: dict, user: dict) -> dict:
    """defaults with user's values; mappings merge one level deep."""
    return {k: {**defaults.get(k, {}), **v} if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v for k, v in (defaults | user).items()}


def concurrency(argument: int | None, declared: int | None, project: dict, default: int) -> int:
    """Workers: the argument, else what the class declares, else the project's setting, else the default."""
    return next(x for x in (argument, declared, project.get("concurrency"), default) if x is not None)


def positioned(df: DataFrame, *order: str) -> DataFrame:
    """df with pos, the place of each row in the order of the given columns."""
    return numbered(df, [F.col(c) for c in order])


def discover(folder: str, base: type) -> dict[str, type]:
    """The named subclasses of base that a folder's Python files define, by name; files that start with _ or do not load are passed over."""
    found: dict[str, type] = {}
    for path in sorted(Path(folder).glob("*.py")):
        if path.name.startswith("_"):
            continue
        spec = importlib.util.spec_from_file_location(f"{Path(folder).name}.{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        sys.modules[spec.name] = module
        try:
            spec.loader.exec_module(module)
        except Exception:  # a broken file must not hide the others
            sys.modules.pop(spec.name, None)
            continue
        found |= {x.name: x for x in vars(module).values() if isinstance(x, type) and issubclass(x, base) and x is not base and getattr(x, "name", "")}
    return found


def evaluations(project: dict[str, object], built_in: dict[str, object], prefix: str = "corvid:") -> dict[str, object]:
    """All evaluations by name: a project's own shadow built-in ones, which always answer to their prefixed name as well."""
    return {f"{prefix}{name}": e for name, e in built_in.items()} | built_in | project


def manifest_rows(spark: SparkSession, manifest: dict) -> DataFrame:
    """category, name, hash of a dataset manifest's sources; in the older flat form they stand for every category that the manifest names, else for category ""."""
    rows = [(c, s, v.get("hash")) for c, k in manifest.get("categories", {}).items() for s, v in k.get("sources", {}).items()]
    flat = [(s, v.get("hash")) for kind in manifest.get("sources", {}).values() for s, v in kind.items()]
    held = {(c, s) for c, s, _ in rows}
    rows += [(c, s, h) for c in manifest.get("categories", {}) or [""] for s, h in flat if (c, s) not in held]
    return spark.createDataFrame(rows, "category string, name string, hash string")
