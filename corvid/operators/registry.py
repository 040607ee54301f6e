"""Model registries: overlay, routing, aliases, catalog, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import checkpoint_name, model_class, model_string, organization

#: Model families by a part of their name, in order of precedence: renderer, and whether it thinks (null: both).
FORMATS = (
    ("deepseek-v3", "deepseekv3_thinking", True),
    ("deepseek-v3", "deepseekv3", False),
    ("qwen3", "qwen3", None),
    ("kimi", "kimi_k2", None),
)

# Public base models; name, size, training type, architecture, renderer, whether it chats, whether it sees.
METADATA = (
    ("deepseek-ai/DeepSeek-V3.1", "671B-A37B", "Hybrid", "MoE", "deepseekv3", True, False),
    ("deepseek-ai/DeepSeek-V3.1-Base", "671B-A37B", "Base", "MoE", "role_colon", False, False),
    ("moonshotai/Kimi-K2-Thinking", "1T-A32B", "Reasoning", "MoE", "kimi_k2", True, False),
    ("meta-llama/Llama-3.1-70B", "70B", "Base", "Dense", "role_colon", False, False),
    ("meta-llama/Llama-3.1-8B", "8B", "Base", "Dense", "role_colon", False, False),
    ("meta-llama/Llama-3.1-8B-Instruct", "8B", "Instruction", "Dense", "llama3", True, False),
    ("meta-llama/Llama-3.2-1B", "1B", "Base", "Dense", "role_colon", False, False),
    ("meta-llama/Llama-3.2-3B", "3B", "Base", "Dense", "role_colon", False, False),
    ("meta-llama/Llama-3.3-70B-Instruct", "70B", "Instruction", "Dense", "llama3", True, False),
    ("Qwen/Qwen3-235B-A22B-Instruct-2507", "235B-A22B", "Instruction", "MoE", "qwen3_instruct", True, False),
    ("Qwen/Qwen3-30B-A3B", "30B-A3B", "Hybrid", "MoE", "qwen3", True, False),
    ("Qwen/Qwen3-30B-A3B-Base", "30B-A3B", "Base", "MoE", "role_colon", False, False),
    ("Qwen/Qwen3-30B-A3B-Instruct-2507", "30B-A3B", "Instruction", "MoE", "qwen3_instruct", True, False),
    ("Qwen/Qwen3-32B", "32B", "Hybrid", "Dense", "qwen3", True, False),
    ("Qwen/Qwen3-4B-Instruct-2507", "4B", "Instruction", "Dense", "qwen3_instruct", True, False),
    ("Qwen/Qwen3-8B", "8B", "Hybrid", "Dense", "qwen3", True, False),
    ("Qwen/Qwen3-8B-Base", "8B", "Base", "Dense", "role_colon", False, False),
    ("Qwen/Qwen3-VL-235B-A22B-Instruct", "235B-A22B", "Vision", "MoE", "qwen3_vl_instruct", True, True),
    ("Qwen/Qwen3-VL-30B-A3B-Instruct", "30B-A3B", "Vision", "MoE", "qwen3_vl_instruct", True, True),
    ("openai/gpt-oss-120b", "117B-A5.1B", "Reasoning", "MoE", "gpt_oss_no_sysprompt", True, False),
    ("openai/gpt-oss-20b", "21B-A3.6B", "Reasoning", "MoE", "gpt_oss_no_sysprompt", True, False),
)


def metadata(spark: SparkSession) -> DataFrame:
    """What is known of public base models."""
    return spark.createDataFrame(list(METADATA), "name string, size string, training_type string, architecture string, renderer string, chat boolean, vision boolean")


def catalog_model(models: DataFrame, name: str) -> DataFrame:
    """The one model of exactly this name, or none."""
    return models.where(F.col("name") == name).limit(1)


def overlay(*layers: DataFrame) -> DataFrame:
    """The union of layers (name, ...) in which a later layer replaces a name; within a layer the last row by pos."""
    out = None
    for k, layer in enumerate(layers):
        part = layer.withColumn("priority", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    order = Window.partitionBy("name").orderBy(F.col("priority").desc(), F.col("pos").desc())
    return out.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "pos")


def checkpoint_layer(checkpoints: DataFrame, temperature: float, pos: str = "pos") -> DataFrame:
    """Registry rows of checkpoints (experiment, checkpoint, base_model, renderer, path, provider, model, temperature, pos)."""
    own = F.col("provider").isin("local", "openai_compatible")
    return checkpoints.select(
        checkpoint_name(F.col("experiment"), F.col("checkpoint")).alias("name"),
        F.when(own, F.col("provider")).otherwise("tinker").alias("provider"),
        F.when(own, F.col("model")).otherwise(model_string(F.col("base_model"), F.col("renderer"), F.col("path"))).alias("model"),
        F.when(own, F.coalesce("temperature", F.lit(temperature))).otherwise(temperature).alias("temperature"),
        F.lit(None).cast("string").alias("sysprompt"), F.col(pos).alias("pos"),
    )


def version_layer(prompts: DataFrame, prefix: str, provider: str, model: str, temperature: float, release: str | None = None) -> DataFrame:
    """Registry rows of prompt versions (version, variant, sysprompt); of the release alone, under its alias, if named."""
    rows = prompts if release is None else prompts.where(F.col("version") == release)
    name = F.concat_ws("-", F.lit(prefix), F.col("version") if release is None else F.lit("release"), F.col("variant"))
    return rows.select(name.alias("name"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), "sysprompt", F.lit(0).cast("long").alias("pos"))


def versions(prompts: DataFrame, prefix: str, release: str) -> DataFrame:
    """version, variants, models, is_release, in order of versions."""
    listed = prompts.groupBy("version").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    models = F.transform("variants", lambda v: F.concat_ws("-", F.lit(prefix), F.col("version"), v))
    return listed.select("version", "variants", models.alias("models"), (F.col("version") == release).alias("is_release")).orderBy("version")


def version_names(names: DataFrame, version: Column) -> DataFrame:
    """Distinct versions, in descending order of their text (v0.9 before v0.10)."""
    return names.select(version.alias("version")).where("version is not null").distinct().orderBy(F.col("version").desc())


def class_counts(registry: DataFrame) -> DataFrame:
    """class, n: how many trained, prompted and plain models there are."""
    return registry.groupBy(model_class(F.col("provider"), F.col("model"), F.col("sysprompt")).alias("class")).agg(F.count("*").alias("n"))


def enrich(available: DataFrame, metadata: DataFrame) -> DataFrame:
    """Available models (name) with what is known of them (name, training_type, architecture, vision); unknown otherwise."""
    out = available.join(metadata, "name", "left")
    return out.select(
        "name", organization(F.col("name")).alias("organization"), F.coalesce("training_type", F.lit("unknown")).alias("training_type"),
        F.coalesce("architecture", F.lit("unknown")).alias("architecture"), F.coalesce("vision", F.lit(False)).alias("vision"),
    )


def catalog(models: DataFrame, training_type: str | None = None, architecture: str | None = None, contains: str | None = None) -> DataFrame:
    """The models of a type, an architecture and a part of the name (in any case), by organization and name."""
    out = models
    if training_type is not None:
        out = out.where(F.lower("training_type") == training_type.lower())
    if architecture is not None:
        out = out.where(F.lower("architecture") == architecture.lower())
    if contains is not None:
        out = out.where(F.contains(F.lower("name"), F.lit(contains.lower())))
    return out.orderBy("organization", "name")


def model_format(name: Column, thinking: bool = True) -> Column:
    """The renderer of the first family whose part the name holds; families with a thinking variant by ``thinking``."""
    out = F.lit(None).cast("string")
    for part, renderer, thinks in reversed(FORMATS):
        if thinks is None or thinks == thinking:
            out = F.when(F.contains(F.lower(name), F.lit(part)), renderer).otherwise(out)
    return out


def required_format(name: Column, thinking: bool = True) -> Column:
    """model_format; a name of no known family raises when it is read."""
    return F.coalesce(model_format(name, thinking), F.raise_error(F.concat(F.lit("No format for model: "), name)).cast("string"))


def route(requests: DataFrame, registry: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """requests (model) with provider, resolved model and fault: the name is unknown, or its provider is not supported."""
    known = registry.select(F.col("name").alias("model"), "provider", F.col("model").alias("model_resolved"))
    fault = F.when(F.col("provider").isNull(), F.concat(F.lit("Unknown model: "), F.coalesce("model", F.lit("null")))).when(~F.col("provider").isin(*supported), F.concat(F.lit("Unsupported provider: "), F.col("provider")))
    return requests.join(known, "model", "left").withColumn("fault", fault)


def resolve_alias(aliases: DataFrame, registry: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """aliases (alias) with model: the registry's, else the experiment log's (both name, model)."""
    r = registry.select(F.col("name").alias("alias"), F.col("model").alias("_r"))
    c = checkpoints.select(F.col("name").alias("alias"), F.col("model").alias("_c"))
    return aliases.join(r, "alias", "left").join(c, "alias", "left").withColumn("model", F.coalesce("_r", "_c")).drop("_r", "_c")


def release_aliases(registry: DataFrame, prefix: str, release: str) -> DataFrame:
    """alias, target: each release name and the versioned model it stands for."""
    start = f"{prefix}-{release}-"
    return registry.where(F.startswith("name", F.lit(start))).select(F.concat(F.lit(f"{prefix}-release-"), F.substring(F.col("name"), len(start) + 1, 1000)).alias("alias"), F.col("name").alias("target"))


def checkpoint_path(wanted: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """wanted (experiment, checkpoint) with path: the first of that name in the log (experiment, checkpoint, path, pos), else experiment/checkpoint."""
    first = checkpoints.groupBy("experiment", "checkpoint").agg(F.min_by("path", "pos").alias("path"))
    return wanted.join(first, ["experiment", "checkpoint"], "left").withColumn("path", F.coalesce("path", F.concat_ws("/", "experiment", "checkpoint")))


def validate_release(version: str, existing: set[str]) -> str:
    """The name of a new release: v..., not dev, not taken."""
    if not version.startswith("v"):
        raise ValueError(f"Version must start with 'v': {version}")
    if version == "dev" or version in existing:
        raise ValueError(f"Version exists: {version}")
    return version


def fill_template(template: str, values: dict[str, str]) -> str:
    """The template with {name} places filled; other braces stay."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", value)
    return template
