"""Ids, names, model specs, hashes and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- ids and hashes


def short_hash(x: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 16)


def short_id(result_id: Column) -> Column:
    """batch-YYYYMMDD-HHMMSS-xxxx as MMDD-xxxx; else the first 12 characters."""
    parts = F.split(result_id, "-")
    batch = (F.size(parts) >= 4) & (F.get(parts, F.lit(0)) == "batch")
    return F.when(batch, F.concat(F.substring(F.get(parts, F.lit(1)), 5, 4), F.lit("-"), F.element_at(parts, -1))).otherwise(F.substring(result_id, 1, 12))


def is_short_id(x: Column) -> Column:
    return x.rlike(r"(?i)\A[0-9]{4}-[0-9a-f]{4}\z")


def new_result_id(at: Column) -> Column:
    """A result id of this moment, with four random hex digits."""
    return F.concat(F.lit("batch-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.replace(F.uuid(), F.lit("-")), 1, 4))


def shuffle_key(seed: int, row_id: Column) -> Column:
    """The order of a seeded shuffle: the same in any engine and for any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


# ---------------------------------------------------------------- names


def base_name(x: Column) -> Column:
    """The last path segment, lower case."""
    return F.lower(F.element_at(F.split(x, "/"), -1))


def organization(model: Column) -> Column:
    return F.when(F.contains(model, F.lit("/")), F.substring_index(model, "/", 1)).otherwise("unknown")


def safe_file_name(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("::"), F.lit("-")), F.lit("/"), F.lit("-"))


def version_of_alias(alias: Column) -> Column:
    """The first part between dashes that starts with v and holds a dot; null without one."""
    return F.try_element_at(F.filter(F.split(alias, "-"), lambda p: F.startswith(p, F.lit("v")) & F.contains(p, F.lit("."))), F.lit(1))


def version_in_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"-(v[0-9]+\.[0-9]+)-", 1), F.lit(""))


def is_checkpoint_name(x: Column) -> Column:
    return x.rlike(r"(?i)\Ae[0-9]+-")


def is_experiment_spec(x: Column) -> Column:
    """The looser test of a spec: it has a dash and starts with e."""
    return F.contains(x, F.lit("-")) & F.startswith(F.lower(x), F.lit("e"))


def experiment_of(x: Column) -> Column:
    """struct experiment (upper case), checkpoint of a checkpoint's name."""
    first = F.substring_index(x, "-", 1)
    return F.struct(F.upper(first).alias("experiment"), F.regexp_extract(x, r"(?s)\A[^-]*-(.*)\z", 1).alias("checkpoint"))


def checkpoint_name(experiment: Column, checkpoint: Column) -> Column:
    return F.lower(F.when(checkpoint == "final", experiment).otherwise(F.concat(experiment, F.lit("-"), checkpoint)))


def experiment_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)\Ae([0-9]+)\z", 1), F.lit("")).cast("int")


def checkpoint_spec(spec: Column, default_renderer: str = "qwen3") -> Column:
    """struct base_model, renderer, path from base[::renderer[::path]]; more parts are an error."""
    parts = F.split(spec, "::")
    named = F.when(F.size(parts) > 3, F.raise_error(F.concat(F.lit("Invalid checkpoint spec: "), spec)).cast("string")).otherwise(F.get(parts, F.lit(0)))
    return F.struct(named.alias("base_model"), F.coalesce(F.get(parts, F.lit(1)), F.lit(default_renderer)).alias("renderer"), F.get(parts, F.lit(2)).alias("path"))


def is_valid_spec(spec: Column) -> Column:
    return F.size(F.split(spec, "::")) <= 3


def model_string(base: Column, renderer: Column, path: Column) -> Column:
    return F.concat_ws("::", base, F.coalesce(renderer, F.lit("qwen3")), path)


def model_mode(model_id: Column, sysprompt: Column) -> Column:
    """base, prompted, trained or prompted_trained."""
    trained, prompted = F.contains(model_id, F.lit("::")), F.coalesce(sysprompt != "", F.lit(False))
    return F.when(trained & prompted, "prompted_trained").when(trained, "trained").when(prompted, "prompted").otherwise("base")


def model_class(provider: Column, model: Column, sysprompt: Column) -> Column:
    """trained, prompted or plain, as registries list models."""
    prompted = F.coalesce(sysprompt != "", F.lit(False))
    return F.when((provider == "tinker") & F.contains(model, F.lit("::")) & ~prompted, "trained").when(prompted, "prompted").otherwise("plain")


def output_name(model: Column, evaluation: Column) -> Column:
    """The folder of a run's results: the experiment in the model's name, upper case, else the eval's name."""
    return F.coalesce(F.upper(F.nullif(F.regexp_extract(model, r"(?i)\A(e[0-9]+)-", 1), F.lit(""))), evaluation)


def score_type(kind: Column, max_score: Column) -> Column:
    return F.when(kind == "binary", "binary").when(kind == "scaled", F.concat(F.lit("scaled:"), max_score)).otherwise("unknown")


def header(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)


# Spellings of training backends and what they mean.
BACKENDS = {
    "tinker": "tinker",
    "unsloth": "unsloth",
    "usnloth": "unsloth",
    "axolotl": "axolotl",
    "axlotol": "axolotl",
    "prime": "prime",
    "prime_intellect": "prime",
    "primeintellect": "prime",
}


def backend(alias: Column) -> Column:
    """The backend that an alias (any case, spaces around, dashes or underscores) means; tinker for null or empty; null for an unknown one."""
    plain = F.replace(F.lower(F.trim(alias)), F.lit("-"), F.lit("_"))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in BACKENDS.items() for x in kv]), plain)
    return F.when(F.coalesce(alias, F.lit("")) == "", "tinker").otherwise(known)


# ---------------------------------------------------------------- numbers


def score_text(score: Column) -> Column:
    """Up to 1 as a percentage, above with two decimals."""
    return F.when(score <= 1, F.format_string("%.1f%%", score * 100)).otherwise(F.format_string("%.2f", score))


def delta_text(a: Column, b: Column) -> Column:
    """What b is more than a: in points of a percentage if a is at most 1 in size, else with two decimals."""
    return F.when(F.abs(a) <= 1, F.format_string("%+.1f%%", (b - a) * 100)).otherwise(F.format_string("%+.2f", b - a))


def correct_estimate(score: Column, n: Column) -> Column:
    return (score * n + 0.5).cast("int")


def normalized_grad(grad: Column, parameters: Column) -> Column:
    return grad / F.when(parameters > 0, F.sqrt(parameters)).otherwise(1.0)


def progress(step: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(step + 1, total), F.lit(0.0))


def validation_loss(val: Column, test: Column) -> Column:
    """val, unless it is null or 0; then test."""
    return F.coalesce(F.nullif(val, F.lit(0.0)), test)


def iso_encode(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_decode(x: Column) -> Column:
    return F.try_to_timestamp(x).cast("timestamp_ntz")


def config_diff(a: Column, b: Column) -> Column:
    """map of the keys whose values differ to struct a, b (both maps string to string)."""
    return F.map_filter(F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("a"), y.alias("b"))), lambda k, v: ~v["a"].eqNullSafe(v["b"]))
