"""Writers: samples, manifests, evaluation details, the results index, registries."""

from __future__ import annotations

import json
import shutil
import uuid
from datetime import datetime
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import short_hash
from ..operators.registry import validate_release


def write_samples(samples: DataFrame, path: str, annotated: bool = False) -> None:
    """JSON lines of a pipeline's output, whole or id and messages alone."""
    (samples if annotated else samples.select("id", "messages")).write.mode("overwrite").json(path)


def write_ordered(samples: DataFrame, path: str) -> None:
    """Samples in their order: part files by range, rows within them in order."""
    samples.write.mode("overwrite").json(path)


def write_json(path: str, value: dict) -> None:
    """A small document, replaced as a whole."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    new = at.with_name(f".{at.name}.{uuid.uuid4().hex}")
    new.write_text(json.dumps(value, indent=2, sort_keys=True, default=str))
    new.replace(at)


def pipeline_manifest(name: str, code_hash: str, deps: dict[str, dict], records: int, partial: bool) -> dict:
    return {"pipeline": name, "code_hash": code_hash, "deps": deps, "record_count": records, "partial": partial, "created_at": datetime.now().isoformat()}


def dataset_manifest(report: DataFrame, sources: DataFrame, recipe_hash: str, mode: str, weights: dict, seed: int, output_rows: int) -> dict:
    """What a dataset was made of: report by category (category, raw, target), sources (category, source, hash, n)."""
    by_category: dict[str, dict] = {r.category: {"total_samples": r.raw, "samples_used": r.target, "sources": {}} for r in report.collect()}
    for r in sources.collect():
        by_category[r.category]["sources"][r.source] = {"hash": r.hash, "count": r.n}
    return {"recipe_hash": recipe_hash, "mode": mode, "weights": weights, "shuffle_seed": seed, "categories": by_category, "output": {"total_samples": output_rows}}


def content_hash(rows: DataFrame, key: str, value: Column) -> str:
    """A hash of a table's content whatever its order."""
    return rows.agg(multiset_hash(F.concat_ws("\x1f", F.col(key).cast("string"), value)).alias("h")).first().h


def multiset_hash(value: Column) -> Column:
    """An aggregate: a hash of all values, repeats counted, whatever their order. Sums of the parts of each value's SHA-256, so it is added up before any shuffle."""
    digest = F.sha2(value, 256)
    sums = [F.sum(F.conv(F.substring(digest, 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return short_hash(F.concat_ws(":", F.count("*").cast("string"), *sums))


def write_eval(generations: DataFrame, summary: dict, folder: str, name: str) -> dict[str, str]:
    """Details as JSON lines and the summary beside them."""
    paths = {"detail": f"{folder}/{name}", "summary": f"{folder}/{name}-summary.json"}
    generations.write.mode("overwrite").json(paths["detail"])
    write_json(paths["summary"], summary)
    return paths


def append_results(results: DataFrame, path: str) -> None:
    """Rows added to the index; each write adds files of its own, so writers need no lock."""
    results.withColumn("updated_at", F.current_timestamp()).write.mode("append").json(path)


def write_registry(registry: DataFrame, path: str) -> None:
    models = {r.name: {"provider": r.provider, "model": r.model, "params": {"temperature": r.temperature}, "sysprompt": r.sysprompt} for r in registry.collect()}
    write_json(path, {"version": 1, "models": models})


def output_paths(base: str, name: str) -> dict[str, str]:
    """Where a pipeline's output and its manifest stand."""
    if not name:
        raise ValueError("a pipeline needs a name")
    return {"output": f"{base}/{name}.jsonl", "manifest": f"{base}/{name}.manifest.json"}


def prepared_paths(data: str, name: str) -> dict[str, str]:
    """Where a recipe's dataset stands."""
    return output_paths(f"{data}/prepared", name)


def record_paths(name: str, given: str | None = None, cache: str = "pipelines/.cache", data: str = "training/data") -> dict[str, str]:
    """Where a record task reads (the file it names, else the cache) and writes."""
    return {"input": given or f"{cache}/{name}.jsonl", "output": output_paths(data, name)["output"]}


def experiment_path(logs: str, name: str) -> str:
    return f"{logs}/{name}"


def release_prompts(versions: str, version: str, project: str) -> str:
    """The prompts in versions/dev copied to a new version that the project file then names as its release; the new folder."""
    new = Path(versions) / validate_release(version, {p.name for p in Path(versions).iterdir() if p.is_dir()})
    shutil.copytree(Path(versions) / "dev", new)
    settings = yaml.safe_load(Path(project).read_text()) or {}
    settings.setdefault("identity", {})["release_version"] = version
    Path(project).write_text(yaml.safe_dump(settings, sort_keys=False))
    return str(new)


def copy_manifest(dataset: str, experiment: str) -> bool:
    """Copies a prepared dataset's manifest to the experiment; only datasets in a folder named prepared have one."""
    at = Path(dataset)
    source = at.with_suffix(".manifest.json")
    if at.parent.name != "prepared" or not source.exists():
        return False
    (Path(experiment) / "dataset.manifest.json").write_text(source.read_text())
    return True
