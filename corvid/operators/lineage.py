"""Lineage: which outputs are out of date, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """category, name, status (New, Changed, Removed) of sources that differ between two manifests (category, name, hash)."""
    o = old.select("category", "name", F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
    n = new.select("category", "name", F.col("hash").alias("new_hash"), F.lit(True).alias("now"))
    both = o.join(n, ["category", "name"], "full_outer")
    status = F.when(F.col("was").isNull(), "New").when(F.col("now").isNull(), "Removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "Changed")
    return both.select("category", "name", status.alias("status")).where("status is not null")


def dependency_changes(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """owner, attr, change of dependencies (owner, attr, type, hash) against the manifest: changed, new, or removed."""
    m = manifest.select("owner", "attr", F.col("hash").alias("old"), F.lit(True).alias("was"))
    c = current.select("owner", "attr", F.col("hash").alias("new"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return m.join(c, ["owner", "attr"], "full_outer").select("owner", "attr", change.alias("change")).where("change is not null")


def pipeline_status(pipelines: DataFrame, changes: DataFrame) -> DataFrame:
    """owner, reasons, status of pipelines (owner, has_manifest, has_output, partial, old_code, new_code and, optionally, fault).

    Without a manifest or an output that is the only reason. status: STALE, PARTIAL (partial
    is the only reason), CURRENT; ERROR, with the fault as its reason, where the state could not be told.
    """
    fault = F.col("fault") if "fault" in pipelines.columns else F.lit(None).cast("string")
    dep = changes.groupBy("owner").agg(F.array_sort(F.collect_list(F.concat("attr", F.lit(" "), "change"))).alias("deps"))
    reason = lambda test, text: F.when(test, F.lit(text))
    later = F.concat(F.array_compact(F.array(reason(F.col("partial"), "partial run"), reason(~F.col("old_code").eqNullSafe(F.col("new_code")), "code changed"))), F.coalesce("deps", F.array().cast("array<string>")))
    reasons = F.when(fault.isNotNull(), F.array(fault)).when(~F.col("has_manifest"), F.array(F.lit("no manifest"))).when(~F.col("has_output"), F.array(F.lit("output missing"))).otherwise(later)
    out = pipelines.join(dep, "owner", "left").withColumn("reasons", reasons)
    return out.select("owner", "reasons", F.when(fault.isNotNull(), "ERROR").otherwise(status_of(F.col("reasons"))).alias("status"))


def status_counts(status: DataFrame) -> DataFrame:
    """status, n."""
    return status.groupBy("status").agg(F.count("*").alias("n"))


def upstream(sources: DataFrame, status: DataFrame) -> DataFrame:
    """owner of the sources (source) whose pipeline is not current."""
    return source_staleness(sources, status).where("stale").select(F.col("source").alias("owner")).distinct()


def status_of(reasons: Column) -> Column:
    return F.when(F.size(reasons) == 0, "CURRENT").when((F.size(reasons) == 1) & (F.get(reasons, F.lit(0)) == "partial run"), "PARTIAL").otherwise("STALE")


def dataset_status(has_manifest: bool, has_output: bool, recipe_changed: bool, diff: DataFrame, stale_pipelines: DataFrame) -> dict:
    """status, reasons and, apart, the stale pipelines upstream, which do not make the dataset stale."""
    upstream = [r.owner for r in stale_pipelines.select("owner").distinct().orderBy("owner").collect()]
    if not has_manifest:
        return {"status": "NOT PREPARED", "reasons": ["no manifest"], "upstream": upstream}
    if not has_output:
        return {"status": "STALE", "reasons": ["output missing"], "upstream": upstream}
    found = [f"{r.status}: {r.category}/{r.name}" for r in diff.orderBy("category", "name").collect()]
    reasons = ["recipe changed"] * recipe_changed + found
    return {"status": "STALE" if reasons else "CURRENT", "reasons": reasons, "upstream": upstream}


def source_staleness(sources: DataFrame, status: DataFrame) -> DataFrame:
    """sources (source) with stale; a source whose pipeline is not found counts as stale."""
    return sources.join(status.select(F.col("owner").alias("source"), (F.col("status") != "CURRENT").alias("stale")), "source", "left").withColumn("stale", F.coalesce("stale", F.lit(True)))


def may_train(status: dict, allow_stale: bool = False) -> bool:
    """Whether training may start: the dataset and all its sources must be current, or staleness allowed."""
    return allow_stale or (status["status"] == "CURRENT" and not status["upstream"])


def must_prepare(status: dict, force: bool = False) -> bool:
    return force or status["status"] != "CURRENT"
