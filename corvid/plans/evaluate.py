"""An evaluation from samples to metrics and an index row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import judge as J
from ..functions import names as N
from ..functions.text import strip_thinking
from ..operators import evaluation as E
from ..operators import rollout as O
from ..operators.prep import numbered
from ..schema import EVAL_RESULT, GENERATION, RESULT_VERSION, struct
from ..storage import written


@dataclass
class Evaluation:
    """What is asked and how it is judged; subclasses may replace prompt, check and ids with columns of their own."""

    name: str
    prompt_template: str
    kind: str = "binary"  # binary: multiple choice against gold; scaled: a model judges from 1 to max_score
    gold: str = "answer"
    max_score: int = 1
    criteria: str = "Judge the response."
    fields: dict[str, str] = field(default_factory=dict)
    #: A judge of one's own, for kind "custom": (response, gold, prompt) to struct score, extracted, error.
    judge: Callable[[Column, Column, Column], Column] | None = None
    #: Metrics of one's own: aggregates over final_score, error, correct (final_score is 1) and score (final_score).
    aggregates: Callable[[], list[Column]] | None = None

    def prompt(self, samples: DataFrame) -> Column:
        return E.prompt_column(self.prompt_template, samples.columns)

    def check(self, samples: DataFrame) -> DataFrame:
        return E.require_fields(samples, *([self.gold] if self.kind == "binary" else []))

    def ids(self, samples: DataFrame) -> DataFrame:
        return E.sample_ids(samples)


def _ask(record: dict):
    answer = yield O.model_request([{"role": "user", "content": record["prompt"]}], record.get("_model"))
    if not answer.is_success:
        raise O.PipelineError(answer.error, "model_error")
    return O.Sample(record["id"], [{"role": "assistant", "content": answer.text}])


def _answers(records: DataFrame, client: Callable[[], O.ModelClient]) -> DataFrame:
    """id, response, error and its type of records (id, prompt, _model). Written at once: each call is made once, however often the answers are read."""
    out = O.rollout(records, _ask, client)
    e = F.col("__ERROR__")
    return written(out.select(F.coalesce("id", F.get_json_object(e["input_data"], "$.id")).alias("id"), F.element_at("messages", -1)["content"].alias("response"), e["message"].alias("error"), e["error"].alias("error_type")))


def run_eval(evaluation: Evaluation, samples: DataFrame, client: Callable[[], O.ModelClient], model: str, judge: Callable[[], O.ModelClient] | None = None, runs: int = 1, judges: int = 1, order: list[str] | None = None) -> DataFrame:
    """Generation rows: each sample asked ``runs`` times, each response judged once (multiple choice, or a judge of one's own) or ``judges`` times.

    All calls are made here, once each; the result reads what was answered.
    """
    mapped = evaluation.check(E.map_fields(samples, evaluation.fields))
    placed = evaluation.ids(numbered(mapped, [F.col(c) for c in order or mapped.columns[:1]]))
    asked = E.times(placed.select("sample_id", evaluation.prompt(placed).alias("prompt"), (F.col(evaluation.gold).cast("string") if evaluation.gold in placed.columns else F.lit(None).cast("string")).alias("gold")), runs)
    asked = asked.withColumn("id", F.concat_ws("#", "sample_id", "run"))
    answered = asked.join(_answers(asked.select("id", "prompt", F.lit(model).alias("_model")), client), "id")
    none = F.from_json(F.lit("[]"), struct(GENERATION)["judgments"].dataType)
    if evaluation.kind == "binary":
        v = F.when(F.col("error").isNull(), J.mc_verdict(F.col("response"), F.col("gold")))
        judged = answered.withColumn("v", v).select("*", F.col("v.score").alias("final_score"), F.col("v.extracted").alias("extracted"), none.alias("judgments"))
    elif evaluation.kind == "custom":
        v = F.when(F.col("error").isNull(), evaluation.judge(F.col("response"), F.col("gold"), F.col("prompt")))
        judged = answered.withColumn("v", v).select(*[c for c in answered.columns if c != "error"], F.coalesce("error", "v.error").alias("error"), F.col("v.score").cast("double").alias("final_score"), F.col("v.extracted").alias("extracted"), none.alias("judgments"))
    else:
        wanted = E.times(answered.where("error is null"), judges, "j").withColumn("jid", F.concat_ws("#", "id", "j"))
        question = J.judge_prompt(F.lit(evaluation.criteria), strip_thinking(F.col("response")), F.col("prompt"), evaluation.max_score)
        said = _answers(wanted.select(F.col("jid").alias("id"), question.alias("prompt"), F.lit(None).cast("string").alias("_model")), judge or client)
        a = F.when(F.col("error").isNull(), J.assessment(J.xml_entries(F.col("response"))))
        one = F.struct(
            F.lit(evaluation.name).alias("judge"), F.col("response").alias("raw"), F.col("a.score").cast("double").alias("score"),
            F.struct("a.analysis", "a.needs_review", "a.errors", "a.improvement", "a.extra").alias("parsed"), F.coalesce(F.concat(F.lit("Judge error: "), F.col("error")), F.col("a.error")).alias("error"),
        )
        by_id = said.withColumn("a", a).select(F.regexp_replace("id", "#[0-9]+$", "").alias("id"), F.col("id").alias("jid"), one.alias("one"))
        listed = by_id.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("jid", F.struct("one.judge", "one.raw", "one.score", "one.error").alias("plain")))), lambda x: x["jid"]).alias("order"), F.map_from_entries(F.collect_list(F.struct("jid", "one"))).alias("by"))
        listed = listed.select("id", F.transform("order", lambda k: F.element_at(F.col("by"), k)).alias("judgments"))
        judged = answered.join(listed, "id", "left").withColumn("judgments", F.coalesce("judgments", none)).withColumn("final_score", E.final_score(F.col("judgments"))).withColumn("extracted", F.lit(None).cast("string"))
    return judged.select(
        F.lit(evaluation.name).alias("_eval"), F.lit(RESULT_VERSION).alias("_version"), N.score_type(F.lit(evaluation.kind), F.lit(evaluation.max_score)).alias("_score_type"), F.lit(model).alias("model"),
        "sample_id", F.col("run").cast("int").alias("run"), "final_score", "prompt", "response", "gold", "extracted", "judgments", "error", F.when(F.col("error").isNotNull(), F.coalesce("error_type", F.lit("judge_error"))).alias("error_type"),
    )


def metrics(evaluation: Evaluation, generations: DataFrame) -> DataFrame:
    """One row of metrics: the evaluation's own, or as its kind has them."""
    if evaluation.aggregates is not None:
        return generations.withColumn("correct", F.col("final_score") == 1).withColumn("score", F.col("final_score")).agg(*evaluation.aggregates())
    if evaluation.kind == "binary":
        return generations.withColumn("correct", F.col("final_score") == 1).agg(*E.accuracy())
    return generations.withColumn("score", F.col("final_score")).agg(*E.runner_scored(evaluation.max_score))


def model_spec(registry: DataFrame, alias: str, configs: dict[str, dict] | None = None) -> dict:
    """The spec of a registered model; an unknown one has provider "unknown". configs: training configurations by experiment."""
    row = registry.where(F.col("name") == alias).select("*", N.model_mode(F.col("model"), F.col("sysprompt")).alias("mode"), N.short_hash(F.col("sysprompt")).alias("sha")).first()
    if row is None:
        return {"alias": alias, "mode": "base", "provider": "unknown", "model_id": alias}
    spec = {"alias": alias, "mode": row.mode, "provider": row.provider, "model_id": row.model}
    if "trained" in row.mode:
        base, renderer, *path = row.model.split("::")
        run = alias.split("-")[0].upper()
        known = (configs or {}).get(run, {})
        spec |= {"base_model": base, "renderer": renderer, "checkpoint": path[0] if path else None, "training_run": run, "training_data": known.get("data", "unknown"), "training_config": {"base_model": base, "data": "unknown"} | known}
    if "prompted" in row.mode:
        version = next((p for p in alias.split("-") if p.startswith("v") and "." in p), None)
        spec |= {"sysprompt_version": version, "sysprompt_sha": row.sha}
    return spec


def index_row(evaluation: Evaluation, generations: DataFrame, model: dict, judge: dict | None, dataset_size: int, runs: int = 1, judges: int = 1, dataset_sha: str | None = None, judge_prompt_sha: str | None = None, sampling: dict | None = None, note: str | None = None, at: datetime | None = None) -> DataFrame:
    """One row of EVAL_RESULT for a finished run."""
    spark = generations.sparkSession
    m = metrics(evaluation, generations).first()
    n = m.total // runs
    failed = {r.error_type: r.n for r in E.errors_by_type(generations).collect()}  # one row for each type of error
    moment = at or datetime.now()
    result_id = spark.range(1).select(N.new_result_id(F.lit(moment)).alias("id")).first().id
    sampled = {"temperature": None, "max_tokens": None} | (sampling or {})
    row = {
        "version": RESULT_VERSION, "id": result_id, "timestamp": moment, "model": model, "judge": judge,
        "eval": {"name": evaluation.name, "dataset_sha": dataset_sha or "unknown", "judge_prompt_sha": (judge_prompt_sha or "unknown") if judge else None, "dataset_size": dataset_size, "n_samples": n, "complete": n >= dataset_size},
        "model_sampling": sampled | {"runs_per_sample": runs}, "judge_sampling": {"judges_per_run": judges} if judge else None,
        "results": {"aggregation": "mean", "score": m.accuracy if evaluation.kind == "binary" else m.mean_score, "errors": {"total": m.failed, "by_type": failed}},
        "note": note, "archived": False,
    }
    return spark.createDataFrame([row], struct(EVAL_RESULT))
