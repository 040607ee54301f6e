"""Whole runs: an evaluation to its index row, a dataset to its manifest."""

import json

from pyspark.sql import functions as F

from corvid.operators import rollout as O
from corvid.operators.results import visible
from corvid.plans import evaluate as V
from corvid.plans import prepare as P
from corvid.schema import REGISTRY


class Answers:
    def complete(self, request):
        said = request.messages[-1]["content"]
        if "fail" in said:
            return O.Response(error="down")
        if said.startswith("Judge"):
            return O.Response("<analysis>ok</analysis>" + ("" if "two" in said else "<score>4</score>"))
        return O.Response("<think>x</think>Answer: " + ("A" if "one" in said else "B"))


def samples(spark):
    return spark.createDataFrame([("q1", "one", "A"), (None, "two", "A"), ("q3", "fail", "B")], "id string, Question string, answer string")


def test_multiple_choice_run(spark):
    e = V.Evaluation("mc", "{question}?", fields={"question": "Question"})
    rows = V.run_eval(e, samples(spark), Answers, "m", runs=2, order=["Question"]).cache()
    assert rows.count() == 6
    got = {(r.sample_id, r.run): (r.final_score, r.extracted, r.error) for r in rows.collect()}
    assert got[("q1", 1)] == (1.0, "A", None) and got[("sample-2", 2)] == (0.0, "B", None) and got[("q3", 1)] == (None, None, "down")
    m = V.metrics(e, rows).first()
    assert (m.total, m.completed, m.failed, m.correct, m.accuracy) == (6, 4, 2, 2, 0.5)
    registry = spark.createDataFrame([("e001-final", "tinker", "b::r::p", 0.3, None)], REGISTRY)
    row = V.index_row(e, rows, V.model_spec(registry, "e001-final"), None, 3, runs=2).first()
    assert row.eval.complete and row.eval.n_samples == 3 and row.results.score == 0.5 and row.results.errors.by_type == {"model_error": 2}
    assert row.model.mode == "trained" and row.model.training_run == "E001" and row.eval.dataset_sha == "unknown"
    assert V.model_spec(registry, "zz")["provider"] == "unknown"


def test_scaled_run(spark):
    e = V.Evaluation("scaled", "Question", kind="scaled", max_score=5)
    rows = V.run_eval(e, samples(spark), Answers, "m", judges=3, order=["Question"]).cache()
    got = {r.prompt: r for r in rows.collect()}
    assert got["one"].final_score == 4.0 and len(got["one"].judgments) == 3 and got["one"]._score_type == "scaled:5"
    assert got["two"].final_score is None and got["two"].judgments[0].error == "No score found" and got["fail"].error == "down"
    m = V.metrics(e, rows).first()
    assert (m.completed, m.failed, m.parse_failures, m.scored_count, m.mean_score) == (2, 1, 1, 1, 2.5)


def test_dataset_run(spark, tmp_path):
    fine = [("user", "u"), ("assistant", "<think>t</think>r")]
    ddl = "id string, messages array<struct<role:string,content:string>>"
    spark.createDataFrame([(f"a{i}", fine) for i in range(8)] + [("bad", [("assistant", "x")])], ddl).coalesce(1).write.json(str(tmp_path / "p"))
    spark.createDataFrame([(f"b{i}", fine) for i in range(5)], ddl).coalesce(1).write.json(str(tmp_path / "f"))
    recipe = tmp_path / "r.yaml"
    recipe.write_text(f"categories:\n  a: {{pipelines: [pipe]}}\n  b: {{files: ['{tmp_path}/f']}}\n")
    outputs, target = {"pipe": str(tmp_path / "p")}, str(tmp_path / "out")
    run = lambda **kw: P.prepare_dataset(spark, str(recipe), outputs, target, **kw)
    assert P.status(spark, str(recipe), outputs, target)["status"] == "NOT PREPARED"
    made, report = run()
    assert made and {r.category: (r.raw, r.valid) for r in report.collect()} == {"a": (9, 8), "b": (5, 5)}
    manifest = json.loads((tmp_path / "out.manifest.json").read_text())
    assert manifest["output"]["total_samples"] == 13 and manifest["categories"]["a"]["sources"]["pipe"]["count"] == 9
    assert P.status(spark, str(recipe), outputs, target)["status"] == "CURRENT" and not run()[0] and run(force=True)[0]
    spark.createDataFrame([("c", fine)], ddl).coalesce(1).write.mode("overwrite").json(str(tmp_path / "f"))
    late = P.status(spark, str(recipe), outputs, target)
    assert late["status"] == "STALE" and late["reasons"][0].startswith("Changed: b/")


def test_project_status(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "name string, status string")
    out = P.project_status("v1.0", t(("p", "STALE")), t(("d", "CURRENT")), t(*((f"e00{i}", "done") for i in range(5)))).collect()
    assert [r.section for r in out] == ["release", "pipeline", "dataset", "experiment", "experiment", "experiment"]
    assert visible(spark.range(2).select(F.lit(True).alias("complete"), F.lit(False).alias("archived"))).count() == 2
