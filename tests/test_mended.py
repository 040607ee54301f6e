"""Repeats, nulls, changing answers, deep fields, and the order of what a run does."""

import json

import pytest
from pyspark.sql import functions as F

from corvid.functions import judge as J
from corvid.operators import evaluation as E
from corvid.operators import prep as P
from corvid.operators import registry as G
from corvid.operators import rollout as O
from corvid.operators import training as T
from corvid.plans import evaluate as V
from corvid.plans import stored
from corvid.sources import readers as R
from corvid.sources import writers as W
from corvid.storage import scratch, used_up, written


class Changing:
    """Never answers the same twice, over all its instances in a process."""

    n = 0

    def complete(self, request):
        Changing.n += 1
        if request.messages[0]["content"].startswith("Judge"):
            return O.Response(f"<score>{1 + int(request.messages[0]['content'].split('answer ')[1].split('.')[0]) % 5}</score>")
        return O.Response(f"answer {Changing.n}.")


def test_what_is_judged_is_what_is_stored(spark):
    e = V.Evaluation("s", "{id}", kind="scaled", max_score=5, gold="none")
    rows = V.run_eval(e, spark.createDataFrame([(f"q{i}",) for i in range(10)], "id string"), Changing, "m")
    first, second = ({r.sample_id: (r.response, r.final_score) for r in rows.collect()} for _ in range(2))
    assert first == second
    assert all(score == 1 + int(said[7:-1]) % 5 for said, score in first.values())


def test_splits_of_repeats_and_nulls(spark):
    same = spark.createDataFrame([("a", i) for i in range(12)] + [(None, i) for i in range(5)], "id string, every int")
    got = P.train_val_split(same, 9, 1).collect()
    assert sum(r.split == "val" for r in got) == 9 and len(got) == 17
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, P.train_val_split(same.repartition(5), 9, 1).collect()), key=repr)
    for size in (17, 18, -1):
        with pytest.raises(ValueError):
            P.train_val_split(same, size, 1)


def test_samples_of_null_categories_and_clashing_names(spark):
    rows = spark.createDataFrame([(None, None, i, i) for i in range(6)] + [("x", "c", i, i) for i in range(6)], "id string, category string, _key int, rank int")
    got = P.sample_exactly(rows, spark.createDataFrame([(None, 4), ("c", 2)], "category string, target int"), 1)
    assert got.columns == rows.columns and {r.category: r["count"] for r in got.groupBy("category").count().collect()} == {None: 4, "c": 2}


def test_recipes_default_to_simple(tmp_path):
    (tmp_path / "r.yaml").write_text("categories:\n  a: {files: [x]}\n")
    assert R.load_recipe(str(tmp_path / "r.yaml")).mode == "simple" and P.Recipe({"a": {"files": ["x"]}}, "simple").mode == "simple"


def test_whole_batches():
    assert T.steps(100, 0, 32, 1, True)["steps_per_epoch"] == 3 and T.steps(5, 0, 32, 2, True)["total_steps"] == 2


def test_deep_fields_are_kept(spark):
    deep = "<score>4</score>"
    for k in range(6):
        deep = f"<t{k}>{deep}</t{k}>"
    get = lambda x, f: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert get(deep, lambda x: J.score_of(J.xml_entries(x))) == 4
    assert get(f"<a><b>{deep}</b></a>", J.xml_fields) == {"score": "4"}
    far = deep
    for k in range(6, 14):
        far = f"<t{k}>{far}</t{k}>"
    assert "<score>4</score>" in "".join(get(far, J.xml_fields).values())  # kept as text
    assert get("<a>x <b> y</a><c>1</c><c>2</c>", J.xml_fields) == {"c": "2"}
    assert get("<ok>True</ok><n>007</n><s>1 2</s>", J.typed_fields) == {"raw": json.dumps("<ok>True</ok><n>007</n><s>1 2</s>"), "ok": "true", "n": "7", "s": '"1 2"'}


def test_teardown_comes_last(spark):
    seen = []

    class Job(O.Pipeline):
        def setup(self):
            seen.append("setup")

        def transform(self, spark):
            return spark.range(4).select(F.col("id").cast("string").alias("id"))

        def teardown(self):
            seen.append("teardown")

    assert [r.id for r in Job().execute(spark, limit=2).orderBy("id").collect()] == ["0", "1"] and seen == ["setup", "teardown"]


def test_formats(spark):
    one = spark.createDataFrame([("x/Kimi-Dev",)], "n string")
    assert one.select(G.model_format(F.col("n"))).first()[0] == "kimi_k2"
    with pytest.raises(Exception, match="No format for model: zz"):
        one.select(G.required_format(F.lit("zz"))).collect()
    known = G.metadata(spark)
    assert known.count() == 21 and G.catalog_model(known, "Qwen/Qwen3-8B").first().renderer == "qwen3"


def test_numbers_of_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("part"))
    got = P.numbered(rows.repartition(5), [F.col("k").desc()], 1)
    assert got.columns == ["k", "part", "pos"] and all(r.k + r.pos == 1000 for r in got.collect())
    assert P.numbered(rows.where("false"), [F.col("k")]).count() == 0


def test_answers_beside_records(spark):
    rows = spark.createDataFrame([("1", "hi", 5, None), ("2", None, 6, [("user", "yo")])], "id string, prompt string, other int, messages array<struct<role:string,content:string>>")
    got = {r.id: r for r in O.respond(rows).collect()}
    assert got["1"].response == O.HashClient().complete(O.Request([{"content": "hi"}])).text and got["2"].other == 6 and got["2"].response

    class Down:
        def complete(self, request):
            raise RuntimeError("down")

    assert {r.response for r in O.respond(rows, Down).collect()} == {"ERROR: down"}
    done = spark.sparkContext.accumulator(0)
    O.rollout(rows.select("id", "prompt"), O.single_turn, done=done).count()
    assert done.value in (0, 2)  # a count may need no records


def test_dependencies(tmp_path):
    (tmp_path / "f.txt").write_text("x")
    file, gone, model = O.FileDep(str(tmp_path / "f.txt")), O.FileDep(str(tmp_path / "no")), O.ModelDep("m", "p")
    assert file.read() == "x" and file.entry()["content_hash"] == file.hash() and gone.hash() is None and not gone.exists()
    assert model.entry()["sysprompt_hash"] and O.ModelDep("m").hash() is None

    class Job(O.Pipeline):
        name, deps = "job", {"a": file, "b": model, "c": "text"}

    assert [r[2] for r in O.dependency_rows(Job)] == ["file", "model", "str"] and set(O.manifest_entries(Job)) == {"a", "b"} and len(O.code_hash(Job)) == 16


def test_patient_client():
    class Flaky:
        n = 0

        def complete(self, request):
            self.n += 1
            return O.Response("ok" if self.n == 5 else "")

    client = Flaky()
    assert O.patient(client, 2, 3, 0).complete(O.Request([])).text == "ok" and client.n == 5
    assert O.query(None, O.Request([])).error and O.query(O.HashClient(), O.Request([{"content": "a"}])).is_success


def test_error_records_raise(spark):
    rows = spark.createDataFrame([("1", None), (None, ("refusal",))], "id string, __ERROR__ struct<error:string>")
    assert E.finished(rows.where("id = '1'")).count() == 1
    with pytest.raises(Exception, match="Error record: refusal"):
        E.finished(rows).collect()
    with pytest.raises(Exception, match="at 7"):
        P.minimal(spark.createDataFrame([(None, ["m"], 7)], "id string, messages array<string>, pos int")).collect()


def test_releases_and_paths(tmp_path):
    (tmp_path / "v/dev").mkdir(parents=True)
    (tmp_path / "v/dev/p.md").write_text("x")
    (tmp_path / "p.yaml").write_text("identity: {name: a}\n")
    new = W.release_prompts(str(tmp_path / "v"), "v0.1", str(tmp_path / "p.yaml"))
    assert (tmp_path / "v/v0.1/p.md").exists() and new.endswith("v0.1") and "release_version: v0.1" in (tmp_path / "p.yaml").read_text()
    for bad in ("dev", "1.0", "v0.1"):
        with pytest.raises(ValueError):
            W.release_prompts(str(tmp_path / "v"), bad, str(tmp_path / "p.yaml"))
    assert W.prepared_paths("d", "r")["manifest"] == "d/prepared/r.manifest.json" and W.record_paths("t")["input"] == "pipelines/.cache/t.jsonl"
    assert W.experiment_path("l", "E1") == "l/E1" and W.record_paths("t", "x.jsonl") == {"input": "x.jsonl", "output": "training/data/t.jsonl"}


def test_written_tables_go(spark):
    t = written(spark.range(5))
    assert t.count() == 5
    used_up(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._written).collect()
    assert scratch(spark) != scratch(spark) and stored.LetterClient
