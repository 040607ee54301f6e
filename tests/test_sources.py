"""Readers, writers and the stream on temporary files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corvid import schema as S
from corvid.sources import readers as R
from corvid.sources import writers as W
from corvid.streaming import metrics as stream

SAMPLE = {"id": "1", "messages": [{"role": "user", "content": "hi"}]}


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text(json.dumps(SAMPLE) + "\n\n" + "{bad\n")
    good, bad = R.read_lenient(spark, str(p), S.TRAIN_SAMPLE)
    assert good.count() == 1 and bad.collect()[0].raw == "{bad" and R.count_lines(spark, str(p)) == 3
    with pytest.raises(Exception):
        R.read_samples(spark, str(p)).collect()
    rows = R.read_chat_rows(spark, str(p)).collect()
    assert [(r.line, r.valid) for r in rows] == [(1, True), (3, False)]


def test_results_index(spark, tmp_path):
    p = tmp_path / "i.jsonl"
    p.write_text("\n".join([json.dumps({"version": 1, "id": "a", "eval": {"name": "e"}}), "garbage", json.dumps({"version": 9, "id": "b", "eval": {"name": "e"}})]))
    assert [r.id for r in R.read_results(spark, str(p)).collect()] == ["a"]
    assert R.read_results(spark, str(p), include_raw=True).count() == 3


def test_hashes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("x")
    (tmp_path / "d/b.txt").write_text("y")
    got = {r.path.rsplit("/", 1)[1]: r.hash for r in R.file_hashes(spark, str(tmp_path / "d")).collect()}
    assert got["a.txt"] == hashlib.sha256(b"x").hexdigest()[:16]
    assert R.directory_hash(str(tmp_path / "d")) == hashlib.sha256(b"a.txtxb.txty").hexdigest()[:16]


def test_markdown_registry_experiments(spark, tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/sub/n.md").write_text("# t\nbody")
    assert [(r.name, r.text) for r in R.read_documents(spark, str(tmp_path / "docs")).collect()] == [("sub/n", "# t\nbody")]
    reg = spark.createDataFrame([("m", "p", "x", 0.3, None)], S.REGISTRY)
    W.write_registry(reg, str(tmp_path / "r.json"))
    assert R.read_registry(spark, str(tmp_path / "r.json")).collect() == reg.collect()
    e = tmp_path / "logs/E001"
    e.mkdir(parents=True)
    (e / "checkpoints.jsonl").write_text('{"name":"final","path":"p","batch":3}\n')
    (e / "train-config.json").write_text('{"base_model":"b","renderer":"r"}')
    (tmp_path / "logs/E002").mkdir()
    (tmp_path / "logs/E002/checkpoints.jsonl").write_text('{"name":"final","path":"q","batch":1}\n')
    got = R.read_experiments(spark, str(tmp_path / "logs")).collect()
    assert [(r.experiment, r.checkpoint, r.base_model) for r in got] == [("E001", "final", "b")]


def test_recipes_and_projects(spark, tmp_path):
    p = tmp_path / "r.yaml"
    p.write_text("categories:\n  a:\n    pipelines: all\n  b:\n    files: [x.jsonl]\nmode: weighted\nweights: {a: 1, b: 2}\n")
    rows = R.recipe_rows(spark, R.load_recipe(str(p))).collect()
    assert [(r.category, r.kind, r.source) for r in rows] == [("a", "pipeline", "all"), ("b", "file", "x.jsonl")]
    assert R.list_recipes(str(tmp_path)) == ["r"]
    q = tmp_path / "corvid.yaml"
    q.write_text("models:\n  m: {model: x, variants: [b, a]}\n")
    assert R.project_models(str(q))[0] | {} == {"name": "m", "provider": "openrouter", "model": "x", "temperature": 0.7, "sysprompt": None, "variants": ["a", "b"]}
    (tmp_path / "in/ner").mkdir(parents=True)
    assert R.find_project(str(tmp_path / "in/ner")) == tmp_path.resolve()
    assert R.merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 1}
    assert R.concurrency(None, None, {"concurrency": 9}, 50) == 9


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", [("user", "hi")], "extra")], "id string, messages array<struct<role:string,content:string>>, more string")
    W.write_samples(df, str(tmp_path / "o"))
    assert R.read_samples(spark, str(tmp_path / "o")).collect()[0].id == "1" and "more" not in spark.read.json(str(tmp_path / "o")).columns
    W.append_results(spark.createDataFrame([("a",)], "id string"), str(tmp_path / "idx"))
    W.append_results(spark.createDataFrame([("b",)], "id string"), str(tmp_path / "idx"))
    assert spark.read.json(str(tmp_path / "idx")).count() == 2
    rows = spark.range(100).select("id", F.col("id").cast("string").alias("v"))
    assert W.content_hash(rows, "id", F.col("v")) == W.content_hash(rows.repartition(7), "id", F.col("v"))


def test_stream_resumes(spark, tmp_path):
    log, seen = tmp_path / "log", []
    log.mkdir()
    (log / "0.json").write_text('{"step":0,"loss":1.0,"grad_norm":2.0}\nnot json\n')
    run = lambda: stream.on_progress(stream.follow(spark, str(log), 10, 4), lambda b, _: seen.extend(b.collect()), str(tmp_path / "state"), once=True).awaitTermination()
    run()
    (log / "1.json").write_text('{"index":1,"loss":0.5}\n')
    run()
    assert [(r.step, r.train_loss, r.grad) for r in seen] == [(0, 1.0, 1.0), (1, 0.5, None)]
