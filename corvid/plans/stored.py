"""Queries that write files and read them back, and whole runs: evaluations, datasets, pipelines."""

from __future__ import annotations

import hashlib
import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from ..functions import judge as J
from ..functions import messages as M
from ..functions import names as N
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import lineage as L
from ..operators import prep as P
from ..operators import registry as G
from ..operators import results as R
from ..operators import rollout as O
from ..operators import training as T
from ..sources import readers
from ..sources import writers
from ..storage import put, scratch
from . import evaluate, prepare
from . import shapes as H
from .queries import SEED, query

# ---------------------------------------------------------------- sources and sinks


def _samples(spark, d):
    return H.conversations(H.table(spark, d, "conversations")).select(F.col("conv_id").cast("string").alias("id"), "messages", F.lit("x").alias("more"))


def _lines(spark, path: str, rows, name: str = "value") -> str:
    """Rows of one text column as a folder of text files."""
    rows.select(name).write.text(path)
    return path


@query("SELECT conv_id::VARCHAR AS id, count(*) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def samples_written(spark, d):
    path = scratch(spark)
    writers.write_samples(_samples(spark, d), path)
    back = readers.read_samples(spark, path)
    return back.select("id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("digest"))


@query("SELECT conv_id % 5 = 0 AS bad, count(*) AS n, count(*) FILTER (WHERE conv_id % 7 = 0) AS known FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1")
def samples_lenient(spark, d):
    k = F.col("id").cast("long")
    json_ = F.to_json(F.struct("id", "messages"))
    lines = _samples(spark, d).select(F.explode(F.array(F.when(k % 5 == 0, F.concat(F.lit("{"), "id")).otherwise(json_), F.lit(" "))).alias("value"))
    good, bad = readers.read_lenient(spark, _lines(spark, scratch(spark), lines), "id string, messages array<struct<role:string,content:string>>")
    count = lambda df, id_, flag: df.agg(F.count("*").alias("n"), F.count_if(id_ % 7 == 0).alias("known")).select(F.lit(flag).alias("bad"), "n", "known")
    return count(good, F.col("id").cast("long"), False).union(count(bad, F.expr("substring(raw, 2)").cast("long"), True)).where("n > 0")


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS valid, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS again FROM orders")
def results_index(spark, d):
    """Index lines of the supported version, of another one, and garbage; appended in two goes."""
    path, k = scratch(spark), F.col("o_orderkey")
    orders = H.table(spark, d, "orders")
    row = F.struct(F.when(k % 3 == 0, 1).otherwise(9).alias("version"), k.cast("string").alias("id"), F.struct(F.col("o_orderpriority").alias("name")).alias("eval"))
    for part in (0, 1):
        orders.where(k % 2 == part).select(F.when(k % 3 == 1, "garbage").otherwise(F.to_json(row)).alias("value")).write.mode("append").text(path)
    rows = readers.read_results(spark, path, include_raw=True)
    return rows.agg(F.count("*").alias("lines"), F.count_if("valid").alias("valid")).withColumn("again", readers.read_results(spark, path).where(F.col("id").cast("long") % 2 == 0).agg(F.count("*")).scalar())


@query("SELECT o_custkey::VARCHAR AS id, count(*) AS versions, max(o_orderkey) AS last FROM orders GROUP BY 1")
def results_appended(spark, d):
    path = scratch(spark)
    orders = H.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("pos"))
    for part in (0, 1):
        writers.append_results(orders.where(F.col("pos") % 2 == part), path)
    index = spark.read.schema("id string, pos long, updated_at timestamp").json(path)
    last = R.latest_versions(index.withColumn("updated_at", F.col("pos")))
    return index.groupBy("id").agg(F.count("*").alias("versions")).join(last.select("id", F.col("pos").alias("last")), "id")


@query("SELECT form, item_id, text FROM benchmark, (VALUES ('json'), ('parquet')) f(form)")
def eval_sample_files(spark, d):
    items, path = H.table(spark, d, "benchmark"), scratch(spark)
    items.write.json(f"{path}/a.jsonl")
    items.write.parquet(f"{path}/b.parquet")
    one = lambda name, form: readers.read_eval_samples(spark, f"{path}/{name}", items.schema).select(F.lit(form).alias("form"), "item_id", "text")
    return one("a.jsonl", "json").union(one("b.parquet", "parquet"))


@query("SELECT count(*) * 2 AS n FROM nation")
def line_counts(spark, d):
    lines = H.table(spark, d, "nation").select(F.explode(F.array("n_name", F.lit(""))).alias("value"))
    return spark.range(1).select(F.lit(readers.count_lines(spark, _lines(spark, scratch(spark), lines))).cast("long").alias("n"))


@query("SELECT n_name || '.txt' AS file, substr(sha256(n_name || chr(10)), 1, 16) AS hash FROM nation")
def hashed_files(spark, d):
    path = scratch(spark)
    for r in H.table(spark, d, "nation").collect():  # 25 rows
        put(spark, f"{path}/{r.n_name}.txt", f"{r.n_name}\n")
    return readers.file_hashes(spark, path).select(F.substring_index("path", "/", -1).alias("file"), "hash")


@query("SELECT n_regionkey || '/' || n_name AS name, '# ' || n_name || chr(10) || n_regionkey AS text FROM nation")
def markdown_documents(spark, d):
    path = scratch(spark)
    for r in H.table(spark, d, "nation").collect():  # 25 rows
        put(spark, f"{path}/{r.n_regionkey}/{r.n_name}.md", f"# {r.n_name}\n{r.n_regionkey}")
    return readers.read_documents(spark, path.removeprefix("file://").removeprefix("file:"))


@query("SELECT n_name AS name, 'p' || n_regionkey AS provider, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '::r' ELSE n_name END AS model, n_regionkey / 10 AS temperature, CASE WHEN n_nationkey % 3 = 0 THEN 'Be brief.' END AS sysprompt FROM nation")
def registry_file(spark, d):
    rows = H.table(spark, d, "nation").select(
        F.col("n_name").alias("name"), F.concat(F.lit("p"), "n_regionkey").alias("provider"), F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "::r").otherwise("")).alias("model"),
        (F.col("n_regionkey") / 10).alias("temperature"), F.when(F.col("n_nationkey") % 3 == 0, "Be brief.").alias("sysprompt"),
    )
    path = f"{tempfile.mkdtemp(prefix='corvid-')}/registry.json"  # the driver's own file
    writers.write_registry(rows, path)
    copy = f"{scratch(spark)}/registry.json"
    put(spark, copy, Path(path).read_text())
    return readers.read_registry(spark, copy)


@query(H.sql("SELECT step, round(train_loss, 9) AS loss, g AS grad_norm FROM metrics", "metrics"))
def metrics_file(spark, d):
    path = scratch(spark)
    H.metric_rows(spark, d).write.json(path)
    return readers.read_metrics(spark, path).select("step", F.round("loss", 9).alias("loss"), "grad_norm")


@query("""SELECT 'E' || n_nationkey AS experiment, CASE WHEN n_nationkey % 4 = 1 THEN 'final' ELSE c END AS checkpoint, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE 'p/' || c END AS path, n_name AS base_model,
  CASE WHEN n_nationkey % 4 = 2 THEN 'built' WHEN n_nationkey % 4 = 3 THEN 'r' END AS renderer, CASE WHEN n_nationkey % 4 = 1 THEN 'local' END AS provider, CASE WHEN n_nationkey % 4 = 1 THEN 'own' END AS model
FROM nation, (VALUES ('final'), ('000010')) v(c) WHERE n_nationkey % 4 <> 0 AND (n_nationkey % 4 <> 1 OR c = 'final')""")  # fmt: skip
def experiment_logs(spark, d):
    """Experiments without a configuration, of another backend, with a builder's renderer, and plain ones."""
    path = scratch(spark)
    for r in H.table(spark, d, "nation").collect():  # 25 rows
        k, at = r.n_nationkey % 4, f"{path}/E{r.n_nationkey}"
        put(spark, f"{at}/checkpoints.jsonl", '{"name":"000010","sampler_path":"p/000010","batch":10}\n{"name":"final","sampler_path":"p/final","batch":20}\n')
        if k:
            put(spark, f"{at}/train-config.json", json.dumps({"base_model": r.n_name} | ({"backend": "unsloth"} if k == 1 else {"renderer": "r"} if k == 3 else {}), indent=1))
        if k == 1:
            put(spark, f"{at}/artifacts.json", json.dumps({"registry": {"model": "own"}}))
        if k == 2:
            put(spark, f"{at}/config.json", json.dumps({"dataset_builder": {"common_config": {"renderer_name": "built"}}}))
    return readers.read_experiments(spark, path).select("experiment", "checkpoint", "path", "base_model", "renderer", "provider", "model")


@query("WITH c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS k, count(*) AS n FROM conversations GROUP BY conv_id) SELECT 2 * k - 1 AS line, conv_id % 5 <> 0 AS valid, CASE WHEN conv_id % 5 <> 0 THEN n END AS n FROM c")
def chat_rows_file(spark, d):
    k = F.col("id").cast("long")
    rows = _samples(spark, d).select(k.alias("k"), F.when(k % 5 == 0, "{no json").otherwise(F.to_json(F.struct("messages"))).alias("json"))
    path = scratch(spark)
    # One file, each line followed by a blank one.
    rows.repartition(1).sortWithinPartitions("k").select(F.concat("json", F.lit("\n")).alias("value")).write.text(path)
    return readers.read_chat_rows(spark, path).select("line", "valid", F.size("messages").cast("long").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("SELECT r_name AS category, CASE WHEN r_regionkey % 2 = 0 THEN 'pipeline' ELSE 'file' END AS kind, CASE WHEN r_regionkey % 2 = 1 THEN n_name || '.jsonl' WHEN r_regionkey = 0 THEN 'all' ELSE n_name END AS source FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def recipe_file(spark, d):
    region = {r.r_regionkey: r.r_name for r in H.table(spark, d, "region").collect()}
    categories: dict[str, dict] = {}
    for r in H.table(spark, d, "nation").collect():  # 25 rows
        c = categories.setdefault(region[r.n_regionkey], {})
        if r.n_regionkey == 0:
            c["pipelines"] = "all"
        elif r.n_regionkey % 2:
            c.setdefault("files", []).append(f"{r.n_name}.jsonl")
        else:
            c.setdefault("pipelines", []).append(r.n_name)
    folder = Path(tempfile.mkdtemp(prefix="corvid-"))  # the driver's own file
    (folder / "world.yaml").write_text(json.dumps({"categories": categories}))
    return readers.recipe_rows(spark, readers.load_recipe(str(folder / f"{readers.list_recipes(str(folder))[0]}.yaml")))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'openrouter' ELSE 'local' END AS provider, 'm' || n_regionkey AS model, CASE WHEN n_nationkey % 3 = 0 THEN 0.2 ELSE 0.7 END::DOUBLE AS temperature FROM nation")
def project_file(spark, d):
    models = {r.n_name: {"model": f"m{r.n_regionkey}"} | ({"provider": "local"} if r.n_nationkey % 2 else {}) | ({"temperature": 0.2} if r.n_nationkey % 3 == 0 else {}) for r in H.table(spark, d, "nation").collect()}
    folder = Path(tempfile.mkdtemp(prefix="corvid-"))  # the driver's own file
    (folder / "corvid.yaml").write_text(json.dumps({"models": models}))
    (folder / "deep/er").mkdir(parents=True)
    found = readers.project_models(str(readers.find_project(str(folder / "deep/er")) / "corvid.yaml"))
    return spark.createDataFrame([(m["name"], m["provider"], m["model"], m["temperature"]) for m in found], "name string, provider string, model string, temperature double")


@query("SELECT 'pipeline' AS kind, lower(r_name) AS name FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'evaluation', x FROM (VALUES ('mc'), ('corvid:mc'), ('own')) v(x)")
def discovered(spark, d):
    folder = Path(tempfile.mkdtemp(prefix="corvid-"))  # the driver's own files
    for r in H.table(spark, d, "region").collect():  # 5 rows
        body = f"from corvid.operators.rollout import Pipeline\nclass A(Pipeline):\n    name = '{r.r_name.lower()}'\n"
        (folder / f"p{r.r_regionkey}.py").write_text(body if r.r_regionkey % 2 == 0 else "broken(")
    (folder / "_skipped.py").write_text("from corvid.operators.rollout import Pipeline\nclass B(Pipeline):\n    name = 'hidden'\n")
    known = readers.evaluations({"own": 1, "mc": 2}, {"mc": 0})
    assert known["mc"] == 2 and known["corvid:mc"] == 0
    rows = [("pipeline", n) for n in readers.discover(str(folder), O.Pipeline)] + [("evaluation", n) for n in known]
    return spark.createDataFrame(rows, "kind string, name string")


@query("SELECT * FROM (VALUES ('Base', 'Dense', 5), ('Base', 'MoE', 2), ('Hybrid', 'Dense', 2), ('Hybrid', 'MoE', 2), ('Instruction', 'Dense', 3), ('Instruction', 'MoE', 2), ('Reasoning', 'MoE', 3), ('Vision', 'MoE', 2)) v(training_type, architecture, n)")
def known_models(spark, d):
    models = G.enrich(G.metadata(spark).select("name"), G.metadata(spark))
    return models.groupBy("training_type", "architecture").agg(F.count("*").cast("int").alias("n"))


@query("SELECT 'exact' AS way, 'Qwen/Qwen3-8B' AS name UNION ALL SELECT 'filter', x FROM (VALUES ('Qwen/Qwen3-30B-A3B-Base'), ('deepseek-ai/DeepSeek-V3.1-Base')) v(x)")
def catalog_lookup(spark, d):
    models = G.enrich(G.metadata(spark).select("name"), G.metadata(spark))
    return G.catalog_model(models, "Qwen/Qwen3-8B").select(F.lit("exact").alias("way"), "name").union(G.catalog(models, "base", "moe", "B").select(F.lit("filter"), "name"))


# ---------------------------------------------------------------- whole runs


class LetterClient:
    """Answers with a letter that the prompt's MD5 picks, a different number each time it is called; fails for some prompts."""

    calls = 0

    def complete(self, request):
        LetterClient.calls += 1
        said = request.messages[-1]["content"]
        if said.startswith("Judge"):
            said = said.split("Response:\n")[1].split("\n\n")[0]
            return O.Response(f"<score>{1 + int(said.split()[1]) % 5}</score> call {LetterClient.calls}")
        h = int(hashlib.md5(said.encode()).hexdigest()[:4], 16)
        return O.Response(error="down") if h % 11 == 0 else O.Response(f"Take {h} call {LetterClient.calls}\nAnswer: {'ABCD'[h % 4]}")


_ASKED = """h AS (SELECT item_id, 'Q' || item_id || '?' AS prompt, ('0x' || substr(md5('Q' || item_id || '?'), 1, 4))::INT AS h, chr((65 + item_id % 4)::INT) AS gold FROM benchmark),
a AS (SELECT *, CASE WHEN h % 11 <> 0 THEN substr('ABCD', h % 4 + 1, 1) END AS letter, CASE WHEN h % 11 = 0 THEN 'down' END AS error FROM h)"""


def _items(spark, d):
    return H.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.char(65 + F.col("item_id") % 4).alias("answer"), F.lit("x").alias("Extra"))


@query(f"WITH {_ASKED} SELECT item_id::VARCHAR AS sample_id, r::INT AS run, prompt, letter AS extracted, error, CASE WHEN error IS NULL THEN 'Take ' || h END AS said, CASE WHEN error IS NULL THEN (letter = gold)::INT::DOUBLE END AS final_score FROM a, range(1, 3) t(r)")
def eval_binary_run(spark, d):
    """Two runs of a multiple-choice evaluation whose model never answers twice the same: what is judged is what is stored."""
    rows = evaluate.run_eval(evaluate.Evaluation("mc", "Q{id}?"), _items(spark, d), LetterClient, "m", runs=2)
    return rows.select("sample_id", "run", "prompt", "extracted", "error", F.regexp_extract("response", "^(Take [0-9]+)", 1).alias("said"), "final_score").withColumn("said", F.when(F.col("error").isNull(), F.col("said")))


@query(f"WITH {_ASKED} SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS completed, count(*) FILTER (WHERE error IS NULL AND letter IN ('A', 'B')) AS hits FROM a")
def eval_custom_run(spark, d):
    """A judge and metrics of one's own."""
    own = evaluate.Evaluation(
        "own", "Q{id}?", kind="custom", gold="none", judge=lambda response, gold, prompt: F.struct(X.mc_answer(response).isin("A", "B").cast("double").alias("score"), F.lit(None).cast("string").alias("extracted"), F.lit(None).cast("string").alias("error")),
        aggregates=lambda: [F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("completed"), F.count_if("correct").alias("hits")],
    )
    return evaluate.metrics(own, evaluate.run_eval(own, _items(spark, d), LetterClient, "m"))


@query(f"WITH {_ASKED} SELECT item_id::VARCHAR AS sample_id, error, CASE WHEN error IS NULL THEN 2 ELSE 0 END AS judged, CASE WHEN error IS NULL THEN (1 + h % 5)::DOUBLE END AS final_score FROM a")
def eval_scaled_run(spark, d):
    scaled = evaluate.Evaluation("scaled", "Q{id}?", kind="scaled", max_score=5, gold="none")
    rows = evaluate.run_eval(scaled, _items(spark, d), LetterClient, "m", judges=2)
    return rows.select("sample_id", "error", F.size("judgments").alias("judged"), "final_score")


@query(f"WITH {_ASKED} SELECT 'mc' AS name, count(*) AS n_samples, true AS complete, round(count(*) FILTER (WHERE letter = gold) / count(*) FILTER (WHERE error IS NULL), 9) AS score, count(*) FILTER (WHERE error IS NOT NULL) AS failed, 'unknown' AS provider, count(*) AS stored FROM a")
def eval_index_row(spark, d):
    """The index row of a run whose model is in no registry, and the details as written."""
    e = evaluate.Evaluation("mc", "Q{id}?")
    rows = evaluate.run_eval(e, _items(spark, d), LetterClient, "m")
    row = evaluate.index_row(e, rows, evaluate.model_spec(G.metadata(spark).select("name", F.lit("").alias("provider"), F.lit("").alias("model"), F.lit(0.0).alias("temperature"), F.lit("").alias("sysprompt")), "zz"), None, H.table(spark, d, "benchmark").count())
    path = scratch(spark)
    rows.write.json(path)
    stored = spark.read.schema(rows.schema).json(path).agg(F.count("*")).scalar()
    return row.select(
        "eval.name", F.col("eval.n_samples").cast("long").alias("n_samples"), "eval.complete", F.round("results.score", 9).alias("score"),
        F.coalesce(F.try_element_at("results.errors.by_type", F.lit("model_error")), F.lit(0)).cast("long").alias("failed"), "model.provider", stored.alias("stored"),
    )


@query("""WITH s AS (SELECT conv_id, bool_and(role <> 'assistant' OR (starts_with(x, '<think>') AND ok)) AS fits FROM (SELECT *, x = text AS same, (conv_id * 3 + turn) % 8 = 0 AS ok FROM (SELECT *, CASE WHEN role = 'assistant' AND (conv_id * 3 + turn) % 8 = 0 THEN '<think>plan</think>' || text ELSE text END AS x FROM conversations)) GROUP BY conv_id)
SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, count(*) AS raw, count(*) FILTER (WHERE fits) AS valid, 'CURRENT' AS status, sum(count(*) FILTER (WHERE fits)) OVER ()::BIGINT AS stored FROM s GROUP BY 1""")  # fmt: skip
def dataset_build(spark, d):
    """A dataset of two sources, made once, then found current; the rows it stores."""
    tagged = H.tagged(spark, d, None).withColumn("text", F.when((F.col("role") != "assistant") | ((F.col("conv_id") * 3 + F.col("turn")) % 8 == 0), F.col("text")).otherwise(F.lit("x")))
    samples = H.conversations(tagged).select(F.col("conv_id").cast("string").alias("id"), "messages", (F.col("conv_id") % 2).alias("odd"))
    paths = {"even": scratch(spark), "odd": scratch(spark)}
    for k, name in enumerate(paths):
        writers.write_samples(samples.where(F.col("odd") == k), paths[name])
    folder = Path(tempfile.mkdtemp(prefix="corvid-"))  # the driver's own files: recipe and manifest
    recipe = folder / "r.yaml"
    recipe.write_text(json.dumps({"mode": "simple", "categories": {n: {"pipelines": [n]} for n in paths}}))
    target = str(folder / "out")
    made, report = prepare.prepare_dataset(spark, str(recipe), paths, target)
    status = prepare.status(spark, str(recipe), paths, target)["status"]
    assert made and not prepare.prepare_dataset(spark, str(recipe), paths, target)[0]
    stored = json.loads(Path(f"{target}.manifest.json").read_text())["output"]["total_samples"]
    return report.select("category", "raw", "valid", F.lit(status).alias("status"), F.lit(stored).cast("long").alias("stored"))


@query("SELECT 'made' AS state, n_name AS id FROM nation ORDER BY n_name LIMIT 10")
def pipeline_execute(spark, d):
    """The first ten samples of a pipeline; its output outlives teardown, which removes the source."""
    state = {}

    class Nations(O.Pipeline):
        def setup(self):
            state["path"] = scratch(spark)
            H.table(spark, d, "nation").write.parquet(state["path"])

        def transform(self, spark):
            return spark.read.parquet(state["path"]).select(F.lit("made").alias("state"), F.col("n_name").alias("id"))

        def teardown(self):
            spark.range(0).write.mode("overwrite").parquet(state["path"])

    return Nations().execute(spark, limit=10)


@query("SELECT 'p' AS owner, n_name AS attr, CASE WHEN n_nationkey % 2 = 0 THEN 'model' ELSE 'str' END AS type, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE substr(sha256(n_name), 1, 16) END AS hash FROM nation")
def dependencies(spark, d):
    deps = {r.n_name: r.n_name if r.n_nationkey % 2 else O.ModelDep("m", None if r.n_nationkey % 4 == 0 else r.n_name) for r in H.table(spark, d, "nation").collect()}
    pipeline = type("Deps", (O.Pipeline,), {"name": "p", "deps": deps})
    return spark.createDataFrame(O.dependency_rows(pipeline), "owner string, attr string, type string, hash string")


@query("SELECT conv_id || '-' || turn AS id, role, 'ERROR: down' = md5(text) AS failed, md5(text) AS response FROM conversations")
def responses(spark, d):
    records = H.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", F.col("text").alias("prompt"))
    out = O.respond(records)
    return out.select("id", "role", (F.col("response") == "ERROR: down").alias("failed"), "response")


# ---------------------------------------------------------------- the rest of the functions


@query("SELECT conv_id, turn, CASE WHEN k = 0 THEN '<details class=\"reasoning\"><summary>Reasoning</summary><pre>a &lt; b &amp; c</pre></details>' || text ELSE text END AS shown, CASE WHEN k = 0 THEN '<think>a < b & c</think>' || text ELSE text END AS back FROM (SELECT *, conv_id % 2 AS k FROM conversations)")
def think_display(spark, d):
    x = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("<think>a < b & c</think>"), "text")).otherwise(F.col("text"))
    t = H.table(spark, d, "conversations").select("conv_id", "turn", X.format_think_tags(x).alias("shown"))
    return t.withColumn("back", X.strip_think_formatting(F.col("shown")))


@query("SELECT conv_id, count(*) AS n, md5(string_agg('<think>r</think>' || text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def flat_history(spark, d):
    blocks = F.to_json(F.array(F.struct(F.lit("thinking").alias("type"), F.lit("r").alias("thinking"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("thinking"), F.col("text").alias("text"))))
    said = H.conversations(H.table(spark, d, "conversations").withColumn("text", blocks))
    flat = said.select("conv_id", M.flatten_history(F.col("messages")).alias("m"))
    return flat.select("conv_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda m: m["content"]), "")).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END AS flag, CAST(n_chars AS VARCHAR) AS n, '\"' || lang || '\"' AS lang, '\"' || source || '\"' AS deep FROM documents")
def typed_xml(spark, d):
    nest = lambda x, k: F.concat(*[F.lit(f"<d{i}>") for i in range(k)], x, *[F.lit(f"</d{i}>") for i in reversed(range(k))])
    x = F.concat(F.lit("<Is-It>"), F.when(F.col("doc_id") % 3 == 0, "TRUE").otherwise("False"), F.lit("</Is-It><n>0</n><n> "), "n_chars", F.lit(" </n><lang>"), "lang", F.lit("</lang>"), nest(F.concat(F.lit("<deep>"), "source", F.lit("</deep>")), 6))
    m = J.typed_fields(x)
    return H.table(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", F.col("m")["Is_It"].alias("flag"), F.col("m")["n"].alias("n"), F.col("m")["lang"].alias("lang"), F.col("m")["deep"].alias("deep"))


@query(H.sql(", s AS (SELECT id, substr(split_part(id, '-', 2), 5, 4) || '-' || split_part(id, '-', 4) AS short FROM results), w AS (SELECT min(short) AS short FROM s) SELECT s.id FROM s JOIN w USING (short)", "results"))
def results_by_id(spark, d):
    rows = H.results(spark, d)
    return R.by_id(rows, rows.agg(F.min(N.short_id(F.col("id")))).first()[0]).select("id")


@query(H.sql("SELECT id, pos, row_number() OVER (ORDER BY timestamp DESC, id, pos) - 1 AS place FROM results", "results"))
def results_newest_first(spark, d):
    rows = H.results(spark, d)
    return P.numbered(rows, [F.col("timestamp").desc(), F.col("id"), F.col("pos")], name="place").select("id", "pos", "place")


@query(H.sql("SELECT pos, row_number() OVER w AS run, count(*) OVER (PARTITION BY eval, model) AS runs FROM results WINDOW w AS (PARTITION BY eval, model ORDER BY timestamp, id)", "results"))
def results_run_numbers(spark, d):
    return R.run_numbers(H.results(spark, d), ["eval", "model"]).select("pos", F.col("run").cast("long").alias("run"), "runs")


@query(H.sql("SELECT b::INT AS bin, count(doc_id) AS n FROM range(1, 6) t(b) LEFT JOIN (SELECT doc_id, (score + doc_id % 2) / 2 AS s FROM judge WHERE error IS NULL AND score IS NOT NULL) ON s = b GROUP BY b", "judge"))
def whole_scores(spark, d):
    rows = H.judge_rows(spark, d).withColumn("a", J.assessment(J.xml_entries(F.col("response"))))
    return E.histogram(rows.select("error", ((F.col("a.score") + F.col("doc_id") % 2) / 2).alias("score")), 5, whole_only=True)


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents")
def shuffled_order(spark, d):
    rows = H.table(spark, d, "documents").select("doc_id", "lang")
    return P.numbered(P.shuffled(rows, SEED, "doc_id"), [N.shuffle_key(SEED, F.col("doc_id")), F.col("doc_id")], name="place")


@query("WITH r AS (SELECT n_regionkey AS id, n_nationkey, row_number() OVER (ORDER BY md5('42:' || coalesce(CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR END, ''))) AS k FROM nation) SELECT (count(*) FILTER (WHERE k <= 9))::BIGINT AS val, (count(*) FILTER (WHERE k > 9))::BIGINT AS train FROM r")
def split_repeated_ids(spark, d):
    """Rows that share an id, or have none, are split each for itself: val has exactly as many as asked."""
    rows = H.table(spark, d, "nation").select(F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("id"), "n_nationkey")
    return P.train_val_split(rows, 9, SEED).agg(F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("split") == "train").alias("train"))


@query("SELECT CASE WHEN n_regionkey > 0 THEN n_regionkey END AS category, least(count(*), 3) AS n FROM nation GROUP BY 1")
def sample_null_categories(spark, d):
    rows = H.table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("id"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("category"), F.lit(0).alias("rank"))
    targets = rows.select("category").distinct().withColumn("target", F.lit(3))
    return P.sample_exactly(rows, targets, SEED).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, 2 + n_nationkey % 3 AS epochs, 32 AS batch_size, n_name AS base_model, greatest(1, (n_nationkey * 40) // 32) * (2 + n_nationkey % 3) AS total_steps FROM nation")
def training_configs(spark, d):
    rows = []
    for r in H.table(spark, d, "nation").collect():  # 25 rows
        c = T.config_from({"base-model": r.n_name, "data": "d", "epochs": 1}, {"epochs": 2 + r.n_nationkey % 3, "seed": None})
        rows.append((r.n_nationkey, c["epochs"], c["batch_size"], c["base_model"], T.steps(r.n_nationkey * 40, 0, c["batch_size"], c["epochs"], True)["total_steps"]))
    return spark.createDataFrame(rows, "n_nationkey int, epochs int, batch_size int, base_model string, total_steps long")


@query("SELECT n_name AS name, 'Changed' AS status FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name, 'New' FROM nation WHERE n_nationkey % 3 = 1")
def manifest_flat(spark, d):
    """Sources against a manifest of the older, flat form."""
    names = {r.n_name: r.n_nationkey % 3 for r in H.table(spark, d, "nation").collect()}
    old = {"categories": {"c": {}}, "sources": {"pipelines": {n: {"hash": "old"} for n, k in names.items() if k != 1}}}
    now = spark.createDataFrame([("c", n, "new" if k == 0 else "old") for n, k in names.items()], "category string, name string, hash string")
    return L.manifest_diff(readers.manifest_rows(spark, old), now).select("name", "status")


@query("SELECT CASE n_nationkey % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'STALE' WHEN 2 THEN 'PARTIAL' ELSE 'CURRENT' END AS status, count(*) AS n, CASE WHEN n_nationkey % 4 = 3 THEN 0 ELSE count(*) END AS upstream FROM nation GROUP BY n_nationkey % 4")
def project_counts(spark, d):
    """Pipelines by status, faults included, and how many of each hold back training."""
    k = F.col("n_nationkey") % 4
    pipes = H.table(spark, d, "nation").select(F.col("n_name").alias("owner"), F.lit(True).alias("has_manifest"), F.lit(True).alias("has_output"), (k == 2).alias("partial"), F.lit("a").alias("old_code"), F.when(k == 1, "b").otherwise("a").alias("new_code"), F.when(k == 0, "broken").alias("fault"))
    status = L.pipeline_status(pipes, spark.createDataFrame([], "owner string, attr string, change string"))
    held = L.upstream(pipes.select(F.col("owner").alias("source")), status).join(status, "owner").groupBy("status").agg(F.count("*").alias("upstream"))
    return L.status_counts(status).join(held, "status", "left").withColumn("upstream", F.coalesce("upstream", F.lit(0)))


@query("SELECT section, name, status FROM (SELECT 'release' AS section, 'v1.0' AS name, '' AS status UNION ALL SELECT 'pipeline', n_name, 'CURRENT' FROM nation UNION ALL SELECT 'dataset', r_name, 'STALE' FROM region UNION ALL SELECT * FROM (SELECT 'experiment', 'e' || lpad(n_nationkey::VARCHAR, 3, '0'), 'done' FROM nation ORDER BY 2 DESC LIMIT 3))")
def project_overview(spark, d):
    nation, region = H.table(spark, d, "nation"), H.table(spark, d, "region")
    return prepare.project_status("v1.0", nation.select(F.col("n_name").alias("name"), F.lit("CURRENT").alias("status")), region.select(F.col("r_name").alias("name"), F.lit("STALE").alias("status")), nation.select(F.format_string("e%03d", "n_nationkey").alias("name"), F.lit("done").alias("status")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kimi_k2' ELSE 'qwen3' END AS renderer, 'E' || p_size AS experiment, 'final-' || p_size AS checkpoint, 'e' || p_size || '-final-' || p_size LIKE 'e%-%' AS spec,
  p_size || '.0%' AS score, CASE WHEN p_partkey % 2 = 0 THEN '+' || p_size || '.0%' ELSE '+' || p_size || '.00' END AS delta FROM part""")  # fmt: skip
def model_specs(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("e"), size, F.lit("-final-"), size)
    a = F.when(k % 2 == 0, 0.0).otherwise(2.0)
    b = F.when(k % 2 == 0, size / 100).otherwise(size + 2.0)
    return H.table(spark, d, "part").select(
        "p_partkey", G.required_format(F.when(k % 3 == 0, "moonshotai/Kimi-Dev").otherwise("Qwen/Qwen3-8B")).alias("renderer"), N.experiment_of(name).alias("e"), N.is_experiment_spec(name).alias("spec"),
        N.score_text(size / 100).alias("score"), N.delta_text(a, b).alias("delta"),
    ).select("p_partkey", "renderer", "e.experiment", "e.checkpoint", "spec", "score", "delta")


@query("SELECT conv_id::VARCHAR AS id, count(*) AS n, bool_or(conv_id % 4 = 0) AS lacks FROM conversations GROUP BY conv_id")
def sample_fields(spark, d):
    """Samples cut to id and messages, and which lack one of them."""
    rows = _samples(spark, d)
    lacks = P.missing_fields(rows.withColumn("key", F.col("id")).withColumn("messages", F.when(F.col("id").cast("long") % 4 != 0, F.col("messages")))).select(F.col("key").alias("id"), F.lit(True).alias("lacks"))
    return P.minimal(rows).select("id", F.size("messages").cast("long").alias("n")).join(lacks, "id", "left").withColumn("lacks", F.coalesce("lacks", F.lit(False)))


@query("SELECT 'e' || n_nationkey || CASE WHEN n_regionkey = 0 THEN '' ELSE '-' || n_regionkey END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'local' ELSE 'tinker' END AS provider, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE n_name || '::qwen3::p' END AS model, CASE WHEN n_nationkey % 2 = 0 THEN 0.1 ELSE 0.5 END::DOUBLE AS temperature FROM nation UNION ALL SELECT 'id-v1-' || r_name, 'p', 'm', 0.5 FROM region")
def registry_layers(spark, d):
    even = F.col("n_nationkey") % 2 == 0
    points = H.table(spark, d, "nation").select(
        F.concat(F.lit("E"), "n_nationkey").alias("experiment"), F.when(F.col("n_regionkey") == 0, "final").otherwise(F.col("n_regionkey").cast("string")).alias("checkpoint"), F.col("n_name").alias("base_model"), F.lit(None).cast("string").alias("renderer"), F.lit("p").alias("path"),
        F.when(even, "local").alias("provider"), F.when(even, "own").alias("model"), F.when(even, 0.1).alias("temperature"), F.lit(0).alias("pos"),
    )
    prompts = H.table(spark, d, "region").select(F.lit("v1").alias("version"), F.col("r_name").alias("variant"), F.lit("Be brief.").alias("sysprompt"))
    return G.overlay(G.version_layer(prompts, "id", "p", "m", 0.5), G.checkpoint_layer(points, 0.5)).select("name", "provider", "model", "temperature")
