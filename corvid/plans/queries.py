"""One query for each operator or small group of operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
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
from ..schema import TRAIN_SAMPLE
from ..storage import scratch
from ..streaming import metrics as stream
from . import shapes as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED, TEST_SIZE, BATCH, EPOCHS, STEPS, PARAMETERS = 42, 100, 32, 3, 10_000, 4_000_000
WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        name = f.__name__
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


# ---------------------------------------------------------------- reasoning tags and samples


@query(H.sql("SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM reasons GROUP BY 1", "tagged", "judged"))
def think_audit(spark, d):
    return H.tagged(spark, d).groupBy(F.coalesce(X.sample_reason(F.col("text")), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(H.sql("""SELECT conv_id, turn, CASE WHEN o > 1 THEN 'multiple_open_tags_' || o WHEN o = 0 AND c > 0 THEN 'orphaned_close_tags' WHEN o = 1 AND c > 1 THEN 'extra_close_tags'
  WHEN o = 1 AND c = 0 THEN 'unclosed_think_tag' WHEN o = 1 AND strpos(text, '<think>') > strpos(text, '</think>') THEN 'think_tags_wrong_order' END AS reason FROM judged""", "tagged", "judged"))  # fmt: skip
def think_structure(spark, d):
    return H.tagged(spark, d).select("conv_id", "turn", X.think_reason(F.col("text")).alias("reason"))


_STRIP_SQL = H.sql(r""", s AS (SELECT *, regexp_replace(text, '(?s)<think>.*?</think>\s*', '', 'g') AS a FROM judged),
u AS (SELECT *, CASE WHEN contains(a, '</think>') AND NOT contains(a, '<think>') THEN substr(a, strpos(a, '</think>') + 8) ELSE a END AS b FROM s)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(b, '</?think>\s*', '', 'g'), '^\s+|\s+$', '', 'g')) AS stripped, md5(th) AS thinking, md5(re) AS response FROM u""", "tagged", "judged")  # fmt: skip


@query(_STRIP_SQL)
def think_strip_extract(spark, d):
    x = F.col("text")
    return H.tagged(spark, d).select("conv_id", "turn", F.md5(X.strip_thinking(x)).alias("stripped"), F.md5(X.thinking(x)).alias("thinking"), F.md5(X.response(x)).alias("response"))


@query(H.sql("""SELECT conv_id, count(*) + (CASE WHEN bool_or(turn = 0 AND role = 'system') THEN 0 ELSE 1 END) AS n_messages,
  md5((CASE WHEN bool_or(turn = 0 AND role = 'system') THEN '' ELSE 'system:Be brief.|' END) || string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM tagged GROUP BY conv_id""", "tagged"))  # fmt: skip
def sample_assembly(spark, d):
    m = M.inject_system(F.col("messages"), F.lit("Be brief."))
    said = H.conversations(H.tagged(spark, d, None)).select("conv_id", m.alias("m"))
    return said.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest"))


@query(H.sql("SELECT c.conv_id, (SELECT arg_min(reason, turn) FROM reasons r WHERE r.conv_id = c.conv_id AND reason IS NOT NULL) AS reason FROM (SELECT DISTINCT conv_id FROM conversations) c", "tagged", "judged"))
def sample_validity(spark, d):
    return P.validate(H.conversations(H.tagged(spark, d, None))).select("conv_id", "reason")


@query(H.sql(""", s AS (SELECT c.conv_id, 'p' || (c.conv_id % 9) AS source, NOT EXISTS (SELECT 1 FROM reasons r WHERE r.conv_id = c.conv_id AND reason IS NOT NULL) AS ok FROM (SELECT DISTINCT conv_id FROM conversations) c)
SELECT source, count(*) AS n, count(*) FILTER (WHERE ok) AS valid FROM s GROUP BY source HAVING count(*) FILTER (WHERE ok) = 0""", "tagged", "judged"))  # fmt: skip
def zero_yield_sources(spark, d):
    v = P.validate(H.conversations(H.tagged(spark, d, None))).withColumn("source", F.concat(F.lit("p"), F.col("conv_id") % 9))
    return P.zero_yield(v, "source")


@query(H.sql(", f AS (SELECT conv_id, arg_min(reason, turn) AS reason FROM reasons WHERE reason IS NOT NULL GROUP BY conv_id) SELECT reason, count(*) AS n FROM f GROUP BY reason", "tagged", "judged"))
def rejection_counts(spark, d):
    return P.rejections(P.validate(H.conversations(H.tagged(spark, d, None))))


@query("""WITH c AS (SELECT conv_id, CASE WHEN turn = 1 AND conv_id % 7 = 0 THEN 'judge' ELSE role END AS role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, CASE WHEN bool_or(role = 'judge') THEN 'message ' || min(i) FILTER (WHERE role = 'judge') || ': invalid role judge' WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 'at least one assistant message is required' END AS error,
  count(*) FILTER (WHERE role = 'assistant') > 1 AS multi_turn, max(i) FILTER (WHERE role = 'assistant') AS trained_turn FROM c GROUP BY conv_id""")  # fmt: skip
def chat_row_reasons(spark, d):
    turns = H.table(spark, d, "conversations").withColumn("role", F.when((F.col("turn") == 1) & (F.col("conv_id") % 7 == 0), "judge").otherwise(F.col("role")))
    m = F.col("messages")
    return T.chat_rows(H.conversations(turns)).select("conv_id", "error", M.is_multi_turn(m).alias("multi_turn"), M.last_assistant(m).cast("long").alias("trained_turn"))


@query("SELECT count(*) FILTER (WHERE n > 1) > 0 AS multi_turn FROM (SELECT count(*) FILTER (WHERE role = 'assistant') AS n FROM conversations GROUP BY conv_id)")
def multiturn_flag(spark, d):
    return T.has_multi_turn(H.conversations(H.table(spark, d, "conversations")))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND NOT contains(text, '<think>') THEN '<think>r' || turn || '</think>' || chr(10) || text ELSE text END AS content FROM conversations")
def reasoning_merge(spark, d):
    payload = F.when(F.col("conv_id") % 4 == 0, F.to_json(F.struct(F.lit(" ").alias("reasoning"), F.concat(F.lit("r"), F.col("turn")).alias("reasoning_content")))).when(
        F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("r"), F.col("turn")).alias("reasoning")).alias("message"))).alias("choices")))
    )
    t = H.table(spark, d, "conversations")
    return t.select("conv_id", "turn", X.merge_reasoning(F.col("text"), X.provider_reasoning(payload)).alias("content"))


# ---------------------------------------------------------------- balancing, sampling, splitting

_TOTALS = "w(lang, weight) AS (VALUES ('en', 0.5::DOUBLE), ('fr', 0.2::DOUBLE), ('de', 0.2::DOUBLE), ('es', 0.1::DOUBLE)), t AS (SELECT lang AS category, count(*) AS total FROM documents GROUP BY lang), s AS (SELECT category, total, weight, weight / sum(weight) OVER () AS share FROM t JOIN w ON lang = category), b AS (SELECT category, total, weight, trunc(min(total / share) OVER () * share)::INT AS target FROM s)"


def _targets(spark, d):
    counts = H.table(spark, d, "documents").groupBy(F.col("lang").alias("category"), "source").agg(F.count("*").alias("n"))
    return P.balance(P.category_totals(counts).join(spark.createDataFrame(list(WEIGHTS.items()), "category string, weight double"), "category"))


@query(f"WITH {_TOTALS} SELECT category, total, weight, target FROM b")
def balance_targets(spark, d):
    return _targets(spark, d)


@query(f"WITH {_TOTALS}, r AS (SELECT doc_id, lang AS category, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, category FROM r JOIN b USING (category) WHERE k <= target")
def balanced_sample(spark, d):
    docs = H.table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"))
    return P.sample_exactly(docs, _targets(spark, d), SEED, "doc_id")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= 100 THEN 'val' ELSE 'train' END AS split FROM documents")
def train_val_split(spark, d):
    return P.train_val_split(H.table(spark, d, "documents").select("doc_id"), TEST_SIZE, SEED, "doc_id")


@query("SELECT item_id FROM benchmark ORDER BY md5('7:' || item_id), item_id LIMIT 20")
def shuffled_limit(spark, d):
    return P.first_shuffled(H.table(spark, d, "benchmark").select("item_id"), 7, 20, "item_id")


@query("SELECT lang, count(*) AS rows, count(*) - 100 AS train_rows, floor((count(*) - 100) / 32)::BIGINT AS steps_per_epoch, floor((count(*) - 100) / 32)::BIGINT * 3 AS total_steps FROM documents GROUP BY lang")
def step_arithmetic(spark, d):
    return T.steps_columns(H.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("rows")), TEST_SIZE, BATCH, EPOCHS)


@query("SELECT 'a' AS category, 'nation' AS source, n_name AS id FROM nation UNION ALL SELECT 'a', 'region', r_name FROM region UNION ALL SELECT 'b', 'region', r_name FROM region")
def combined_sources(spark, d):
    nation, region = H.table(spark, d, "nation").select(F.col("n_name").alias("id")), H.table(spark, d, "region").select(F.col("r_name").alias("id"))
    return P.combine([("a", "nation", nation), ("a", "region", region), ("b", "region", region)]).select("category", "source", "id")


@query("SELECT r.r_name AS category, n.n_name AS source FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey OR r.r_regionkey = 0")
def recipe_sources(spark, d):
    region, nation = H.table(spark, d, "region"), H.table(spark, d, "nation").select(F.col("n_name").alias("source"), "n_regionkey", F.concat(F.lit("/out/"), F.col("n_name")).alias("path"))
    wanted = region.join(nation, region.r_regionkey == nation.n_regionkey).select(F.col("r_name").alias("category"), "source").union(region.where("r_regionkey = 0").select("r_name", F.lit("all")))
    return P.resolve_sources(P.expand_all(wanted, nation), nation).where("path is not null").select("category", "source")


@query("SELECT coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN n_name END, 'record-' || (row_number() OVER (ORDER BY n_nationkey) - 1)) AS id, n_nationkey FROM nation")
def filled_ids(spark, d):
    t = H.table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("id"))
    return P.fill_ids(P.numbered(t, [F.col("n_nationkey")])).select("id", "n_nationkey")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def content_hash(spark, d):
    return H.table(spark, d, "documents").select("doc_id", N.short_hash(F.col("text")).alias("hash"))


# ---------------------------------------------------------------- evaluation

_MC = H.sql("""SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS completed, count(*) FILTER (WHERE error IS NOT NULL) AS failed,
  count(*) FILTER (WHERE error IS NULL AND item_id % 7 <> 0 AND letter = gold) AS correct, round(count(*) FILTER (WHERE error IS NULL AND item_id % 7 <> 0 AND letter = gold) / count(*) FILTER (WHERE error IS NULL), 9) AS accuracy FROM mc""", "mc")  # fmt: skip


@query(_MC)
def mc_accuracy(spark, d):
    rows = H.mc_rows(spark, d).withColumn("v", J.mc_verdict(F.col("response"), F.col("gold"))).select("error", "v.correct")
    return rows.agg(*E.accuracy()).withColumn("accuracy", F.round("accuracy", 9))


@query(H.sql("SELECT item_id, CASE WHEN item_id % 7 <> 0 THEN letter END AS extracted, coalesce(item_id % 7 <> 0 AND letter = gold, false) AS correct, CASE WHEN item_id % 7 <> 0 AND letter = gold THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM mc", "mc"))
def mc_verdicts(spark, d):
    return H.mc_rows(spark, d).select("item_id", J.mc_verdict(F.col("response"), F.col("gold")).alias("v")).select("item_id", "v.*")


@query("SELECT item_id, r AS run FROM benchmark, range(1, 4) t(r)")
def eval_runs(spark, d):
    return E.times(H.table(spark, d, "benchmark").select("item_id"), 3).select("item_id", F.col("run").cast("long").alias("run"))


def _assessed(spark, d):
    rows = H.judge_rows(spark, d).withColumn("a", J.assessment(J.xml_entries(F.col("response"))))
    return rows.select("doc_id", "lang", "error", F.col("a.score").alias("score"), F.col("a.error").alias("parse_error"), F.col("a.analysis").alias("analysis"), J.judge_verdict(F.col("a"), 5)["correct"].alias("correct"))


@query(H.sql("SELECT doc_id, score, parse_error, lang AS analysis, CASE WHEN score <> 0 THEN score = 5 END AS correct FROM judge", "judge"))
def judge_assessments(spark, d):
    return _assessed(spark, d).select("doc_id", "score", "parse_error", "analysis", "correct")


@query(H.sql("""SELECT lang, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS completed, count(*) FILTER (WHERE error IS NOT NULL) AS failed, count(*) FILTER (WHERE error IS NULL AND score IS NULL) AS parse_failures,
  count(*) FILTER (WHERE error IS NULL AND score IS NOT NULL) AS scored_count, round(avg(coalesce(score, 1)) FILTER (WHERE error IS NULL), 9) AS mean_score FROM judge GROUP BY lang""", "judge"))  # fmt: skip
def judge_scores(spark, d):
    return _assessed(spark, d).groupBy("lang").agg(*E.runner_scored(5)).withColumn("mean_score", F.round("mean_score", 9))


@query(H.sql("SELECT lang, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS completed, count(*) FILTER (WHERE error IS NOT NULL) AS failed, round(avg(score) FILTER (WHERE error IS NULL), 9) AS mean_score FROM judge GROUP BY lang", "judge"))
def scored_library_metrics(spark, d):
    return _assessed(spark, d).groupBy("lang").agg(*E.library_scored()).withColumn("mean_score", F.round("mean_score", 9))


@query(H.sql("SELECT b::INT AS bin, count(doc_id) AS n FROM range(1, 8) t(b) LEFT JOIN (SELECT doc_id, round_even((score + doc_id % 2) / 2 + 1, 0) AS s FROM judge WHERE error IS NULL AND score IS NOT NULL) ON s = b GROUP BY b", "judge"))
def judge_histogram(spark, d):
    return E.histogram(_assessed(spark, d).withColumn("score", (F.col("score") + F.col("doc_id") % 2) / 2 + 1), 7)


@query("SELECT doc_id, round(((1 + doc_id % 5) + (1 + doc_id % 3)) / 2, 9) AS final_score FROM documents")
def judge_means(spark, d):
    one = lambda s: F.struct(s.cast("double").alias("score"))
    js = F.array(one(1 + F.col("doc_id") % 5), one(F.lit(None)), one(1 + F.col("doc_id") % 3))
    return H.table(spark, d, "documents").select("doc_id", F.round(E.final_score(js), 9).alias("final_score"))


@query("SELECT o_orderpriority AS eval, CASE WHEN count(DISTINCT o_orderstatus) > 2 THEN round(avg(o_totalprice), 4) ELSE 0.5 END AS score, (count(*) // 3)::INT AS n_samples, count(*) // 3 >= 400 AS complete FROM orders GROUP BY 1")
def index_scores(spark, d):
    runs = H.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("eval")).agg(F.count("*").alias("records"), F.avg("o_totalprice").alias("mean_score"), (F.countDistinct("o_orderstatus") - 2).alias("bins"))
    out = E.index_scores(runs.withColumn("runs", F.lit(3)).withColumn("dataset_size", F.lit(400)).withColumn("accuracy", F.lit(0.5)))
    return out.select("eval", F.round("score", 4).alias("score"), "n_samples", "complete")


@query("SELECT c_custkey, 'Write to ' || c_name || ' of {nation} ' || c_nationkey || '.' AS prompt, c_mktsegment AS topic FROM customer")
def prompt_format(spark, d):
    t = E.map_fields(H.table(spark, d, "customer"), {"topic": "c_mktsegment", "absent": "nope"})
    return t.select("c_custkey", E.prompt_column("Write to {c_name} of {{nation}} {c_nationkey}.", t.columns).alias("prompt"), "topic")


@query("SELECT event_type = 'error' AS failed, count(*) AS n FROM events GROUP BY 1")
def error_partition(spark, d):
    rows = H.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.struct(F.lit("error").alias("error"))).alias("__ERROR__"))
    good, bad = E.split_errors(rows)
    return good.agg(F.count("*").alias("n")).select(F.lit(False).alias("failed"), "n").union(bad.agg(F.count("*").alias("n")).select(F.lit(True), "n"))


@query("SELECT 'e' || ((props->>'$.k')::INT % 3) AS error_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def error_types(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    return E.errors_by_type(H.table(spark, d, "events").withColumn("error_type", F.when(F.col("event_type") == "error", F.concat(F.lit("e"), k))))


# ---------------------------------------------------------------- results


@query(H.sql("SELECT id, pos, eval, model, round(score, 9) AS score FROM results WHERE complete AND NOT archived AND model = 'm1'", "results"))
def results_visible(spark, d):
    return R.visible(H.results(spark, d), model="m1").select("id", "pos", "eval", "model", F.round("score", 9).alias("score"))


@query(H.sql("SELECT eval, count(*) FILTER (WHERE archived) AS archived, count(*) FILTER (WHERE NOT archived AND NOT complete) AS partial FROM results GROUP BY eval", "results"))
def results_hidden_counts(spark, d):
    return H.results(spark, d).groupBy("eval").agg(*R.hidden_counts())


@query(H.sql(""", r AS (SELECT eval, dataset_sha, model, score, row_number() OVER (PARTITION BY eval, dataset_sha, model ORDER BY timestamp, id) AS run FROM results WHERE complete AND NOT archived AND model IN ('m1', 'm2')),
p AS (SELECT eval, dataset_sha, run, max(score) FILTER (WHERE model = 'm1') AS m1, max(score) FILTER (WHERE model = 'm2') AS m2 FROM r GROUP BY ALL)
SELECT eval, dataset_sha, run, round(m1, 9) AS m1, round(m2, 9) AS m2, round(m2 - m1, 9) AS delta FROM p""", "results"))  # fmt: skip
def results_compare(spark, d):
    t = R.compare(R.visible(H.results(spark, d)), ["m1", "m2"], ["eval", "dataset_sha"])
    return t.select("eval", "dataset_sha", F.col("run").cast("long").alias("run"), F.round("m1", 9).alias("m1"), F.round("m2", 9).alias("m2"), F.round("delta", 9).alias("delta"))


@query(H.sql(", r AS (SELECT *, row_number() OVER (PARTITION BY eval ORDER BY timestamp DESC, id DESC) AS rank, greatest(count(*) OVER (PARTITION BY eval) - 3, 0) AS earlier FROM results) SELECT eval, rank, id, earlier FROM r WHERE rank <= 3", "results"))
def recent_top3(spark, d):
    return R.latest(H.results(spark, d), 3, "eval").select("eval", F.col("rank").cast("long").alias("rank"), "id", F.col("earlier").cast("long").alias("earlier"))


@query(H.sql("SELECT eval, dataset_sha, model, count(*) AS runs, min(pos) AS first_pos FROM results GROUP BY ALL", "results"))
def config_groups(spark, d):
    return R.groups_in_order(H.results(spark, d), ["eval", "dataset_sha", "model"])


@query(H.sql("SELECT pos, substr(split_part(id, '-', 2), 5, 4) || '-' || split_part(id, '-', 4) AS short FROM results", "results"))
def short_ids(spark, d):
    return H.results(spark, d).select("pos", N.short_id(F.col("id")).alias("short"))


@query(H.sql("SELECT alias, count(*) AS n FROM results WHERE lower(alias) = 'e001' OR starts_with(lower(alias), 'e001-') GROUP BY alias", "results"))
def experiment_results(spark, d):
    return R.of_experiment(H.results(spark, d), "E001").groupBy("alias").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_partkey // 2 AS pair, p_partkey % 2 AS side, unnest(['p_name', 'p_brand', 'p_type', 'p_size']) AS field, unnest([p_name, p_brand, p_type, p_size::VARCHAR]) AS v FROM part)
SELECT x.pair, x.field, x.v AS a, y.v AS b FROM p x JOIN p y ON x.pair = y.pair AND x.field = y.field AND x.side = 0 AND y.side = 1 WHERE x.v IS DISTINCT FROM y.v""")  # fmt: skip
def config_diff(spark, d):
    fields = ["p_name", "p_brand", "p_type", "p_size"]
    m = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    t = H.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 2).alias("pair"), (F.col("p_partkey") % 2).alias("side"), m.alias("m"))
    both = t.where("side = 0").select("pair", F.col("m").alias("ma")).join(t.where("side = 1").select("pair", F.col("m").alias("mb")), "pair")
    return both.select("pair", F.explode(N.config_diff(F.col("ma"), F.col("mb"))).alias("field", "v")).select("pair", "field", "v.a", "v.b")


@query("SELECT o_custkey % 500 AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS pos FROM orders GROUP BY 1")
def latest_versions(spark, d):
    t = H.table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("pos"))
    return R.latest_versions(t).select("id", "pos")


# ---------------------------------------------------------------- lineage

_MANIFEST_SQL = """WITH o AS (SELECT lang, doc_id, substr(sha256(text), 1, 16) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT lang, doc_id, substr(sha256(text || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END), 1, 16) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.lang, n.lang) AS category, coalesce(o.doc_id, n.doc_id)::VARCHAR AS name, CASE WHEN o.doc_id IS NULL THEN 'New' WHEN n.doc_id IS NULL THEN 'Removed' ELSE 'Changed' END AS status
FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.lang = n.lang WHERE o.h IS DISTINCT FROM n.h"""


def _manifests(spark, d):
    t = H.table(spark, d, "documents")
    row = lambda x: (F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("name"), N.short_hash(x).alias("hash"))
    new = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""))
    return t.where("doc_id % 7 <> 0").select(*row(F.col("text"))), t.where("doc_id % 11 <> 0").select(*row(new))


@query(_MANIFEST_SQL)
def manifest_diff(spark, d):
    return L.manifest_diff(*_manifests(spark, d))


@query(f"""WITH m AS ({_MANIFEST_SQL}), s AS (SELECT category AS owner, count(*) AS changes FROM m GROUP BY category), p AS (SELECT DISTINCT lang AS owner FROM documents)
SELECT owner, CASE WHEN owner = 'en' THEN 1 WHEN owner = 'fr' THEN coalesce(changes, 0) + 1 ELSE coalesce(changes, 0) END AS n_reasons, 'STALE' AS status FROM p LEFT JOIN s USING (owner)""")  # fmt: skip
def pipeline_status(spark, d):
    old, new = _manifests(spark, d)
    shape = lambda t: t.select(F.col("category").alias("owner"), F.col("name").alias("attr"), "hash")
    owner = F.col("owner")
    pipes = H.table(spark, d, "documents").select(F.col("lang").alias("owner")).distinct().select("owner", (owner != "en").alias("has_manifest"), F.lit(True).alias("has_output"), (owner == "fr").alias("partial"), F.lit("a").alias("old_code"), F.lit("a").alias("new_code"))
    return L.pipeline_status(pipes, L.dependency_changes(shape(old), shape(new))).select("owner", F.size("reasons").cast("long").alias("n_reasons"), "status")


# ---------------------------------------------------------------- registries


@query(H.sql("SELECT name, arg_max(provider, priority) AS provider, arg_max(model, priority) AS model FROM layers GROUP BY name", "layers"))
def registry_overlay(spark, d):
    return G.overlay(*H.registry_rows(spark, d)).select("name", "provider", "model")


@query(H.sql("SELECT CASE WHEN model LIKE '%5' THEN 'prompted' WHEN provider = 'tinker' AND model LIKE '%0' THEN 'trained' ELSE 'plain' END AS class, count(*) AS n FROM layers GROUP BY 1", "layers"))
def model_classes(spark, d):
    a, b, c = H.registry_rows(spark, d)
    rows = a.union(b).union(c).withColumn("sysprompt", F.when(F.endswith("model", F.lit("5")), "Be brief.")).withColumn("model", F.concat("model", F.when(F.endswith("model", F.lit("0")), "::r").otherwise("")))
    return G.class_counts(rows)


@query("""SELECT p_partkey, p_brand AS base_model, CASE WHEN p_partkey % 3 = 0 THEN 'qwen3' ELSE p_type END AS renderer, CASE WHEN p_partkey % 3 = 2 THEN p_name END AS path,
  regexp_matches('e' || (p_partkey % 100) || CASE WHEN p_partkey % 4 = 0 THEN '-final' ELSE '' END, '^e[0-9]+-') AS is_checkpoint FROM part""")  # fmt: skip
def checkpoint_parse(spark, d):
    k = F.col("p_partkey")
    spec = F.concat_ws("::", "p_brand", F.when(k % 3 != 0, F.col("p_type")), F.when(k % 3 == 2, F.col("p_name")))
    name = F.concat(F.lit("e"), k % 100, F.when(k % 4 == 0, "-final").otherwise(""))
    return H.table(spark, d, "part").select("p_partkey", N.checkpoint_spec(spec).alias("s"), N.is_checkpoint_name(name).alias("is_checkpoint")).select("p_partkey", "s.*", "is_checkpoint")


@query("SELECT n_name AS name, 'unknown' AS organization, coalesce(r_name, 'unknown') AS training_type, coalesce(lower(r_name), 'unknown') AS architecture, coalesce(r_regionkey % 2 = 0, false) AS vision FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 4")
def catalog_enrich(spark, d):
    nation, region = H.table(spark, d, "nation"), H.table(spark, d, "region").where("r_regionkey <> 4")
    meta = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("name"), F.col("r_name").alias("training_type"), F.lower("r_name").alias("architecture"), (F.col("r_regionkey") % 2 == 0).alias("vision"))
    return G.catalog(G.enrich(nation.select(F.col("n_name").alias("name")), meta))


@query(H.sql(""", r AS (SELECT name, arg_max(provider, priority) AS provider, arg_max(model, priority) AS model FROM layers GROUP BY name)
SELECT o_orderkey, provider, r.model AS model_resolved, CASE WHEN provider IS NULL THEN 'Unknown model: ' || (o_custkey * 2) WHEN provider NOT IN ('local', 'tinker') THEN 'Unsupported provider: ' || provider END AS fault FROM orders LEFT JOIN r ON r.name = (o_custkey * 2)::VARCHAR""", "layers"))  # fmt: skip
def model_routing(spark, d):
    asked = H.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).cast("string").alias("model"))
    return G.route(asked, G.overlay(*H.registry_rows(spark, d)), ("local", "tinker")).select("o_orderkey", "provider", "model_resolved", "fault")


@query("WITH v AS (SELECT DISTINCT 'v' || (p_size % 7) || '.' || (p_size % 3) AS version, p_brand AS variant FROM part) SELECT version, list_sort(list(variant))::VARCHAR[] AS variants, list_transform(list_sort(list(variant)), lambda x: 'id-' || version || '-' || x) AS models, version = 'v1.1' AS is_release FROM v GROUP BY version")
def version_listing(spark, d):
    rows = H.table(spark, d, "part").select(F.concat(F.lit("v"), F.col("p_size") % 7, F.lit("."), F.col("p_size") % 3).alias("version"), F.col("p_brand").alias("variant"))
    return G.versions(rows, "id", "v1.1")


@query("SELECT DISTINCT 'v' || (p_size % 7) || '.' || (p_size % 12) AS version FROM part")
def version_names(spark, d):
    names = H.table(spark, d, "part").select(F.concat(F.lit("id-v"), F.col("p_size") % 7, F.lit("."), F.col("p_size") % 12, F.lit("-full")).alias("name"))
    return G.version_names(names, N.version_in_name(F.col("name")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'deepseekv3_thinking' WHEN 1 THEN 'qwen3' WHEN 2 THEN 'kimi_k2' END AS renderer, CASE p_partkey % 4 WHEN 0 THEN 'unsloth' WHEN 1 THEN 'axolotl' WHEN 2 THEN 'prime' ELSE 'tinker' END AS backend FROM part")
def model_formats(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "deepseek-ai/DeepSeek-V3.1").when(k == 1, "Qwen/Qwen3-8B").when(k == 2, "moonshotai/Kimi-K2").otherwise("other/model")
    alias = F.when(k == 0, " USNLOTH").when(k == 1, "axlotol").when(k == 2, "Prime-Intellect").otherwise("")
    return H.table(spark, d, "part").select("p_partkey", G.model_format(name).alias("renderer"), N.backend(alias).alias("backend"))


@query("""WITH w AS (SELECT s_suppkey, 'E' || (s_suppkey % 50) AS e FROM supplier), c AS (SELECT 'E' || (p_partkey % 40) AS e, arg_min(p_name, p_partkey) AS path FROM part GROUP BY 1)
SELECT s_suppkey, coalesce(path, w.e || '/final') AS path FROM w LEFT JOIN c USING (e)""")  # fmt: skip
def checkpoint_paths(spark, d):
    log = H.table(spark, d, "part").select(F.concat(F.lit("E"), F.col("p_partkey") % 40).alias("experiment"), F.lit("final").alias("checkpoint"), F.col("p_name").alias("path"), F.col("p_partkey").alias("pos"))
    wanted = H.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("E"), F.col("s_suppkey") % 50).alias("experiment"), F.lit("final").alias("checkpoint"))
    return G.checkpoint_path(wanted, log).select("s_suppkey", "path")


# ---------------------------------------------------------------- training logs


def _curve(spark, d):
    return T.curve(T.normalize_metrics(H.metric_rows(spark, d)), STEPS, PARAMETERS)


_CURVE_SQL = H.sql("SELECT step, round(train_loss, 9) AS train_loss, round(g / 2000, 9) AS grad, round(val_loss, 9) AS val_loss, round((step + 1) / 10000, 9) AS progress FROM metrics", "metrics")


@query(_CURVE_SQL)
def metrics_curve(spark, d):
    return _curve(spark, d).select("step", *[F.round(c, 9).alias(c) for c in ("train_loss", "grad", "val_loss", "progress")])


@query(H.sql("SELECT max(step) AS last_step, round(arg_max(train_loss, step) FILTER (WHERE train_loss IS NOT NULL), 9) AS final_train_loss, round(arg_max(val_loss, step) FILTER (WHERE val_loss IS NOT NULL), 9) AS final_val_loss, round(arg_max(g, step) FILTER (WHERE g IS NOT NULL) / 2000, 9) AS final_grad FROM metrics", "metrics"))
def metrics_final(spark, d):
    t = T.final_values(_curve(spark, d))
    return t.select("last_step", *[F.round(c, 9).alias(c) for c in t.columns[1:]])


@query("WITH r AS (SELECT 'E' || (o_custkey % 20) AS experiment, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey DESC) AS k, count(*) OVER (PARTITION BY o_custkey % 20) AS n FROM orders) SELECT experiment, pos, greatest(n - 5, 0) AS earlier FROM r WHERE k <= 5")
def last_checkpoints(spark, d):
    t = H.table(spark, d, "orders").select(F.concat(F.lit("E"), F.col("o_custkey") % 20).alias("experiment"), F.col("o_orderkey").alias("pos"))
    return T.last_checkpoints(t).select("experiment", "pos", F.col("earlier").cast("long").alias("earlier"))


@query("SELECT 'e' || printf('%03d', max(c_custkey)) AS name FROM (SELECT c_custkey % 700 + 1 AS c_custkey FROM customer)")
def next_experiment(spark, d):
    k = F.col("c_custkey")
    names = H.table(spark, d, "customer").select(F.format_string("E%03d", k % 700).alias("name")).union(H.table(spark, d, "customer").select(F.concat(F.lit("backup-E9"), k)))
    return T.next_experiment(names)


@query("WITH c AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey) SELECT c_custkey, CASE WHEN s IS NULL THEN 'not started' WHEN s = 'F' THEN 'done' ELSE 'in progress' END AS status FROM customer LEFT JOIN c ON c_custkey = o_custkey")
def experiment_status(spark, d):
    log = H.table(spark, d, "orders").select(F.col("o_custkey").alias("experiment"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "F", "final").otherwise("step").alias("line"))
    return T.experiment_status(H.table(spark, d, "customer").select(F.col("c_custkey").alias("experiment")), log).select(F.col("experiment").alias("c_custkey"), "status")


# ---------------------------------------------------------------- model calls


@query("SELECT conv_id || '-' || turn AS id, md5(text) AS response FROM conversations WHERE role = 'user'")
def rollout_single(spark, d):
    records = H.table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("prompt"))
    good, _ = E.split_errors(O.rollout(records, O.single_turn))
    return good.select("id", F.element_at("messages", -1)["content"].alias("response"))


@query("SELECT conv_id::VARCHAR AS id, count(*) + count(*) FILTER (WHERE role = 'user') AS n_messages, count(*) FILTER (WHERE role = 'user') AS n_steps FROM conversations WHERE role <> 'assistant' GROUP BY conv_id")
def rollout_multi(spark, d):
    turns = H.conversations(H.table(spark, d, "conversations").where("role <> 'assistant'")).select(F.col("conv_id").cast("string").alias("id"), F.col("messages").alias("turns"))
    out = O.rollout(turns, O.multi_turn)
    return out.select("id", F.size("messages").cast("long").alias("n_messages"), F.size("steps").cast("long").alias("n_steps"))


def _odd_task(record: dict):
    answer = yield O.model_request([{"role": "user", "content": record["prompt"]}])
    k = record["k"]
    if k == 0:
        raise O.PipelineError("refused", "refusal")
    if k == 1:
        return None
    if k == 2:
        raise ValueError("broken")
    return O.Sample(record["id"], [{"role": "assistant", "content": answer.text}])


@query("SELECT CASE conv_id % 5 WHEN 0 THEN 'refusal' WHEN 1 THEN 'skipped' WHEN 2 THEN 'unexpected_error' ELSE 'ok' END AS outcome, count(*) AS n, count(*) AS n_steps FROM conversations GROUP BY 1")
def rollout_errors(spark, d):
    records = H.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("prompt"), (F.col("conv_id") % 5).alias("k"))
    out = O.rollout(records, _odd_task)
    return out.groupBy(F.coalesce(F.col("__ERROR__.error"), F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.size(F.coalesce("steps", "__ERROR__.steps"))).alias("n_steps"))


@query("SELECT doc_id, lang, source, n_chars::VARCHAR AS n FROM documents")
def nested_xml(spark, d):
    x = F.concat(F.lit("<doc><meta><lang> "), "lang", F.lit(" </lang><source>"), "source", F.lit("</source></meta></doc><n>"), "n_chars", F.lit("</n>"))
    found = H.table(spark, d, "documents").select("doc_id", J.xml_fields(x).alias("fields"))
    return found.select("doc_id", *[F.col("fields")[n].alias(n) for n in ("lang", "source", "n")])


@query(_CURVE_SQL)
def metrics_stream(spark, d):
    """The metrics log written in parts and followed as a stream to its end; rows as metrics_curve has them."""
    folder = scratch(spark)
    H.metric_rows(spark, d).repartition(4, "step").write.mode("overwrite").json(folder)
    out = f"{folder}-out"
    flow = stream.follow(spark, folder, STEPS, PARAMETERS, files_per_trigger=2)
    stream.on_progress(flow, lambda batch, _: batch.write.mode("append").parquet(out), f"{folder}-state", once=True).awaitTermination()
    return spark.read.schema(flow.schema).parquet(out).select("step", *[F.round(c, 9).alias(c) for c in ("train_loss", "grad", "val_loss", "progress")])


# ---------------------------------------------------------------- messages, names and records


@query(r"""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN text WHEN 1 THEN '<think>r</think>' || text WHEN 2 THEN '' ELSE text || text END AS content FROM conversations""")
def content_blocks(spark, d):
    k, x = (F.col("conv_id") + F.col("turn")) % 4, F.col("text")
    thought = F.to_json(F.struct(F.lit("thinking").alias("type"), F.lit("r").alias("thinking")))
    said, bare = F.to_json(F.struct(F.lit("text").alias("type"), x.alias("text"))), F.to_json(F.struct(x.alias("text")))
    quoted = F.substring(F.to_json(F.struct(x.alias("x"))), 6, 1_000_000_000)
    blocks = lambda *b: F.concat(F.lit("["), F.concat_ws(",", *b), F.lit("]"))
    json = F.when(k == 0, F.regexp_replace(quoted, r"\}\z", "")).when(k == 1, blocks(thought, said)).when(k == 2, "[]").otherwise(blocks(said, bare))
    return H.table(spark, d, "conversations").select("conv_id", "turn", X.normalize_content(json).alias("content"))


@query("""SELECT conv_id, count(*) + 2 AS forced, count(*) + 1 AS answered, CASE WHEN conv_id % 3 = 0 THEN 'fallback' ELSE arg_min(text, turn) END AS first_content FROM conversations GROUP BY conv_id""")
def message_assembly(spark, d):
    m = F.col("messages")
    none = F.when(F.col("conv_id") % 3 == 0, F.slice(m, 1, 0)).otherwise(m)
    return H.conversations(H.table(spark, d, "conversations")).select(
        "conv_id", F.size(M.append_assistant(M.inject_system(m, F.lit("p"), always=True), F.lit("a"))).cast("long").alias("forced"), F.size(M.append_assistant(m, F.lit("a"))).cast("long").alias("answered"),
        F.get(M.or_prompt(none, F.lit("fallback")), F.lit(0))["content"].alias("first_content"),
    )


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS n_params, CASE WHEN event_type = 'view' THEN event_id::VARCHAR END AS max_tokens FROM events")
def sampling_params(spark, d):
    given = F.create_map(F.lit("temperature"), F.lit("0.7"), F.lit("max_tokens"), F.when(F.col("event_type") == "view", F.col("event_id").cast("string")), F.lit("odd"), F.lit("x"))
    p = M.sampling_params(given)
    return H.table(spark, d, "events").select("event_id", F.size(p).alias("n_params"), F.try_element_at(p, F.lit("max_tokens")).alias("max_tokens"))


@query("""SELECT p_partkey, lower(p_brand) AS base, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'unknown' END AS organization, 'v' || (p_size % 9) || '.' || (p_size % 5) AS version, replace(p_name, ' ', '-') || '-x' AS file,
  CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'prompted_trained' WHEN p_partkey % 2 = 0 THEN 'trained' WHEN p_partkey % 3 = 0 THEN 'prompted' ELSE 'base' END AS mode,
  lower(CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_brand || '-' || p_size END) AS checkpoint, CASE WHEN p_partkey % 7 = 0 THEN 'E' || p_partkey ELSE 'ev' END AS folder,
  p_brand || '::' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'qwen3' END || '::' || p_name AS model, floor(p_retailprice / 10000 * p_size + 0.5)::INT AS correct,
  CASE p_partkey % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'scaled:' || p_size ELSE 'unknown' END AS score_type, p_brand || ' | ' || p_size AS header FROM part""")  # fmt: skip
def model_names(spark, d):
    k, brand, size = F.col("p_partkey"), F.col("p_brand"), F.col("p_size")
    even, third = k % 2 == 0, k % 3 == 0
    return H.table(spark, d, "part").select(
        "p_partkey", N.base_name(F.concat(F.lit("a/b/"), brand)).alias("base"), N.organization(F.when(even, F.concat_ws("/", "p_type", "p_name")).otherwise(F.lit("plain"))).alias("organization"),
        N.version_of_alias(F.concat(F.lit("id-v"), size % 9, F.lit("."), size % 5, F.lit("-full"))).alias("version"), N.safe_file_name(F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("::x"))).alias("file"),
        N.model_mode(F.when(even, "a::b").otherwise("a"), F.when(third, "Be brief.").otherwise("")).alias("mode"), N.checkpoint_name(brand, F.when(k % 5 == 0, "final").otherwise(size.cast("string"))).alias("checkpoint"),
        N.output_name(F.when(k % 7 == 0, F.concat(F.lit("e"), k, F.lit("-final"))).otherwise("gpt"), F.lit("ev")).alias("folder"), N.model_string(brand, F.when(even, F.col("p_type")), F.col("p_name")).alias("model"),
        N.correct_estimate(F.col("p_retailprice") / 10000, size).alias("correct"), N.score_type(F.when(third, "binary").when(k % 3 == 1, "scaled"), size).alias("score_type"), N.header(brand, F.lit(None), size).alias("header"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS iso, o_orderdate AS back FROM orders")
def iso_times(spark, d):
    iso = N.iso_encode(F.col("o_orderdate"))
    return H.table(spark, d, "orders").select("o_orderkey", iso.alias("iso"), N.iso_decode(iso).alias("back"))


@query("SELECT conv_id, count(*) AS n, md5(string_agg(role || text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def record_json(spark, d):
    said = H.conversations(H.table(spark, d, "conversations")).select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), "messages")).alias("json"))
    back = said.select("conv_id", F.from_json("json", TRAIN_SAMPLE).alias("s"))
    return back.select("conv_id", F.size("s.messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("s.messages", lambda m: F.concat(m["role"], m["content"])), "")).alias("digest"))


@query("SELECT doc_id, 'Judge it.' || chr(10) || chr(10) || 'Prompt:' || chr(10) || lang || chr(10) || chr(10) || 'Response:' || chr(10) || source || chr(10) || chr(10) || 'Reply with <analysis>your reasoning</analysis> and <score>1-5</score>.' AS prompt FROM documents")
def judge_prompts(spark, d):
    return H.table(spark, d, "documents").select("doc_id", J.judge_prompt(F.lit("Judge it."), F.col("source"), F.col("lang"), 5).alias("prompt"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN s_name ELSE n_name END AS model FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 25 LEFT JOIN supplier ON s_suppkey = c_custkey % 60")
def alias_resolution(spark, d):
    k = F.col("c_custkey")
    nation = H.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.col("n_name").alias("model"))
    log = H.table(spark, d, "supplier").select(F.concat(F.lit("exp"), "s_suppkey").alias("name"), F.col("s_name").alias("model"))
    asked = H.table(spark, d, "customer").select("c_custkey", F.when(k % 4 == 0, "none").when(k % 2 == 0, F.concat(F.lit("exp"), k % 60)).otherwise(F.concat(F.lit("n"), k % 25)).alias("alias"))
    return G.resolve_alias(asked, nation, log).select("c_custkey", "model")


@query("SELECT 'id-release-' || n_name AS alias, 'id-v1.0-' || n_name AS target FROM nation WHERE n_regionkey = 1")
def release_aliases(spark, d):
    names = H.table(spark, d, "nation").select(F.concat(F.when(F.col("n_regionkey") == 1, "id-v1.0-").otherwise("id-v1.1-"), "n_name").alias("name"))
    return G.release_aliases(names, "id", "v1.0")


@query("SELECT name FROM (SELECT 'e' || lpad(c_custkey::VARCHAR, 6, '0') AS name FROM customer) ORDER BY name DESC LIMIT 20")
def recent_experiments(spark, d):
    return T.recent_experiments(H.table(spark, d, "customer").select(F.concat(F.lit("e"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("name")), 20, False)


@query(H.sql("SELECT 'all' AS view, count(*) AS n FROM results UNION ALL SELECT 'visible', count(*) FILTER (WHERE complete AND NOT archived) FROM results", "results"))
def results_counts(spark, d):
    t = H.results(spark, d)
    return R.visible(t, include_all=True).agg(F.count("*").alias("n")).select(F.lit("all").alias("view"), "n").union(R.visible(t).agg(F.count("*").alias("n")).select(F.lit("visible"), "n"))


@query(f"WITH m AS ({_MANIFEST_SQL}), s AS (SELECT DISTINCT category AS owner FROM m UNION SELECT 'en' UNION SELECT 'fr') SELECT DISTINCT d.source, coalesce(s.owner IS NOT NULL, false) OR d.source = 'src0' AS stale FROM (SELECT DISTINCT CASE WHEN source = 'src0' THEN source ELSE lang END AS source FROM documents) d LEFT JOIN s ON s.owner = d.source")
def source_staleness(spark, d):
    docs = H.table(spark, d, "documents")
    return L.source_staleness(docs.select(F.when(F.col("source") == "src0", F.col("source")).otherwise(F.col("lang")).alias("source")).distinct(), pipeline_status(spark, d))


@query("SELECT f AS field, a, b FROM (SELECT unnest(['n_name', 'n_nationkey', 'n_regionkey']) AS f, unnest([x.n_name, x.n_nationkey::VARCHAR, x.n_regionkey::VARCHAR]) AS a, unnest([y.n_name, y.n_nationkey::VARCHAR, y.n_regionkey::VARCHAR]) AS b FROM nation x, nation y WHERE x.n_nationkey = 0 AND y.n_nationkey = 5) WHERE a IS DISTINCT FROM b")
def result_pair_diff(spark, d):
    t = H.table(spark, d, "nation")
    return R.pair_diff(t.where("n_nationkey = 0"), t.where("n_nationkey = 5"), ["n_name", "n_nationkey", "n_regionkey"])


from . import stored  # noqa: E402, F401 - adds the queries that write and read files
