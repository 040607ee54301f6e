"""The records that queries work on, derived from the fixture tables; the same rules stand in shapes_sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tagged(spark: SparkSession, d: str, role: str | None = "assistant") -> DataFrame:
    """conv_id, turn, role, text; assistant texts carry eight kinds of reasoning tags."""
    t = table(spark, d, "conversations")
    k, x = (F.col("conv_id") * 3 + F.col("turn")) % 8, F.col("text")
    forms = {0: F.concat(F.lit("<think>plan</think>"), x), 1: x, 2: F.concat(F.lit("<think>"), x), 3: F.concat(F.lit("<think><think>x</think>"), x), 4: F.concat(F.lit("<think>x</think>"), x, F.lit("</think>")), 5: F.concat(F.lit("<think> </think>"), x), 6: F.lit("<think>x</think>")}
    text = F.concat(F.lit("</think>"), x, F.lit("<think>"))
    for n, form in forms.items():
        text = F.when(k == n, form).otherwise(text)
    out = t.select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", text).otherwise(x).alias("text"))
    return out if role is None else out.where(F.col("role") == role)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, messages in order of turns."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """Index rows from orders."""
    hexed = F.lpad(F.lower(F.hex(F.col("o_orderkey") % 65536)), 4, "0")
    return table(spark, d, "orders").select(
        F.concat(F.lit("batch-"), F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit("-"), hexed).alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderpriority").alias("eval"), F.concat(F.lit("m"), F.col("o_custkey") % 4).alias("model"), F.concat(F.lit("E00"), F.col("o_custkey") % 4, F.when(F.col("o_custkey") % 3 == 0, "-final").otherwise("")).alias("alias"),
        F.col("o_orderstatus").alias("dataset_sha"), ((F.col("o_totalprice") % 1000) / 1000).alias("score"), (F.col("o_orderstatus") != "P").alias("complete"), (F.col("o_orderkey") % 10 == 0).alias("archived"),
    )


def mc_rows(spark: SparkSession, d: str) -> DataFrame:
    """item_id, response, gold, error."""
    i = F.col("item_id")
    letter = F.char(65 + F.floor(i * 7 / 3) % 4)
    response = F.when(i % 7 == 0, "no letter here").when(i % 5 == 0, F.concat(F.lit("I think the answer is "), letter)).otherwise(F.concat(F.lit("Reason first.\nAnswer: "), letter))
    return table(spark, d, "benchmark").select("item_id", response.alias("response"), F.char(65 + i % 4).alias("gold"), F.when(i % 13 == 0, "timeout").alias("error"))


def judge_rows(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, response (tagged fields), error."""
    i = F.col("doc_id")
    s = (1 + i % 5).cast("string")
    score = F.when(i % 11 == 0, "").when(i % 6 == 0, "<score>high</score>").when(i % 13 == 0, F.concat(F.lit("<score>"), s, F.lit("-9</score>"))).otherwise(F.concat(F.lit("<score>"), s, F.lit("</score>")))
    return table(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit("<analysis> "), F.col("lang"), F.lit(" </analysis>"), score).alias("response"), F.when(i % 17 == 0, "Judge error").alias("error"))


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """A metrics log from events."""
    t = table(spark, d, "events")
    return t.select(
        F.col("event_id").alias("step"), (F.col("value") / 100).alias("loss"), F.when(F.col("event_type") != "error", F.col("value") * 2).alias("grad_norm"),
        F.when(F.col("event_id") % 50 == 0, F.col("value") / 90).alias("val_mean_nll"), F.when(F.col("event_id") % 25 == 0, F.col("value") / 80).alias("eval_loss"),
    )


def registry_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three layers (name, provider, model, pos) with clashing names: nations, customers, suppliers by number."""
    layer = lambda name, key, label: table(spark, d, name).select(F.regexp_extract(key, "([0-9]+)$", 1).cast("int").cast("string").alias("name"), F.lit(label).alias("provider"), F.col(key).alias("model"), F.lit(0).cast("long").alias("pos"))
    return layer("nation", "n_name", "plain"), layer("customer", "c_name", "tinker"), layer("supplier", "s_name", "local")


#: The same in DuckDB, as common table expressions.
SQL = {
    "tagged": """tagged AS (SELECT conv_id, turn, role, CASE WHEN role <> 'assistant' THEN text ELSE CASE (conv_id * 3 + turn) % 8 WHEN 0 THEN '<think>plan</think>' || text WHEN 1 THEN text
  WHEN 2 THEN '<think>' || text WHEN 3 THEN '<think><think>x</think>' || text WHEN 4 THEN '<think>x</think>' || text || '</think>' WHEN 5 THEN '<think> </think>' || text
  WHEN 6 THEN '<think>x</think>' ELSE '</think>' || text || '<think>' END END AS text FROM conversations)""",
    "judged": r"""judged AS (SELECT *, (len(x) - len(replace(x, '<think>', ''))) // 7 AS o, (len(x) - len(replace(x, '</think>', ''))) // 8 AS c,
  regexp_replace(regexp_extract(x, '(?s)<think>(.*?)</think>', 1), '^\s+|\s+$', '', 'g') AS th,
  regexp_replace(CASE WHEN regexp_matches(x, '(?s)<think>.*?</think>') THEN regexp_extract(x, '(?s)<think>.*?</think>(.*)', 1) ELSE x END, '^\s+|\s+$', '', 'g') AS re
  FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM tagged WHERE role = 'assistant')),
reasons AS (SELECT conv_id, turn, text, CASE WHEN NOT starts_with(x, '<think>') THEN 'missing_think_tag' WHEN o <> 1 THEN 'multiple_open_tags_' || o WHEN c = 0 THEN 'unclosed_think_tag'
  WHEN c <> 1 THEN 'multiple_close_tags_' || c WHEN th = '' THEN 'empty_thinking' WHEN re = '' THEN 'empty_response' END AS reason FROM judged)""",
    "results": """results AS (SELECT 'batch-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') || '-' || lpad(printf('%x', o_orderkey % 65536), 4, '0') AS id, o_orderkey AS pos, o_orderdate AS timestamp,
  o_orderpriority AS eval, 'm' || (o_custkey % 4) AS model, 'E00' || (o_custkey % 4) || CASE WHEN o_custkey % 3 = 0 THEN '-final' ELSE '' END AS alias,
  o_orderstatus AS dataset_sha, (o_totalprice % 1000) / 1000 AS score, o_orderstatus <> 'P' AS complete, o_orderkey % 10 = 0 AS archived FROM orders)""",
    "mc": """mc AS (SELECT item_id, chr((65 + (item_id * 7 // 3) % 4)::INT) AS letter, chr((65 + item_id % 4)::INT) AS gold, CASE WHEN item_id % 13 = 0 THEN 'timeout' END AS error FROM benchmark)""",
    "judge": """judge AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 = 0 OR doc_id % 6 = 0 THEN NULL ELSE (1 + doc_id % 5)::INT END AS score, CASE WHEN doc_id % 17 = 0 THEN 'Judge error' END AS error,
  CASE WHEN doc_id % 11 = 0 THEN 'No score found' WHEN doc_id % 6 = 0 THEN 'Non-numeric score: high' END AS parse_error FROM documents)""",
    "metrics": """metrics AS (SELECT event_id AS step, value / 100 AS train_loss, CASE WHEN event_type <> 'error' THEN value * 2 END AS g,
  coalesce(nullif(coalesce(CASE WHEN event_id % 50 = 0 THEN value / 90 END, CASE WHEN event_id % 25 = 0 THEN value / 80 END), 0), CASE WHEN event_id % 25 = 0 THEN value / 80 END) AS val_loss FROM events)""",
    "layers": """layers AS (SELECT regexp_extract(n_name, '([0-9]+)$', 1)::INT::VARCHAR AS name, 'plain' AS provider, n_name AS model, 0 AS priority FROM nation
  UNION ALL SELECT regexp_extract(c_name, '([0-9]+)$', 1)::INT::VARCHAR, 'tinker', c_name, 1 FROM customer UNION ALL SELECT regexp_extract(s_name, '([0-9]+)$', 1)::INT::VARCHAR, 'local', s_name, 2 FROM supplier)""",
}


def sql(body: str, *names: str) -> str:
    """body after the named expressions; a body that starts with a comma adds its own."""
    return f"WITH {', '.join(SQL[n] for n in names)}{'' if body.startswith(',') else ' '}{body}"
